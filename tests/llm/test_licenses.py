"""License scans against a plain version: naive matching statistics, all chains."""

import random
import time

from tests.llm import brute
from tidemark.llm import licenses

TEMPLATES = (("x", "a b c d e f g h a b c i j k"), ("x", "b c d b c d b c d"), ("y", "p q r s t u v w x y z a b"), ("z", "a b c"))


def plain(text, templates, least, min_share, gap, floor, common):
    words, split = licenses.words_of(text.encode()), [licenses.words_of(t.encode()) for _, t in templates]
    held = lambda x: any(t[i : i + len(x)] == x for t in split for i in range(len(t)))
    size = [max((i - j for j in range(i + 1) if held(words[j:i])), default=0) for i in range(len(words) + 1)] + [0]
    anchors = [[] for _ in split]
    for end in range(1, len(words) + 1):
        n = size[end]
        if n >= least and size[end + 1] != n + 1:
            for t, a in zip(split, anchors, strict=True):
                a += [(end - n, k, n) for k in range(len(t) - n + 1) if t[k : k + n] == words[end - n : end]]
    score, labels, spans = 0.0, set(), set()
    for (label, _), t, each in zip(templates, split, anchors, strict=True):
        best = []
        tells = [w.decode() not in common for w in t]
        for x, y, n in each:
            got = (n, sum(tells[y : y + n]), x)
            for (px, py, pn), (cover, told, first) in zip(each, best, strict=False):
                lap = max(0, px + pn - x, py + pn - y)
                if px + pn >= x - gap and px < x and py < y and lap < n:
                    got = max(got, (cover + n - lap, told + sum(tells[y + lap : y + n]), first))
            best.append(got)
            if got[0] < min(floor, len(t)) or not got[1]:
                continue
            share = min(1.0, got[1] / sum(tells))
            score = max(score, share)
            if share >= min_share:
                labels.add(label)
                spans.add((got[2], x + n, label))
    return score, labels, ",".join(f"{c}:{a}:{b}" for a, b, c in sorted(spans))


def test_labels_score_and_spans_equal_the_plain_version():
    rng = random.Random(8)
    scan = licenses.scanner(TEMPLATES, (("b c", "base"),), 2, 0.6, 5, 4, {"a", "d", "q"})
    for _ in range(400):
        text = []
        while len(text) < rng.randint(1, 60):
            t = rng.choice(TEMPLATES)[1].split()
            i = rng.randrange(len(t))
            text += rng.choices("abcdpqz!", k=rng.randint(0, 3)) + t[i : i + rng.randint(1, 9)]
        text = " ".join(text)
        got, (score, labels, spans) = scan([text.encode()]), plain(text, TEMPLATES, 2, 0.6, 5, 4, {"a", "d", "q"})
        base = {"base"} if " b c " in f" {text} ".replace("! ", "") else set()
        assert got["score"] == [score] and got["template_spans"] == [spans], text
        assert set(filter(None, got["labels"][0].split(","))) == labels | base, text


def test_crossing_anchors_do_not_hide_a_chain():
    crossing = [(1 + k, 60 - k, 9) for k in range(18)]
    assert licenses.chains([(0, 0, 10), *crossing, (29, 10, 20)], 30, list(range(80)))[-1] == (0, 49, 30, 30)


def test_each_template_is_found_whole_and_edited():
    scan, rng = licenses.scanner(), random.Random(1)
    for label, text in licenses.TEMPLATES:
        words = text.split()
        for at in rng.sample(range(len(words)), len(words) // 12):
            words[at] = "edited"
        for t in (text, "some words before " + text.upper() + " and after", " ".join(words)):
            got = scan([t.encode()])
            assert label in got["labels"][0].split(",") and (t is not text or got["score"] == [1.0]), t
    for t in ("the name of the author and the terms of this software", "you can use this for any purpose and copy it freely"):
        assert scan([t.encode()])["labels"] == [""]


def test_a_very_long_text_takes_linear_time():
    scan, took = licenses.scanner(), []
    for n in (200, 800):
        text = " ".join(t for _, t in licenses.TEMPLATES) + " of the software "
        start = time.process_time()
        got = scan([(text * n).encode()])
        took.append(time.process_time() - start)
    assert took[1] < 6 * took[0] + 1 and got["n_base"] == [800 * brute.licence(text)[1]]


def ordinary():
    """Sentences with the words of licences that are none."""
    things = "the film,this song,our report,a new album,the work of the author,the first version of the software,a public library,this general programme,the source code of life,the free event,a book in the public domain of letters".split(",")
    acts = [
        "was released under the title Night.", "was licensed under cc by someone.", "is licensed under the terms of the contract, version 3.", "may be used for any purpose including commercial applications.",
        "is provided as is without any warranty of quality.", "was released under the MIT professor's name.", "is distributed in the hope that it will be useful to you.", "was granted permission to use, copy and sell all copies.",
        "is subject to the following conditions: be there in time.", "must not be copied without specific prior written permission.", "comes with all rights, and you can obtain a copy of it at the office.", "is licensed under a Creative and International programme.",
        "is licensed under the public law, version 2.0.", "can be found in the documentation and other materials provided with the distribution.", "was made available under the terms of the lease.", "is free software in name only; you can redistribute the cost.",
        "is governed by the language of the law, and limited by its limitations.", "was merged, published, distributed and sold to persons in the city.", "is available at the station at a fee.", "is licensed to the boost of the economy, version 1.0.",
    ]
    return ["The film was released under the title Night.", "licensed under cc by someone", *(f"{a.capitalize()} {b}" for a in things for b in acts)]


def test_ordinary_sentences_have_no_label():
    scan, sentences = licenses.scanner(), ordinary()
    assert len(sentences) > 200
    got = scan([s.encode() for s in sentences])
    assert [s for s, x in zip(sentences, got["labels"], strict=True) if x] == []
    mixed = [f"{a} {b}" for a, b in zip(sentences, reversed(sentences), strict=True)]
    assert [s for s, x in zip(mixed, scan([s.encode() for s in mixed])["labels"], strict=True) if x] == []


def test_short_notices_in_running_text():
    scan = licenses.scanner()
    for label, text in (("cc", "All pictures here are licensed under CC BY 3.0 by their makers."), ("mit", "It is released under the MIT License, see below"), ("cc", "this work is licensed under a creative commons attribution sharealike 4.0 license"), ("gpl", "Our work is licensed under the GNU General Public License version 3 of 2007")):
        assert label in scan([text.encode()])["labels"][0].split(",")
