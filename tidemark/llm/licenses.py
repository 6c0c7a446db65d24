"""License scans: matching statistics against a generalised suffix automaton of licence texts.

The automaton holds every substring of the templates' words. A text is streamed through it once: each word moves
to the longest suffix read so far that some template holds. Where such a match ends it becomes an anchor (place in
the text, place in a template, length); anchors in the same order in both are chained. A chain over enough words of
a template is scored by the share it covers of those words that ordinary sentences don't have.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_texts, pick

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and opening clauses of common licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. CC0 Public Domain Dedication"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY 3.0."),
    ("cc", "Licensed under CC BY-SA 3.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Words of the templates that ordinary sentences have too; the others tell licences.
COMMON = frozenset("a above all an and any anyone applicable applications are as associated at author authors available basis be but by can code conditions do either even event except file files following for form forms free freely from general has held if in included including international into is it its kind language later law legal library license licensed list made materials may means must name names no not of on one option or org other particular permission possible prior program provided public published purpose related released required rights see shall so software source specific terms that the this to txt under unless use used useful version was which whom will with without work worldwide writing written www you your".split())
#: An anchor has so many words. A label needs a chain with no larger gap that covers so many words of a template (or all, where it has
#: fewer) and so large a share of its words that tell licences.
MIN_ANCHOR = 3
MIN_WORDS = 8
MIN_SHARE = 0.6
MAX_GAP = 30

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans string"
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word ids; ``ends[state]``: the places after it in each template that has it."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, set()).add(i + 1)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for t, e in self.ends[s].items():  # what ends here also ends with each suffix
                self.ends[self.link[s]].setdefault(t, set()).update(e)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def matches(self, ids: list[int | None], least: int):
        """(end in the text, state, length) where the longest match can't go on, if it has ``least`` words."""
        state, length = 0, 0
        nxt, link, size = self.next, self.link, self.length
        for i, w in enumerate(ids):
            if w is None:
                if length >= least:
                    yield i, state, length
                state = length = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                if length >= least:
                    yield i, state, length
                while state and w not in nxt[state]:
                    state = link[state]
                to = nxt[state].get(w)
                length = size[state] + 1 if to is not None else 0
                state = to or 0
            else:
                state, length = to, length + 1
        if length >= least:
            yield len(ids), state, length


def chains(anchors: list[tuple[int, int, int]], gap: int, telling: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, end, template words, telling words) of chains of (start in text, start in template, length), which come
    in the order of their ends in the text. ``telling[i]``: how many of the template's first i words tell licences."""
    best: list[tuple[int, int, int]] = []  # words covered, telling ones, first start
    for j, (x, y, n) in enumerate(anchors):
        got = (n, telling[y + n] - telling[y], x)
        for i in range(j - 1, -1, -1):
            px, py, pn = anchors[i]
            if px + pn < x - gap:
                break  # so do all before it
            lap = max(0, px + pn - x, py + pn - y)
            if px < x and py < y and lap < n:
                got = max(got, (best[i][0] + n - lap, best[i][1] + telling[y + n] - telling[y + lap], best[i][2]))
        best.append(got)
    return [(start, x + n, cover, told) for (cover, told, start), (x, _, n) in zip(best, anchors, strict=True)]


def scanner(templates=TEMPLATES, phrases=PHRASES, min_anchor=MIN_ANCHOR, min_share=MIN_SHARE, max_gap=MAX_GAP, min_words=MIN_WORDS, common=COMMON):
    vocab: dict[bytes, int] = {}
    labels = [label for label, _ in templates]
    split = [[vocab.setdefault(w, len(vocab)) for w in words_of(t.encode())] for _, t in templates]
    tells = {k for w, k in vocab.items() if w.decode() not in common}
    telling = [[0, *accumulate(int(w in tells) for w in t)] for t in split]
    base = [([vocab.setdefault(w, len(vocab)) for w in words_of(p.encode())], label) for p, label in phrases]
    automaton = Automaton(split)
    ends_with = defaultdict(list)
    for words, label in base:
        ends_with[words[-1]].append((words, label))

    def scan(texts: list[bytes]) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for text in texts:
            words = words_of(text)
            ids = list(map(vocab.get, words))
            starts, found = [], set()
            for last, ends in ends_with.items():
                at = -1
                for _ in range(ids.count(last)):
                    at = ids.index(last, at + 1)
                    for phrase, label in ends:
                        if at + 1 >= len(phrase) and ids[at + 1 - len(phrase) : at + 1] == phrase:
                            starts.append(at + 1 - len(phrase))
                            found.add(label)
            anchors = defaultdict(list)
            for end, state, length in automaton.matches(ids, min_anchor):
                for t, places in automaton.ends[state].items():
                    anchors[t] += [(end - length, e - length, length) for e in sorted(places)]
            score, also, spans = 0.0, set(found), []
            for t, each in anchors.items():
                for start, end, cover, told in chains(each, max_gap, telling[t]):
                    if cover < min(min_words, len(split[t])) or not told:
                        continue
                    share = min(1.0, told / telling[t][-1])
                    score = max(score, share)
                    if share >= min_share:
                        also.add(labels[t])
                        spans.append((start, end, labels[t]))
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(found)))
            out["labels"].append(",".join(sorted(also)))
            out["score"].append(score)
            out["template_spans"].append(",".join(f"{label}:{a}:{b}" for a, b, label in sorted(set(spans))))
        return out

    return scan


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: places of the base phrases, labels, covered template spans and the best share.

    Null or empty texts have no words, no labels and score 0. Rows are independent; repeated rows give repeated
    results. A text of any length is streamed in linear time (an anchor is compared with those that end within
    ``MAX_GAP`` words before it). An empty table gives an empty result. No shuffle.
    """
    return map_texts(pick(docs, doc_id=id_col, text=text_col), lambda: scanner(templates, phrases), SCHEMA)
