import random

import numpy as np
import pytest

from tidemark.llm import packing

MILLION = 1_000_000


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    return packing.encoder(path), lambda t: np.array(tok.encode(t, add_special_tokens=False).ids)


LONG = {
    "spaces": " " * MILLION,
    "newlines": "\n" * MILLION,
    "tabs": "\t" * MILLION,
    "mixed": "".join(random.Random(1).choices(" \n\t\r　\xa0\x85", k=MILLION)),
    "words round them": "abc" + " " * MILLION + "def" + "\n" * MILLION + "<|endoftext|>" + " \n" * MILLION + "'s",
    "before the special token": "a" + " " * MILLION + "<|endoftext|> " + "\n" * MILLION + " b",
    "a control character that isn't white space": " " * MILLION + "\x1c" + "\t" * MILLION,
    "ten million": "a " + " \n" * 5 * MILLION + "b's",
    "letters": "ab" * MILLION,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_runs_have_the_ids_of_the_tokenizer(both, name):
    ours, theirs = both
    assert np.array_equal(ours(LONG[name]), theirs(LONG[name]))


def test_a_long_run_is_packed(spark):
    rows = [(1, LONG["spaces"]), (2, "a b"), (3, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == MILLION + 1 and len({r.sequence_id for r in got}) == -(-(MILLION + 1 + 3 + 1) // 1024)
