import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from textweft.llm import textkernel as tk

TEXTS = st.lists(st.text(alphabet="aB1_ .,\né😀\x00Z", max_size=40), max_size=8)


def plain_words(text):
    return re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", text)


@given(TEXTS)
def test_words_are_those_of_the_definition(texts):
    w = tk.words(pa.array(texts, pa.string()), fold=False)
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [plain_words(t) for t in texts]


@given(TEXTS)
def test_equal_words_and_shingles_have_equal_hashes(texts):
    w = tk.words(pa.array(texts, pa.string()), fold=False)
    flat = [x for t in texts for x in plain_words(t)]
    assert len(set(flat)) == len(set(w.hash.tolist()))
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat))
    h, row = tk.shingles(w, 3)
    want = []
    for i, t in enumerate(texts):
        ws = plain_words(t)
        want += [(i, tuple(ws[j : j + 3])) for j in range(len(ws) - 2)] if len(ws) >= 3 else ([(i, tuple(ws))] if ws else [])
    assert sorted(row.tolist()) == sorted(i for i, _ in want)
    assert len(set(h.tolist())) == len({s for _, s in want})
    _, r, count = tk.weighted(h, row)
    assert len(r) == len(set(want)) and count.sum() == len(want)


def test_slices_keep_long_and_null_texts_whole():
    texts = pa.array(["a" * 50, None, "b", "c" * 5, ""])
    parts = list(tk.slices(texts, 10))
    assert [x for _, p in parts for x in p.to_pylist()] == ["a" * 50, "", "b", "c" * 5, ""]
    assert [at for at, _ in parts] == sorted(at for at, _ in parts)


def test_a_text_has_the_same_hashes_in_any_slice():
    alone, _ = tk.shingles(tk.words(pa.array(["one two three four five six"])))
    w = tk.words(pa.array(["zero zero", "one two three four five six", ""]))
    among, row = tk.shingles(w)
    assert np.array_equal(np.sort(among[row == 1]), np.sort(alone))
    assert tk.sequence_keys(w)[0][1] == tk.sequence_keys(tk.words(pa.array(["One, two three; four five SIX"])))[0][0]
