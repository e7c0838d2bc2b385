import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textweft.functions.hashing import code_point_hashes, kgram_hash_naive, kgram_hashes, token_hash, token_hash_column
from textweft.operators import ignore
from textweft.operators.tokens import Node, char_tokens, char_tokens_of, tokens_of, tree_tokens
from textweft.operators.winnowing import char_prints, fingerprints, fingerprints_sql, winnow

TEXT = st.text(alphabet="ab \n\r\té😀ß", max_size=30)


def joined(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


@given(st.lists(TEXT, min_size=1, max_size=5))
def test_character_tokens_are_those_of_the_definition(texts):
    t = char_tokens(*joined(texts))
    got = list(zip(t.owner.tolist(), t.row.tolist(), t.col.tolist(), (t.col + t.size).tolist()))
    assert got == [(i, x.start_row, x.start_col, x.end_col) for i, s in enumerate(texts) for x in char_tokens_of(s)]


def test_a_stated_text():
    assert [tuple(t)[1:] for t in char_tokens_of("é a\r\n\r\nb\n")] == [(0, 0, 0, 2), (0, 2, 0, 3), (0, 3, 0, 4), (2, 0, 2, 1)]


@given(st.lists(st.integers(0, 33554392), max_size=60), st.integers(1, 40))
def test_kgram_hashes(tokens, k):
    assert kgram_hashes(np.array(tokens, np.int64), k).tolist() == kgram_hash_naive(tokens, k)


def test_token_hashes_agree(spark):
    tokens = ["a", "é", "ß", "€", "😀", "\n", "(", "identifier", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", token_hash_column(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: token_hash(t) for t in tokens}
    data, _ = joined(["aéß€😀"])
    assert code_point_hashes(data, np.flatnonzero((data & 0xC0) != 0x80)).tolist() == [token_hash(c) for c in "aéß€😀"]


def naive_winnow(h, w):
    """Keeps the rightmost smallest of each trailing window, when it changes."""
    kept = []
    for i in range(len(h)):
        window = range(max(0, i - w + 1), i + 1)
        best = min(window, key=lambda j: (h[j], -j))
        if not kept or kept[-1] != best:
            kept.append(best)
    return kept


@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=4), st.integers(1, 12))
def test_winnowing(sequences, w):
    flat = np.array([x for s in sequences for x in s], np.int64)
    first = np.cumsum([0, *map(len, sequences)])[:-1]
    want = [int(f) + i for f, s in zip(first, sequences) for i in naive_winnow(s, w)]
    assert winnow(flat, first, w).tolist() == want


def test_regions_span_the_kgram():
    text = "ab\ncd é\nf"
    p = char_prints(pa.array([text]), 3, 1)
    tokens = list(char_tokens_of(text))
    assert p.p.tolist() == list(range(len(tokens) - 2))
    assert list(zip(*(r.tolist() for r in p.regions))) == [(*tokens[i][1:3], *tokens[i + 2][3:5]) for i in range(len(tokens) - 2)]


def test_both_plans_give_the_same(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randrange(200)))) for i in range(20)] + [(20, ""), (21, None)]
    files = spark.createDataFrame(rows, "file_id bigint, content string")
    tokens = spark.createDataFrame([(i, j, token_hash(t.name)) for i, s in rows if s for j, t in enumerate(char_tokens_of(s))], "file_id bigint, pos int, th bigint")
    for k, w in ((1, 1), (4, 3), (23, 17)):
        a = sorted(map(tuple, fingerprints(files, k, w).select("file_id", "idx", "p", "h").collect()))
        assert a == sorted(map(tuple, fingerprints_sql(tokens, k, w).collect())) and (a or k > 4)
    plan = fingerprints(files, 23, 17)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tree_tokens():
    leaf = lambda kind, a, b: Node(kind, (0, a), (0, b), [])
    tree = Node("program", (0, 0), (0, 9), [leaf("line_comment", 1, 4), Node("call", (0, 5), (0, 8), [leaf("name", 6, 7)])])
    assert [tuple(t) for t in tree_tokens(tree)] == [
        ("(", 0, 0, 0, 1), ("program", 0, 0, 0, 1), ("(", 0, 5, 0, 6), ("call", 0, 5, 0, 6), ("(", 0, 6, 0, 7), ("name", 0, 6, 0, 7), (")", 0, 7, 0, 7), (")", 0, 8, 0, 8), (")", 0, 9, 0, 9),
    ]
    assert "line_comment" in [t.name for t in tree_tokens(tree, include_comments=True)]
    deep = leaf("x", 0, 1)
    for _ in range(5000):
        deep = Node("x", (0, 0), (0, 1), [deep])
    assert len(tree_tokens(deep)) == 3 * 5001


def test_renaming_leaves_no_trace_in_python_and_html():
    names = lambda s, language: [t.name for t in tokens_of(s, language)]
    assert names("def f(x):\n    return x + 1  # one\n", "python") == names("def g(yy):\n    return yy + 1\n", "python")
    assert names("<p class=a>x<!-- c --><br></p>", "html") == names("<p id='b'>other<br></p>", "html")
    with pytest.raises(ValueError, match="no tokenizer"):
        tokens_of("x", "haskell")


def prints(spark, sequences):
    return spark.createDataFrame([(i, j, ord(c)) for i, s in enumerate(sequences) for j, c in enumerate(s)], "file_id int, idx int, h int")


def test_ignore_rules(spark):
    values = lambda df: sorted((r.file_id, r.idx) for r in df.collect())
    assert values(ignore.classified(prints(spark, ["XA", "XB", "YC", "YD"]), 2)[1]) == []
    assert values(ignore.classified(prints(spark, ["XA", "XB", "XC", "YD"]), 2)[1]) == [(0, 0), (1, 0), (2, 0)]
    assert values(ignore.classified(prints(spark, ["XXXX", "XB"]), 2)[1]) == []
    live, gone = ignore.classified(prints(spark, ["ZZA", "B"]), None, prints(spark, ["Z"]))
    assert values(gone) == [(0, 0), (0, 1)] and values(live) == [(0, 2), (1, 0)]
    gone = ignore.classified(prints(spark, ["ABXXCDX"]), None, prints(spark, ["X"]))[1]
    ranges = ignore.ranges_of(gone)
    assert sorted((r.start, r.end) for r in ranges.collect()) == [(2, 4), (6, 7)]
    assert values(ignore.positions_of(ranges)) == [(0, 2), (0, 3), (0, 6)]
    odd = spark.createDataFrame([(0, 1, 0), (0, 2, 2), (0, 0, 2), (0, 1, 3)], "file_id int, start int, end int")
    assert values(ignore.positions_of(odd)) == [(0, 0), (0, 1), (0, 2)]


def test_sources_that_cannot_be_parsed_have_no_fingerprints():
    import pyarrow as pa

    from textweft.operators.winnowing import tree_prints

    good = "def f(x):\n    return [x, x + 1, f(x)]\n" * 3
    texts = pa.array(["def (", good, "(" * 3000 + ")" * 3000, "x = \0", ""])
    prints = tree_prints(texts, "python", False, 5, 3)
    alone = tree_prints(pa.array([good]), "python", False, 5, 3)
    assert set(prints.owner.tolist()) == {1} and prints.h.tolist() == alone.h.tolist() and len(alone.h) > 5
