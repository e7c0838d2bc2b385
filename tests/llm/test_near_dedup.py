import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweft.llm.components import components
from textweft.llm.near_dedup import keep_first, near_duplicates, prob_minhash, probability_jaccard

SCHEMA = "doc_id bigint, text string, band string, n_links string"


def shingles(text, k=5):
    w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def similarity(a, b):
    return sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute_classes(rows, threshold=0.8):
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = Counter()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and i != j and similarity(a, b) >= threshold - 1e-12:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {d: find(d) for d in parent}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (6, 30, 80, 200, 400):
        for _ in range(4):
            base = rng.choices(vocab, k=size)
            for edits in (0, 0, 1, 2, 4, 8, 16):
                words = base[:]
                for _ in range(edits):
                    words[rng.randrange(size)] = rng.choice(vocab)
                rows.append((n, " ".join(words)))
                n += 1
    base = rng.choices(vocab, k=150)
    for _ in range(60):  # a group around one text, whose members are mostly not alike
        words = base[:]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = rng.choice(vocab)
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n, "ha " * 300), (n + 1, "ha " * 301), (n + 2, "x y z"), (n + 3, "X, y z!"), (n + 4, ""), (n + 5, None), (n + 6, "..."), (n + 7, "")]
    rng.shuffle(rows)
    return rows


def test_signatures_estimate_the_exact_similarity():
    rng = np.random.default_rng(5)
    ea, eb = np.arange(0, 90).astype(np.uint64), np.arange(30, 120).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 90), rng.integers(1, 6, 90)
    exact = probability_jaccard(ea, wa, eb, wb)
    a, b = ({int(e): int(w) for e, w in zip(e_, w_)} for e_, w_ in ((ea, wa), (eb, wb)))
    assert exact == pytest.approx(similarity(Counter(a), Counter(b)))
    m = 4096
    s = prob_minhash(np.concatenate([ea, eb]), np.repeat([0, 1], 90), np.concatenate([wa, wb]), 2, m)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)
    scaled = prob_minhash(ea, np.zeros(90, int), wa * 7, 1, m)
    assert np.array_equal(scaled[0], s[0])


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", None) for d, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (9, "A b c d e f g"), (7, "other words than all of those"), (2, None), (3, "")]
    docs = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, None), (2, 2), (3, 3), (5, 5), (5, 5), (7, 7), (9, 5)]
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in keep_first(docs).collect())
    assert kept == [(-1, "a b c d e f g"), (2, None), (3, ""), (5, "a b c d e f g"), (7, "other words than all of those")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0 and keep_first(docs).columns == docs.columns


def test_a_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 2000), (2000, 3000)], "a bigint, b bigint"))
    got = {r.node: r.class_id for r in components(links).collect()}
    assert len(got) == 304 and {got[i] for i in range(301)} == {0} and got[3000] == 1000


def test_ids_of_several_near_texts(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base_id in range(0, 300, 30):
        base = rng.choices(vocab, k=120)
        for i in range(14):
            words = base[:]
            for _ in range(rng.randrange(7)):
                words[rng.randrange(120)] = rng.choice(vocab)
            # half of the ids have another text as well, near the base or not
            rows.append((base_id + i, " ".join(words)))
            if i % 2:
                other = base[:] if i % 4 == 1 else rng.choices(vocab, k=120)
                for _ in range(rng.randrange(7)):
                    other[rng.randrange(120)] = rng.choice(vocab)
                rows.append((base_id + i, " ".join(other)))
    want = brute_classes(rows)
    got = near_duplicates(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)


def test_memory_of_signing_has_a_bound():
    import tracemalloc

    import pyarrow as pa

    from textweft.llm.near_dedup import _signatures

    batch = pa.RecordBatch.from_arrays([pa.array(range(60_000)), pa.array([f"word{i}" for i in range(60_000)])], ["doc_id", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in _signatures(20, 5, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 150 << 20
