import random
import re
from collections import Counter

import numpy as np
import pytest

from textweft.llm.decontaminate import MultiIndex, best_windows, contaminated, keep_clean

DOCS = "doc_id bigint, text string, item_id string, similarity double"
ITEMS = "item_id bigint, text string, doc_id string"


def words(t):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t or "")]


def brute(docs, items, k=5, threshold=0.8):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = [x for x, *_ in words(s)]
            n, size = len(v), min(k, len(v))
            if not n:
                continue
            b = Counter(tuple(v[j : j + size]) for j in range(n - size + 1))
            for at in range(len(w) - n + 1):
                x = [y for y, *_ in w[at : at + n]]
                a = Counter(tuple(x[j : j + size]) for j in range(n - size + 1))
                s_ = sum((a & b).values()) / sum((a | b).values())
                if s_ >= threshold and ((d, i) not in out or s_ > out[d, i][2]):
                    out[d, i] = (w[at][1], w[at + n - 1][2], s_)
    return out


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    queries = np.concatenate([items ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)) for n in (1, 5, 11, 12, 13, 20)])
    q, i = MultiIndex(items, 12).find(queries)
    want = {(a, b) for a in range(len(queries)) for b in range(len(items)) if bin(int(queries[a] ^ items[b])).count("1") <= 12}
    assert set(zip(q.tolist(), i.tolist())) == want


def test_windows_are_those_of_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"é{i}" if i % 5 == 0 else f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 3, 4, 5, 6, 14, 30, 30, 59, 59])] + [(100, ""), (101, None), (102, "same same same same same same same")]
    docs = []
    for d in range(60):
        text = rng.choices(vocab, k=rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            i, s = rng.choice(items[:10])
            s = s.split()
            if d % 3 == 0 and len(s) > 40:  # an edit that leaves the similarity above the threshold
                s[rng.randrange(len(s) - 3, len(s))] = "edited"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() if d % 2 else x for x in s]
        docs.append((d, ", ".join(text)))
    docs += [(1000, None), (1001, ""), (1002, "İ same same same same same same same same"), (1003, "w1 " * 3000)]
    found = best_windows(contaminated(spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], DOCS), spark.createDataFrame([(i, s, None) for i, s in items], ITEMS)))
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.similarity) for r in found.collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(got) > 20
    for key in got:
        assert abs(got[key][2] - want[key][2]) < 1e-12
        assert got[key][:2] == want[key][:2] or key[0] == 1003


def test_blocks_of_the_benchmark_give_the_same(spark):
    items = [(i, f"one{i} two three four five six{i} seven") for i in range(30)]
    docs = [(i, f"before {s} after") for i, s in items if i % 2]
    a, b = spark.createDataFrame([(d, t, None, None) for d, t in docs], DOCS), spark.createDataFrame([(i, s, None) for i, s in items], ITEMS)
    whole = sorted(map(tuple, contaminated(a, b).collect()))
    assert whole == sorted(map(tuple, contaminated(a, b, benchmark_bytes=400, index_items=3).collect()))
    assert [r[0] for r in whole] == [d for d, _ in docs]


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (2, "clean text", None, None)], DOCS)
    items = spark.createDataFrame([(7, "A b c d e f", None), (7, "a b c d e f", None), (None, "c d e f", None)], ITEMS)
    assert contaminated(docs, items).count() == 9
    assert best_windows(contaminated(docs, items)).count() == 4
    assert sorted((r.doc_id is None, r.doc_id) for r in keep_clean(docs, items).collect()) == [(False, 2), (True, None)]
    assert contaminated(docs, items.limit(0)).count() == 0 and contaminated(docs.limit(0), items).count() == 0
    assert keep_clean(docs, items.limit(0)).count() == 4


def test_a_text_of_fewer_words_than_the_item_is_compared_whole(spark):
    item = [f"w{i}" for i in range(59)]
    shingles = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    docs = {n: item[:n] for n in range(1, 60)} | {100 + n: item[n:] for n in range(30)} | {200: ["other"] * 55}
    want = {}
    for d, w in docs.items():
        both = sum((shingles(w) | shingles(item)).values())
        if sum((shingles(w) & shingles(item)).values()) / both >= 0.8:
            want[d] = (0, len(" ".join(w)), sum((shingles(w) & shingles(item)).values()) / both)
    a, b = spark.createDataFrame([(d, " ".join(w), None, None) for d, w in docs.items()], DOCS), spark.createDataFrame([(1, " ".join(item), None), (2, "quite another item of seven words here", None)], ITEMS)
    assert {r.doc_id: (r.start, r.end, r.similarity) for r in best_windows(contaminated(a, b)).collect()} == want and 55 in want and 30 not in want


def test_more_items_than_rows_of_a_slice():
    import pyarrow as pa

    from textweft.llm.decontaminate import _search, items_of
    from textweft.llm import textkernel as tk

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(6)) for _ in range(70_000)]
    items = items_of(list(range(len(texts))), texts)
    assert len(items.size) == 70_000 and items.cut[-1] == len(items.el) and set(np.diff(items.cut).tolist()) == {2}
    some = [0, 1, 65_535, 65_536, 69_999]
    for i in some:
        el, _, _ = tk.weighted(*tk.shingles(tk.words(pa.array([texts[i]]))))
        assert items.el[items.cut[i] : items.cut[i + 1]].tolist() == el.tolist()
    regions = [tk.words(pa.array([f"before {texts[i]} after"])).hash for i in some]
    at = np.arange(8, dtype="<i8").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(some), pa.array([h.tobytes() for h in regions]), pa.array([at] * 5), pa.array([at] * 5)], ["doc_id", "hashes", "begins", "ends"])
    found = pa.Table.from_batches(list(_search(items, pa.int64(), 0.8, 19, 5, 2)(iter([batch])))).to_pylist()
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in found) == [(i, i, 1, 6) for i in some]


def test_rows_beyond_the_packing_are_an_error():
    from textweft.llm import textkernel as tk

    with pytest.raises(ValueError, match="rows"):
        tk.weighted(np.zeros(1, np.uint64), np.array([1 << 16]))
