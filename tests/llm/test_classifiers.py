import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textweft.llm import quality, toxicity

DOCS = "doc_id bigint, text string, score string, label string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeioulnrst", k=rng.randrange(3, 8))) for _ in range(300)]
    bad = ["zorgak", "flumpix", "brakkut"]
    rows = []
    for d in range(n):
        words = rng.choices(vocab, k=rng.randrange(20, 300))
        good, nasty = d % 4 != 0, d % 5 == 0
        if nasty:
            for i in rng.sample(range(len(words)), max(1, len(words) // 20)):
                w = rng.choice(bad)
                words[i] = w if not held(d) else w[:-1] + "zz"  # misspelt where nothing is learned
        if not good:
            words = [w + rng.choice(["***", "###", "%%%"]) for w in words]
        rows.append((d, " ".join(words), int(good), int(nasty)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    extra = [(10_000, None), (10_001, ""), (10_001, ""), (None, "some words"), (10_002, "word " * 40_000), (10_003, "###")]
    docs = spark.createDataFrame([(d, t, "x", None) for d, t, *_ in rows] + [(d, t, None, None) for d, t in extra], DOCS)
    labels = spark.createDataFrame([(d, q, x, "t") for d, _, q, x in rows if d % 3] + [(10_001, None, None, None), (None, 1, 1, None), (1, 1 - rows[1][2], 0, None), (1, rows[1][2], 0, None)], LABELS)
    return rows, docs, labels


@pytest.mark.parametrize("scores, column, least", [(quality.quality_scores, 2, 0.95), (toxicity.toxicity_scores, 3, 0.9)])
def test_held_out_accuracy(spark, tables, scores, column, least):
    rows, docs, labels = tables
    got = scores(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 10_000}
    assert all(by[d].held_out == held(d) for d in by)
    right = [by[r[0]].predicted == r[column] for r in rows if held(r[0])]
    assert np.mean(right) >= least
    assert all(0 <= r.score <= 1 for r in got)
    threshold = 0.7 if column == 2 else 0.3
    assert all(r.predicted == (r.score >= threshold) for r in got)
    nameless = [r for r in got if r.doc_id is None]
    assert len(nameless) == 1 and nameless[0].held_out is False


def test_held_out_labels_change_nothing(spark, tables):
    rows, docs, labels = tables
    few = docs.filter("doc_id < 40")
    flipped = spark.createDataFrame([(d, 1 - q if held(d) else q, 1 - x if held(d) else x, "t") for d, _, q, x in rows if d % 3], LABELS)
    plain = spark.createDataFrame([(d, q, x, "t") for d, _, q, x in rows if d % 3], LABELS)
    docs = docs.filter("doc_id < 300")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(map(tuple, scores(docs, plain).filter("doc_id < 40").collect())) == sorted(map(tuple, scores(docs, flipped).filter("doc_id < 40").collect()))
    assert few.count() == 40


def test_without_labels_or_documents(spark, tables):
    _, docs, labels = tables
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert {r.score for r in scores(docs.filter("doc_id < 5"), labels.limit(0)).collect()} == {0.5}
        assert scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, quality.WIDTH))
    row, at, y = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([0, 3, 5]), np.array([1.0, 0.0, 1.0])
    shapes = {"W": (quality.WIDTH, 24), "b": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "d": (1,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := quality._forward(x, at, row, p)["p"], 1 - s)))
    g = quality._gradients(x, at, row, y, p)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        old = p[k][i]
        p[k][i] = old + 1e-5
        up = loss()
        p[k][i] = old - 1e-5
        down = loss()
        p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_attention_weights_sum_to_one_and_every_text_has_a_passage():
    x, row = quality.passages(pa.array(["", "a b", "w " * 1000, "###"]))
    assert np.bincount(row).tolist() == [1, 1, 16, 1]
    model = quality.fit_bags(x, row, np.array([0, 1, 1, 0], np.float32))
    a, p = model.attention(x, row)
    assert np.bincount(row, a) == pytest.approx([1, 1, 1, 1]) and len(p) == 4


def test_misspellings_share_buckets_and_splits_of_a_slice_do_not_matter():
    whole = toxicity.pairs(pa.array(["zorgak", "zorgazz", "élan vital", ""]))
    shared = set(whole[0][0].tolist()) & set(whole[1][0].tolist())
    assert len(shared) >= 6
    alone = toxicity.pairs(pa.array(["élan vital"]))
    assert np.array_equal(alone[0][0], whole[2][0]) and np.allclose(alone[0][1], whole[2][1]) and len(whole[3][0]) == 0
