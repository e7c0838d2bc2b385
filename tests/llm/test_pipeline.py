import random

import pytest

import corpus_pipeline
from textweft.llm.quality import THRESHOLD, quality_scores

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("aeioulnrst", k=5)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(40)) for i in range(5)]
    rows, labels = [], []
    for d in range(400):
        t = text(rng.randrange(30, 150))
        if d % 5 == 0:
            t = " ".join(w + "***" for w in t.split())
        if d % 17 == 3:
            t = f"{t} {items[d % 5][1]} {text(5)}"
        if d % 19 == 4:
            t += " token = abX9kQz72LmPq0RtYv3W"
        rows.append((d, t, rng.choice(["en", "de"]), rng.choice(["src0", "src1", "src5", "src10", "src19"]), len(t)))
        labels.append((d, int(d % 5 != 0), 0))
    rows += [(1000 + d, *rows[d][1:]) for d in range(1, 400, 9)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src0", 0), (None, text(60), "en", "src0", 300), (7, *rows[7][1:])]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_each_stage_does_its_part(spark, tables):
    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    scores = {(r.doc_id, r.score) for r in quality_scores(docs, spark.read.parquet(f"{at}/labels.parquet")).collect()}
    good = {d for d, s in scores if s >= THRESHOLD}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secret_scan", "mixing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert name == "mixing" or docs.columns == columns
    assert set(seen["quality"]) == good
    assert not any(d is not None and d < 400 and d % 5 == 0 for d in seen["quality"])
    alike = {}
    for d, r in seen["quality"].items():
        if d is not None and (r.text or "").split():
            alike.setdefault(r.text, []).append(d)
    assert set(seen["near_dedup"]) == {d for d in seen["quality"] if d is None or d in {min(v) for v in alike.values()} or not (seen["quality"][d].text or "").split()}
    assert set(seen["decontamination"]) == {d for d, r in seen["near_dedup"].items() if not any(s in (r.text or "") for _, s in items)}
    assert set(seen["secret_scan"]) == set(seen["decontamination"])
    for d, r in seen["secret_scan"].items():
        old = seen["decontamination"][d]
        assert r.text == (old.text and old.text.replace("token = abX9kQz72LmPq0RtYv3W", "[REDACTED]"))
        assert r.text == old.text or r.n_chars == len(r.text)
    assert set(seen["mixing"]) <= set(seen["secret_scan"]) and all(r.copies >= 1 for r in seen["mixing"].values())


def test_run_is_its_stages(spark, tables):
    at, *_ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), stage(spark, docs, at).schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_tables_and_clashing_names(spark, tables, tmp_path):
    at, rows, _ = tables
    schema = f"{DOCS}, copies string, score string, budget int"
    for name, some in (("none", []), ("few", [(*r, "c", "s", 1) for r in rows[1:4]])):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert mixed.columns == [*docs.columns, "_copies"]
        kept = mixed.collect()
        assert {r.copies for r in kept} <= {"c"} and len(kept) <= len(some), name
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
