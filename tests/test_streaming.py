import random

import pytest

from textweft.api import Engine
from textweft.config import EngineConfig
from textweft.streaming.incremental import FingerprintStore


def test_a_stream_gives_the_pairs_of_one_run(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(3)]
    texts = [rng.choice(base)[rng.randrange(40) :] + "".join(rng.choice("xyz") for _ in range(60)) for _ in range(12)]
    for n in range(3):
        rows = [(i, texts[i]) for i in range(n * 4, n * 4 + 4)]
        spark.createDataFrame(rows, "file_id bigint, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = EngineConfig(kgram_length=8, kgrams_in_window=4)
    store = FingerprintStore(spark, str(tmp_path / "store"), config)
    stream = spark.readStream.schema("file_id bigint, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.follow(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    files = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "file_id bigint, path string, content string")
    whole = Engine(spark, config).report_table(files).pairs(all_pairs=False).drop("id")
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, store.pairs().collect())) == want and len(want) > 10
    # a batch that runs again replaces itself
    store.add(spark.createDataFrame([(i, texts[i]) for i in range(8, 12)], "file_id bigint, content string"), 2)
    assert sorted(map(tuple, store.pairs().collect())) == want


def test_a_store_refuses_caps_and_templates(spark, tmp_path):
    for config in (EngineConfig(max_fingerprint_count=3), EngineConfig(max_fingerprint_percentage=0.5), EngineConfig(template=("x.txt",))):
        with pytest.raises(ValueError, match="store"):
            FingerprintStore(spark, str(tmp_path), config)
