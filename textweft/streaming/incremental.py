"""A store of fingerprints that a stream of files is compared with and added to.

Each micro-batch makes fingerprints of its files only, matches them against the store and each other, and then writes pairs and
fingerprints to folders named by the batch. A batch that runs again after a failure replaces its own folders, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textweft.config import EngineConfig
from textweft.operators import matching
from textweft.operators.winnowing import fingerprints
from textweft.plans.tables import written

PRINTS = "file_id bigint, idx int, p int, h bigint, start_row int, start_col int, end_row int, end_col int"
PAIRS = "left_id bigint, right_id bigint, similarity double, longest_fragment bigint, overlap_left bigint, overlap_right bigint, total_left bigint, total_right bigint, total_overlap bigint"


class FingerprintStore:
    """Fingerprints, files and pairs below ``path``; ids of files must be new in every batch."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), language: str = "char") -> None:
        if config.template or config.max_fingerprint_count is not None or config.max_fingerprint_percentage is not None:
            # what they leave out changes with every file that comes
            raise ValueError("a store takes no template and no cap on the files that share a fingerprint")
        self.spark, self.path, self.config, self.language = spark, path.rstrip("/"), config, language

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")
        return (df if before is None else df.filter(F.col("batch") < before)).drop("batch")

    def prints(self, before: int | None = None) -> DataFrame:
        return self._read("prints", PRINTS, before)

    def files(self, before: int | None = None) -> DataFrame:
        return self._read("files", "file_id bigint", before)

    def pairs(self) -> DataFrame:
        """Metrics of all pairs with a match so far."""
        return self._read("pairs", PAIRS)

    def add(self, files: DataFrame, batch: int) -> None:
        """Compares ``files(file_id, content)`` with all of earlier batches and each other, and stores them."""
        c = self.config
        new = written(fingerprints(files, c.kgram_length, c.kgrams_in_window, self.language, c.include_comments), "new-prints")
        stored = self.prints(before=batch)
        found = written(matching.matches_with_stored(new, stored, c.min_fragment_length), "new-matches")
        met = found.select(F.col("left_id").alias("file_id")).union(found.select("right_id")).distinct()
        live = new.select("file_id", "idx").union(stored.join(met, "file_id", "left_semi").select("file_id", "idx"))
        ids = files.select("file_id").union(self.files(before=batch).join(met, "file_id", "left_semi")).distinct()
        matching.metrics(ids, live, found).write.mode("overwrite").parquet(f"{self.path}/pairs/batch={batch}")
        files.select("file_id").write.mode("overwrite").parquet(f"{self.path}/files/batch={batch}")
        new.write.mode("overwrite").parquet(f"{self.path}/prints/batch={batch}")

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that adds every micro-batch of ``stream(file_id, content)``; ``availableNow=True`` ends with what is there."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
