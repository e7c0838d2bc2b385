"""The engine: files to a report, and analysis of any table of sequences."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweft import languages
from textweft.config import EngineConfig, FragmentOrder, PairOrder
from textweft.operators import ignore, matching, ordering
from textweft.operators.tokens import TREES
from textweft.operators.winnowing import fingerprints
from textweft.plans.tables import written
from textweft.sources.readers import Source, read_source, read_template

log = logging.getLogger("textweft")
RESERVED = 2**63 - 1


class InvalidSequences(ValueError):
    """Sequences, ignored ranges or options break a rule."""


@dataclass(frozen=True)
class Analysis:
    """Metrics of all pairs of sequences and, if kept, their matches."""

    pairs: DataFrame
    found: DataFrame | None
    n_sequences: int

    @property
    def n_pairs(self) -> int:
        return self.n_sequences * (self.n_sequences - 1) // 2

    @property
    def has_matches(self) -> bool:
        return self.found is not None

    def metrics(self, i: int, j: int) -> dict:
        """Metrics of a pair, sides as asked for."""
        rows = ordering.pair(self.pairs, i, j).collect() if i != j else []
        if not rows:
            raise IndexError(f"there is no pair ({i}, {j})")
        row = rows[0].asDict()
        if i > j:
            for a, b in (("overlap_left", "overlap_right"), ("total_left", "total_right"), ("left_id", "right_id")):
                row[a], row[b] = row[b], row[a]
        return row

    def matches(self, i: int, j: int) -> list[tuple[int, int, int]]:
        """Matches of a pair as (left start, right start, length), sides as asked for."""
        if self.found is None:
            raise ValueError("matches were not kept")
        if i == j or not (0 <= min(i, j) and max(i, j) < self.n_sequences):
            raise IndexError(f"there is no pair ({i}, {j})")
        rows = ordering.pair(self.found, i, j).collect()
        return sorted((r["left_start"], r["right_start"], r["length"]) if i < j else (r["right_start"], r["left_start"], r["length"]) for r in rows)


def validate(sequences: DataFrame, ids: DataFrame, ignored: DataFrame | None, min_match_length: int) -> int:
    """Checks the rules in order, the first broken one raises; the number of sequences."""
    n = ids.count()
    if n < 2:
        raise InvalidSequences("there must be at least two sequences")
    if min_match_length < 1:
        raise InvalidSequences("min_match_length must be at least 1")
    if sequences.filter((F.col("h") < 0) | (F.col("h") == RESERVED)).head(1):
        raise InvalidSequences("a symbol is negative or reserved")
    if ignored is not None:
        if ignored.join(ids, "file_id", "left_anti").head(1):
            raise InvalidSequences("ignored ranges name a sequence that isn't there")
        sizes = ids.join(sequences.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n"))
        bad = ignored.join(sizes, "file_id").filter((F.col("start") > F.col("end")) | (F.col("end") > F.col("n")) | (F.col("start") < 0))
        if bad.head(1):
            raise InvalidSequences("an ignored range is reversed or out of bounds")
    return n


def analyze(sequences: DataFrame, ignored: DataFrame | None = None, min_match_length: int = 1, keep_matches: bool = False, ids: DataFrame | None = None, all_pairs: bool = True, check: bool = True) -> Analysis:
    """Compares every two of ``sequences(file_id, idx, h)``, ``idx`` dense from 0 in each.

    ``ignored(file_id, start, end)`` are half-open ranges of positions that count for nothing and that no match crosses. ``ids``
    lists the sequences, needed if some are empty. With ``all_pairs`` pairs without a match have zeros.
    """
    own = (ids if ids is not None else sequences).select("file_id").distinct()
    n = validate(sequences, own, ignored, min_match_length) if check else -1
    live = sequences
    if ignored is not None:
        live = sequences.join(ignore.positions_of(ignored), ["file_id", "idx"], "left_anti").select(sequences.columns)
    found = matching.matches(live, min_match_length)
    pairs = matching.metrics(own, live, found, all_pairs)
    return Analysis(pairs, matching.without_contained(found) if keep_matches else None, n)


def table_of(spark: SparkSession, sequences: Sequence[Sequence[int]]) -> tuple[DataFrame, DataFrame]:
    """``(file_id, idx, h)`` and ``(file_id)`` of sequences given as lists; 64-bit symbols."""
    for s in sequences:
        if any(not 0 <= x < RESERVED for x in s):
            raise InvalidSequences("a symbol is negative or reserved")
    rows = [(i, j, int(x)) for i, s in enumerate(sequences) for j, x in enumerate(s)]
    return spark.createDataFrame(rows, "file_id bigint, idx int, h bigint"), spark.createDataFrame([(i,) for i in range(len(sequences))], "file_id bigint")


def analyze_lists(spark: SparkSession, sequences: Sequence[Sequence[int]], ignored: Sequence[Sequence[tuple[int, int]]] | None = None, min_match_length: int = 1, keep_matches: bool = False) -> Analysis:
    """``analyze`` for lists; ``ignored`` has a list of ranges for each sequence."""
    if len(sequences) < 2:
        raise InvalidSequences("there must be at least two sequences")
    if min_match_length < 1:
        raise InvalidSequences("min_match_length must be at least 1")
    table, ids = table_of(spark, sequences)
    ranges = None
    if ignored is not None:
        if len(ignored) != len(sequences):
            raise InvalidSequences("there must be one list of ignored ranges per sequence")
        ranges = spark.createDataFrame([(i, a, b) for i, r in enumerate(ignored) for a, b in r], "file_id bigint, start int, end int")
    return analyze(table, ranges, min_match_length, keep_matches, ids)


def analyze_pair(spark: SparkSession, left: Sequence[int], right: Sequence[int], min_match_length: int = 1, ignored_left: Sequence[tuple[int, int]] = (), ignored_right: Sequence[tuple[int, int]] = ()) -> dict:
    """Metrics and matches of two sequences as plain data."""
    a = analyze_lists(spark, [left, right], [ignored_left, ignored_right], min_match_length, keep_matches=True)
    row = a.metrics(0, 1)
    return {"metrics": {k: v for k, v in row.items() if k not in ("left_id", "right_id")}, "matches": a.matches(0, 1)}


@dataclass(frozen=True)
class Report:
    """What an analysis gives: files, pairs and their fragments, all as tables."""

    config: EngineConfig
    source: Source
    files: DataFrame
    prints: DataFrame
    ignored: DataFrame
    found: DataFrame
    created_at: datetime
    cap: int | None

    @property
    def name(self) -> str:
        return self.config.name or self.source.name

    @property
    def has_fragments(self) -> bool:
        """Fragments are made for two files, or if asked for."""
        return self.source.n_files == 2 or self.config.compare

    @cached_property
    def _live(self) -> DataFrame:
        return self.prints.join(self.ignored.select("file_id", "idx"), ["file_id", "idx"], "left_anti") if self.cap is not None or self.config.template else self.prints

    def pairs(self, all_pairs: bool = True, order: PairOrder | None = None) -> DataFrame:
        """Pairs with ids and metrics, in the configured order."""
        rows = matching.metrics(self.files, self._live, self.found, all_pairs)
        return ordering.sort_pairs(ordering.with_pair_id(rows, self.source.n_files), order or self.config.sort_by)

    def fragments(self, order: FragmentOrder | None = None) -> DataFrame:
        """Matches in no other match, with their regions, in the configured order."""
        rows = matching.fragments(matching.without_contained(self.found), self.prints)
        return ordering.sort_fragments(rows, order or self.config.fragment_sort_by)

    def ignored_ranges(self) -> DataFrame:
        return ignore.ranges_of(self.ignored)

    def files_table(self) -> DataFrame:
        """``(file_id, path, content)``, and fingerprints, their regions and ignored ranges as lists if asked for."""
        rows = self.files.select("file_id", "path", "content")
        if not self.config.include_analysis_data:
            none = F.lit(None)
            return rows.select("*", none.cast("array<bigint>").alias("fingerprints"), none.cast("array<array<int>>").alias("fingerprint_regions"), none.cast("array<array<int>>").alias("ignored_intervals"))
        ordered = F.array_sort(F.collect_list(F.struct("idx", "h", "start_row", "start_col", "end_row", "end_col")))
        lists = self.prints.groupBy("file_id").agg(ordered.alias("x")).select("file_id", F.col("x.h").alias("fingerprints"), F.transform("x", lambda f: F.array(f["start_row"], f["start_col"], f["end_row"], f["end_col"])).alias("fingerprint_regions"))
        ranges = self.ignored_ranges().groupBy("file_id").agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("ignored_intervals"))
        both = rows.join(lists, "file_id", "left").join(ranges, "file_id", "left")
        empty = F.array()
        return both.select("file_id", "path", "content", F.coalesce("fingerprints", empty.cast("array<bigint>")).alias("fingerprints"), F.coalesce("fingerprint_regions", empty.cast("array<array<int>>")).alias("fingerprint_regions"), F.coalesce("ignored_intervals", empty.cast("array<array<int>>")).alias("ignored_intervals"))

    def properties(self) -> list[tuple[str, str]]:
        """Settings and what was derived, in a fixed order; what isn't set is the text ``null``."""
        import json

        c = self.config
        none = lambda x: "null" if x is None else str(x)
        flag = lambda x: str(x).lower()
        return [
            ("reportName", self.name), ("createdAt", self.created_at.isoformat().replace("+00:00", "Z")), ("language", self.source.language), ("kgramLength", str(c.kgram_length)),
            ("kgramsInWindow", str(c.kgrams_in_window)), ("minFragmentLength", str(c.min_fragment_length)), ("maxFingerprintFileCount", none(self.cap)), ("maxFingerprintPercentage", none(c.max_fingerprint_percentage)),
            ("template", json.dumps(list(c.template))), ("includeComments", flag(c.include_comments)), ("sortBy", c.sort_by.value), ("fragmentSortBy", c.fragment_sort_by.value), ("fragments", flag(self.has_fragments)),
        ]

    def metadata(self) -> DataFrame:
        return self.files.sparkSession.createDataFrame(self.properties(), "property string, value string")

    def replay(self, i: int, j: int) -> DataFrame:
        """Metrics of a pair from stored fingerprints and ignored ranges only."""
        both = F.col("file_id").isin(i, j)
        return analyze(self.prints.filter(both), self.ignored_ranges().filter(both), self.config.min_fragment_length, ids=self.files.filter(both), check=False).pairs


class Engine:
    """Finds shared passages between files. ``Engine(spark, config).report(paths)``."""

    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()) -> None:
        self.spark, self.config = spark, config

    def report(self, paths: list[str]) -> Report:
        """Reads files and compares every two of them."""
        c = self.config
        log.info("reading files")
        source = read_source(self.spark, paths, c.language)
        for line in source.warnings():
            log.warning(line)
        if c.max_fingerprint_percentage is not None and source.n_files < 3:
            log.warning("a maximum percentage means little for fewer than 3 files")
        template = read_template(self.spark, list(c.template), source.language)
        return self._report(source, template)

    def report_table(self, files: DataFrame, language: str = languages.CHAR, name: str = "table", template: DataFrame | None = None) -> Report:
        """The same for a table ``(file_id, path, content)`` whose ids are dense from 0."""
        return self._report(Source(files, name, languages.from_name(language), files.count(), 0, 0), template)

    def _report(self, source: Source, template: DataFrame | None) -> Report:
        c = self.config
        tokenizer = "char" if source.language == languages.CHAR else source.language.lower()
        if tokenizer != "char" and tokenizer not in TREES:
            raise ValueError(f"there is no tokenizer for {source.language} here; with language 'char' its text is compared")
        log.info("making fingerprints")
        make = lambda files: fingerprints(files, c.kgram_length, c.kgrams_in_window, tokenizer, c.include_comments)
        prints = written(make(source.files), "prints")
        cap = c.file_cap(source.n_files)
        live, ignored = ignore.classified(prints, cap, make(template) if template is not None else None)
        log.info("comparing files")
        found = written(matching.matches(live, c.min_fragment_length), "matches")
        return Report(c, source, source.files, prints, written(ignored, "ignored"), found, datetime.now(timezone.utc), cap)
