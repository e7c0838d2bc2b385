"""Outputs of a report: CSV tables, and text for a terminal."""

from __future__ import annotations

import re
import textwrap
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.api import Report
from textweft.operators.ordering import pair_sort_keys


def report_dir(name: str, created_at: datetime) -> str:
    """``textweft-report-<UTC time>-<name>``; blanks become hyphens, other odd characters go."""
    clean = re.sub(r"[^A-Za-z0-9-]", "", name.replace(" ", "-"))
    return f"textweft-report-{created_at:%Y%m%dT%H%M%S}{created_at.microsecond // 1000:03d}Z-{clean}"


def _listed(column: str) -> F.Column:
    """Nested lists as ``[1,2]`` or ``[[0,1,0,4],...]``; empty field for null."""
    return F.to_json(column)


def _write(df: DataFrame, path: str, single: bool) -> None:
    """One file of a small table if ``single``, else a folder of part files."""
    options = {"header": True, "escape": '"', "quoteAll": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "lineSep": "\n"}
    if not single:
        df.write.options(**options).csv(path)
        return
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    df.coalesce(1).write.options(**options).csv(f"{path}.parts")
    parts, target = jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), jvm.org.apache.hadoop.fs.Path(path)
    fs = parts.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
    fs.rename(part, target)
    fs.delete(parts, True)


def tables(report: Report) -> dict[str, DataFrame]:
    """The report's tables by file name, with the columns and orders that they are written with."""
    files = report.files_table().orderBy("file_id").select(F.col("file_id").alias("id"), "path", "content", _listed("fingerprints").alias("fingerprints"), _listed("fingerprint_regions").alias("fingerprintRegions"), _listed("ignored_intervals").alias("ignoredIntervals"))
    pairs = report.pairs().select("id", F.col("left_id").alias("leftFileId"), F.col("right_id").alias("rightFileId"), "similarity", F.col("longest_fragment").alias("longestFragment"), F.col("overlap_left").alias("overlapLeft"), F.col("overlap_right").alias("overlapRight"), F.col("total_left").alias("totalLeft"), F.col("total_right").alias("totalRight"), F.col("total_overlap").alias("totalOverlap"))
    out = {"metadata.csv": report.metadata(), "files.csv": files, "pairs.csv": pairs}
    if report.has_fragments:
        region = lambda side: F.format_string("[%d,%d,%d,%d]", *(F.col(f"{side}_{n}") for n in ("start_row", "start_col", "end_row", "end_col")))
        out["fragments.csv"] = report.fragments().select(F.col("left_id").alias("leftFileId"), F.col("right_id").alias("rightFileId"), region("left").alias("leftRegion"), region("right").alias("rightRegion"), F.col("fingerprint_count").alias("fingerprintCount"))
    return out


def write_csv(report: Report, directory: str | None = None, single: bool = True) -> str:
    """Writes the tables to a new directory and returns it; an error if it is there already."""
    where = directory or report_dir(report.name, report.created_at)
    spark = report.files.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        raise FileExistsError(f"{where} is there already")
    fs.mkdirs(at)
    for name, df in tables(report).items():
        _write(df, f"{where}/{name}", single)
    return where


def _hundredths(x: F.Column) -> F.Column:
    """``x``, 0 to 100, in hundredths: the double's own value is rounded as C does, a tie to the even one, and not its shortest decimals.

    200 * x is compared with odd numbers in two parts, both of which are exact.
    """
    high = F.floor(x * 2**20) / F.lit(float(2**20))
    a, b = high * 200, (x - high) * 200
    k = F.floor((a + 1) / 2)
    gap = (2 * k + 1).cast("double") - a
    odd = F.pmod(k, F.lit(2)) == 1
    up = (b > gap) | ((b == gap) & odd)
    down = (a == 2 * k - 1) & (b == 0) & odd
    return F.when(up, k + 1).when(down, k - 1).otherwise(k)


def summary_column() -> F.Column:
    """One line of text per pair; needs ``left_path`` and ``right_path``."""
    n = _hundredths(F.col("similarity") * 100)
    return F.format_string("%s - %s (sim: %d.%02d%%, longest: %d, left: %d/%d, right: %d/%d)", "left_path", "right_path", F.floor(n / 100), F.pmod(n, F.lit(100)), "longest_fragment", "overlap_left", "total_left", "overlap_right", "total_right")


def summary(report: Report) -> DataFrame:
    """``(line)`` for every pair, in the report's order."""
    names = report.files.select("file_id", "path")
    pairs = report.pairs()
    joined = pairs.join(names.select(F.col("file_id").alias("left_id"), F.col("path").alias("left_path")), "left_id").join(names.select(F.col("file_id").alias("right_id"), F.col("path").alias("right_path")), "right_id")
    return joined.orderBy(*pair_sort_keys(report.config.sort_by)).select(summary_column().alias("line"))


def char_column(line: str, byte: int) -> int:
    """The character column of a byte column."""
    return len(line.encode()[:byte].decode("utf-8", "ignore"))


def region_lines(content: str, start_row: int, start_col: int, end_row: int, end_col: int, context: int = 1) -> list[tuple[int, str, int, int]]:
    """Line number from 1, text, and the range of characters that belong to the region, with lines around it."""
    lines = content.split("\n")
    if (end_row, end_col) < (start_row, start_col):
        end_row, end_col = start_row, start_col
    out = []
    for i in range(max(0, start_row - context), min(len(lines), end_row + context + 1)):
        line = lines[i].rstrip("\r")
        lo = char_column(line, start_col) if i == start_row else 0
        hi = char_column(line, end_col) if i == end_row else len(line)
        out.append((i + 1, line, lo, hi) if start_row <= i <= end_row else (i + 1, line, 0, 0))
    return out


def side_by_side(left: list[tuple[int, str, int, int]], right: list[tuple[int, str, int, int]], width: int = 120) -> str:
    """Two regions next to each other; what belongs to them is between brackets, long lines are wrapped."""
    half = max(10, (width - 3) // 2)

    def column(lines: list[tuple[int, str, int, int]]) -> list[str]:
        out = []
        for number, line, lo, hi in lines:
            text = f"{line[:lo]}[{line[lo:hi]}]{line[hi:]}" if hi > lo else line
            first, *more = textwrap.wrap(text.expandtabs(4), half - 6, drop_whitespace=False) or [""]
            out += [f"{number:>4}  {first}", *(f"      {m}" for m in more)]
        return out

    a, b = column(left), column(right)
    rows = max(len(a), len(b))
    a, b = a + [""] * (rows - len(a)), b + [""] * (rows - len(b))
    return "\n".join(f"{x:<{half}} | {y}".rstrip() for x, y in zip(a, b, strict=True))


def compare_text(report: Report, width: int = 120) -> str:
    """The fragments of a report with text around them, for a terminal. Meant for two files."""
    files = {r["file_id"]: r for r in report.files.select("file_id", "path", "content").collect()}
    rows = report.fragments().collect()
    out = []
    names = ("start_row", "start_col", "end_row", "end_col")
    for r in rows:
        sides = [region_lines(files[r[f"{s}_id"]]["content"], *(r[f"{s}_{n}"] for n in names)) for s in ("left", "right")]
        out.append(f"{files[r['left_id']]['path']} - {files[r['right_id']]['path']}: {r['fingerprint_count']} fingerprints\n{side_by_side(*sides, width)}")
    out.append(f"Total overlap: {sum(r['fingerprint_count'] for r in rows)}")
    return "\n\n".join(out)


def local_copy(directory: str) -> dict[str, str]:
    """Contents of a report directory on the local disk."""
    return {p.name: p.read_text() for p in Path(directory).iterdir() if p.suffix == ".csv"}
