"""Inputs: a directory, a CSV manifest, an archive, or files; as ``(file_id, path, content)``.

Listing and contents are read by Spark, so paths may be in any store it knows. File ids are dense from 0 in order of path, counted
without collecting paths: each partition of the sorted table adds the sizes of those before it.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweft import languages
from textweft.plans.tables import written

ARCHIVES = (".tar.gz", ".tar.bz2", ".tgz", ".tbz2", ".tbz", ".zip", ".tar")


class InvalidInput(ValueError):
    """The inputs can't be analysed together."""


@dataclass(frozen=True)
class Resolved:
    """``files(path, bytes)`` below ``base``, and a name for them."""

    files: DataFrame
    name: str


class Kind(NamedTuple):
    directory: bool
    file: bool


def _kind(spark: SparkSession, path: str) -> Kind:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return Kind(False, False)
    status = fs.getFileStatus(at)
    return Kind(status.isDirectory(), status.isFile())


def _absolute(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString().rstrip("/")


def _plain(uri: str) -> str:
    return uri.removeprefix("file:") if uri.startswith("file:/") else uri


def _binary(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(list(paths)).select(F.col("path").alias("uri"), F.col("content").alias("bytes"))


def _relative(files: DataFrame, base: str) -> DataFrame:
    """Paths below ``base`` lose it; others stay whole."""
    # Spark gives file:/x where Hadoop qualifies file:/x or file:///x
    uri = F.regexp_replace("uri", "^file:/+", "/")
    start = ("/" + base.split("file:", 1)[1].lstrip("/") if base.startswith("file:") else base).rstrip("/") + "/"
    path = F.when(uri.startswith(start), F.substring(uri, F.lit(len(start) + 1), F.length(uri))).otherwise(uri)
    return files.select(path.alias("path"), "bytes")


def _hadoop_name(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:/") else path


def is_archive(path: str) -> bool:
    return path.lower().endswith(ARCHIVES)


def archive_members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of a zip or tar archive. Members whose names lead out of the archive are an error."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield _safe(info.filename), z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                if info.isfile():
                    yield _safe(info.name), t.extractfile(info).read()


def _safe(name: str) -> str:
    path = PurePosixPath(name)
    if path.is_absolute() or ".." in path.parts:
        raise InvalidInput(f"{name!r} leads out of the archive")
    return str(path)


def _from_archive(spark: SparkSession, path: str) -> Resolved:
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, content in zip(batch["uri"], batch["bytes"], strict=True):
                for member, data in archive_members(uri, content):
                    yield pd.DataFrame({"path": [member], "bytes": [data]})

    members = _binary(spark, path).mapInPandas(unpack, "path string, bytes binary")
    end = next(e for e in ARCHIVES if path.lower().endswith(e))
    name = PurePosixPath(path).name[: -len(end)]
    manifest = members.filter("path = 'info.csv'").select("bytes").head(1)
    if manifest:
        wanted = manifest_names(bytes(manifest[0]["bytes"]).decode())
        members = members.join(spark.createDataFrame([(str(PurePosixPath(w)),) for w in wanted], "path string").distinct(), "path", "left_semi")
    return Resolved(members, name)


def manifest_names(text: str) -> list[str]:
    """The ``filename`` column of a manifest; the header must have exactly that name."""
    import csv

    rows = list(csv.reader(io.StringIO(text)))
    if not rows or "filename" not in rows[0]:
        raise InvalidInput("the manifest has no column called filename")
    at = rows[0].index("filename")
    if any(len(r) != len(rows[0]) for r in rows[1:] if r):
        raise InvalidInput("a row of the manifest has another number of fields than its header")
    return [r[at] for r in rows[1:] if r]


def _from_manifest(spark: SparkSession, path: str, name: str) -> Resolved:
    base = _absolute(spark, path).rpartition("/")[0]
    content = _binary(spark, path).select("bytes").head(1)[0]["bytes"]
    names = manifest_names(bytes(content).decode())
    paths = [n if n.startswith("/") or "://" in n else f"{base}/{n}" for n in names]
    missing = [p for p in paths if not _kind(spark, p).file]
    if missing:
        raise FileNotFoundError(f"'{missing[0]}' is not a file")
    if not paths:
        return Resolved(spark.createDataFrame([], "path string, bytes binary"), name)
    return Resolved(_relative(_binary(spark, *paths), base), name)


def resolve(spark: SparkSession, paths: list[str], single_file: bool = False) -> Resolved:
    """What some paths stand for. One directory, manifest (``.csv``, in lower case) or archive, in this order; or files.

    A directory with an ``info.csv`` of its own is what that manifest names. A single file is one only for a template.
    """
    if not paths:
        raise InvalidInput("no input paths given")
    if len(paths) == 1:
        path = paths[0]
        kind = _kind(spark, path)
        if kind.directory:
            name = PurePosixPath(_plain(_absolute(spark, path))).name
            if _kind(spark, f"{path.rstrip('/')}/info.csv").file:
                return _from_manifest(spark, f"{path.rstrip('/')}/info.csv", name)
            return Resolved(_relative(_binary(spark, path, recursive=True), _absolute(spark, path)), name)
        if kind.file and path.endswith(".csv"):
            return _from_manifest(spark, path, PurePosixPath(_plain(_absolute(spark, path))).parent.name)
        if kind.file and is_archive(path):
            return _from_archive(spark, path)
        if kind.file and not single_file:
            raise InvalidInput(f"'{path}' is one file; there must be two at least to compare")
    for p in paths:
        if not _kind(spark, p).file:
            raise FileNotFoundError(f"'{p}' is not a file")
    names = [PurePosixPath(p).name for p in paths]
    given = {_hadoop_name(_absolute(spark, p)): p for p in paths}
    known = spark.createDataFrame(list(given.items()), "uri string, path string")
    files = _binary(spark, *given.values()).withColumn("uri", F.regexp_replace("uri", "^file:/+", "/")).join(known, "uri").select("path", "bytes")
    return Resolved(files, "-".join(names) if len(names) == 2 else f"{len(names)} files")


@dataclass(frozen=True)
class Source:
    """Files to compare, with dense ids, and what was left out."""

    files: DataFrame
    name: str
    language: str
    n_files: int
    skipped: int
    unreadable: int

    def warnings(self) -> list[str]:
        out = []
        if self.skipped:
            out.append(f"{self.skipped} file{'s' if self.skipped != 1 else ''} skipped: not {self.language}")
        if self.unreadable:
            out.append(f"{self.unreadable} file{'s' if self.unreadable != 1 else ''} skipped: not valid UTF-8")
        return out


def with_file_ids(files: DataFrame) -> DataFrame:
    """``(file_id, path, content)`` of ``files(path, content)`` in order of path."""
    ordered = written(files.orderBy("path").select("path", "content", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "files")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_seq") - F.shiftleft(F.col("_part").cast("bigint"), 33) + F.col("_before")
    return ordered.join(before, "_part").select(place.cast("bigint").alias("file_id"), "path", "content")


def _decoded(resolved: Resolved, language: str) -> tuple[DataFrame, int, int]:
    """Files of a language with valid contents; the number of others, and of files that aren't UTF-8."""
    extensions = languages.LANGUAGES[language][1]
    marked = written(resolved.files.select("path", "bytes", languages.extension_column(F.col("path")).isin(*extensions).alias("right"), F.is_valid_utf8(F.col("bytes").cast("string")).alias("valid")), "read")
    counts = marked.agg(F.count_if(~F.col("right")).alias("skipped"), F.count_if(F.col("right") & ~F.col("valid")).alias("unreadable")).first()
    good = marked.filter("right and valid").select("path", F.decode("bytes", "UTF-8").alias("content"))
    return good, counts["skipped"], counts["unreadable"]


def read_source(spark: SparkSession, paths: list[str], language: str | None = None) -> Source:
    """Reads what is to be compared; at least two files of the language must remain."""
    resolved = resolve(spark, paths)
    chosen = languages.from_name(language) if language else languages.detect(resolved.files)
    good, skipped, unreadable = _decoded(resolved, chosen)
    files = written(with_file_ids(good), "source")
    n = files.count()
    if n < 2:
        raise InvalidInput(f"need at least 2 {chosen} files to compare")
    return Source(files, resolved.name, chosen, n, skipped, unreadable)


def read_template(spark: SparkSession, paths: list[str], language: str) -> DataFrame | None:
    """``(file_id, path, content)`` of template files of the language; None without paths. No file left is no error."""
    if not paths:
        return None
    good, _, _ = _decoded(resolve(spark, paths, single_file=True), language)
    return with_file_ids(good)
