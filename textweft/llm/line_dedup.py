"""Substring dedup by line hashing.

A unit is a line or, as passages begin and end within lines, a phrase of it: a line is cut before every word that comes before its
neighbours in byte order. Where a cut falls depends on ``REACH`` words on either side only, so a passage that stands in two texts has the
same units in both, but for a few words at its ends. A unit is normalised to its words in lower case and hashed to 128 bits.

Digests are grouped over all documents, and the occurrence that ranks first, by doc_id and then by place, stays. The others are removed
where they make up a passage: runs of neighbouring units that all occur earlier, with at least ``LEAST_WORDS`` words in all. That is
a passage of some 50 words without what its ends lose; a formula that texts share is shorter and stays. Units that a text repeats of
itself make a run only where the first occurrences are neighbours, too, so a text that says one word over and over isn't one long
passage. Spans are code points of the original text.

No unit is compared with another. A first scan counts digests, and a second one sends on the units whose digest occurs again. A text
is never cut: a task holds the words of one slice of texts, or of one text if that is longer, some 100 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweft.llm import textkernel as tk
from textweft.llm.filters import bit_table, member
from textweft.plans.tables import written

LEAST_WORDS = 40
#: Words on either side of which a word must be the least to begin a phrase, and bytes of a word that count for that.
REACH, KEY_BYTES = 3, 8


def _line_bounds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.union1d(off, np.flatnonzero(data == 10) + 1)


def _begins(w: tk.Words) -> np.ndarray:
    """Whether each word begins a phrase; the rows of ``w`` are lines."""
    n, most = len(w.start), np.iinfo(tk.U).max
    padded = np.concatenate([w.data, np.zeros(KEY_BYTES, np.uint8)])
    key = np.zeros(n, tk.U)
    for b in range(KEY_BYTES):
        at = w.start + b
        key = (key << tk.U(8)) | np.where(at < w.end, padded[at], 0).astype(tk.U)
    least = np.ones(n, bool)
    for d in range(1, REACH + 1):
        same = w.row[d:] == w.row[:-d]
        least[d:] &= (key[d:] < key[:-d]) | ~same
        least[:-d] &= (key[:-d] <= key[d:]) | ~same
    least[w.first[:-1][np.diff(w.first) > 0]] = True
    return least


def _phrases(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, number among the row's units, begin, end, words and two hashes of each unit. The units of a line cover it."""
    data, off = tk.raw(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    # lower case may have other lengths, but the same lines and words
    low, low_off = tk.raw(pc.utf8_lower(texts))
    cuts = _line_bounds(low, low_off)
    w = tk.words(pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low))), fold=False)
    line_at = _line_bounds(data, off)
    row_of_line = np.searchsorted(off, line_at[:-1], "right") - 1
    line_end = line_at[1:] - (data[line_at[1:] - 1] == 10)
    first = np.flatnonzero(_begins(w))
    last = np.append(first[1:], len(w.start))
    line = w.row[first]
    opens = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
    begin = np.where(opens, line_at[line], tk.bounds(data, off)[0][first])
    end = np.where(np.append(opens[1:], True), line_end[line], np.append(begin[1:], 0))[: len(line)]
    k1, k2 = tk.range_keys(w, first, last)
    row = row_of_line[line]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    points = tk.code_points(data)
    return row, nth, points[begin] - points[off[row]], points[end] - points[off[row]], last - first, k1.view(np.int64), k2.view(np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, again)``: the distinct first halves of a slice's digests, and whether each occurs twice there."""
    for batch in batches:
        for _, texts in tk.slices(batch["text"]):
            k, n = np.unique(_phrases(texts)[5], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n > 1)], ["k1", "again"])


def _units(width: int, table: np.ndarray):
    """Units whose digest may occur again, by ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tk.slices(batch["text"]):
                row, *rest = _phrases(texts)
                some = np.flatnonzero(member(table, rest[4] & ((1 << width) - 1)))
                ids = batch["doc_id"].take(pa.array(row[some] + at))
                ints = [pa.array(x[some].astype(np.int32)) for x in rest[:4]]
                yield pa.RecordBatch.from_arrays([ids, *ints, *(pa.array(x[some]) for x in rest[4:])], ["doc_id", "nth", "start", "end", "words", "k1", "k2"])

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, start, end, words, units, first_doc_id, first_start)`` of every removed passage of ``docs(doc_id, text, ...)``.

    ``first_*`` is where the passage's first unit stays. Null and empty texts have no units. Rows that share a doc_id are one document:
    equal units at equal places are one occurrence. Rows without a doc_id rank first, as one document, and nothing is removed from
    them. Other columns are ignored. An empty table gives an empty one.
    """
    tk.small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = own.select("text").mapInArrow(_digests, "k1 long, again boolean").groupBy("k1").agg((F.count("*") + F.max(F.col("again").cast("int"))).alias("n"))
    # the key is a hash already: its low bits are its place
    wanted = written(counted.filter("n > 1").select("k1"), "digests")
    width, table = bit_table(wanted, "k1", hashed=True)
    units = written(own.mapInArrow(_units(width, table), f"doc_id {id_type}, nth int, start int, end int, words int, k1 long, k2 long"), "units")
    place = F.struct("doc_id", "start", "nth")
    groups = units.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = groups.filter(~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) | (F.col("first.start") < F.col("last.start"))).select("k1", "k2", "first")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
    again = units.filter("doc_id is not null").join(written(groups, "repeated"), ["k1", "k2"]).filter(later)
    again = again.select("doc_id", "nth", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), F.col("first.nth").alias("first_nth")).distinct()
    order = Window.partitionBy("doc_id").orderBy("nth", "start", "end")
    before = lambda c: F.lag(c).over(order)
    of_itself = F.coalesce((F.col("first_doc_id") == F.col("doc_id")) & (before("first_doc_id") == F.col("doc_id")), F.lit(False))
    opens = F.coalesce((F.col("nth") > before("nth") + 1) | (of_itself & (F.col("first_nth") != before("first_nth") + 1)), F.lit(True))
    runs = again.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order))
    first = F.min(F.struct("nth", "start", "end", "first_doc_id", "first_start"))
    passages = runs.groupBy("doc_id", "run").agg(F.min("start").cast("bigint").alias("start"), F.max("end").cast("bigint").alias("end"), F.sum("words").alias("words"), F.count("*").alias("units"), first.alias("f"))
    return passages.filter(F.col("words") >= least_words).select("doc_id", "start", "end", "words", "units", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_start").cast("bigint").alias("first_start"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without some spans, and without the line break after lines that go whole."""
    parts, done = [], 0
    for start, end in sorted(spans):
        start = max(start, done)
        if (start == 0 or text[start - 1] == "\n") and text[end : end + 1] == "\n":
            end += 1
        parts.append(text[done:start])
        done = max(done, end)
    return "".join([*parts, text[done:]])


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; ``n_chars`` follows, if there is one."""
    names = docs.columns
    cuts = "cuts"
    while cuts in names:
        cuts = f"_{cuts}"
    spans = repeated_passages(docs, least_words).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias(cuts))
    both = docs.join(written(spans, "cuts"), "doc_id", "left").select(*names, cuts)
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, found = columns[at].to_pylist(), columns.pop().to_pylist()
            sizes = columns[size].to_pylist() if size is not None else None
            for i, cut in enumerate(found):
                if cut and texts[i] is not None:
                    texts[i] = _cut(texts[i], [(c["start"], c["end"]) for c in cut])
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes is not None:
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, T.StructType(docs.schema.fields))


def oracle_sql(least_words: int = LEAST_WORDS) -> str:
    """The rows of ``repeated_passages`` in SQL for another engine, for tables of distinct doc_ids that aren't null."""
    other = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F"
    near = range(1, REACH + 1)
    before = " AND ".join(f"(lag(key, {d}) OVER o IS NULL OR key < lag(key, {d}) OVER o)" for d in near)
    after = " AND ".join(f"(lead(key, {d}) OVER o IS NULL OR key <= lead(key, {d}) OVER o)" for d in near)
    return f"""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, i, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS line_start, length(line) AS line_length, regexp_extract_all(line, '[^{other}]+[{other}]*') AS w, length(regexp_extract(line, '^[{other}]*')) AS lead_length FROM l),
t AS (SELECT doc_id, i, line_start, line_length, lead_length, unnest(w) AS piece, unnest(range(1, len(w) + 1)) AS j FROM p),
k AS (SELECT doc_id, i, j, line_start, line_length, lead_length, length(piece) AS size, lower(regexp_replace(piece, '[{other}]*$', '')) AS word FROM t),
b AS (SELECT *, array_slice(encode(word), 1, {KEY_BYTES}) AS key FROM k),
m AS (SELECT *, j = 1 OR ({before} AND {after}) AS begins, lead_length + sum(size) OVER o - size AS place FROM b WINDOW o AS (PARTITION BY doc_id, i ORDER BY j)),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS nth FROM m),
v AS (SELECT doc_id, i, nth::BIGINT AS nth, line_start + min(CASE WHEN j = 1 THEN 0 ELSE place END)::BIGINT AS start, line_start + line_length AS line_end, count(*)::BIGINT AS words, string_agg(word, ' ' ORDER BY j) AS text FROM n GROUP BY doc_id, i, nth, line_start, line_length),
u AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id, i ORDER BY nth), line_end)::BIGINT AS "end" FROM v),
f AS (SELECT text, min(doc_id) AS first_doc_id FROM u GROUP BY text HAVING count(*) > 1),
g AS (SELECT u.text, first_doc_id, min(start) AS first_start, min(nth) AS first_nth FROM u JOIN f ON u.text = f.text AND u.doc_id = f.first_doc_id GROUP BY u.text, first_doc_id),
a AS (SELECT u.doc_id, nth, start, "end", words, first_doc_id, first_start, first_nth FROM u JOIN g ON u.text = g.text WHERE u.doc_id <> first_doc_id OR start <> first_start),
r AS (SELECT *, CASE WHEN lag(nth) OVER o IS NULL OR nth > lag(nth) OVER o + 1 OR (first_doc_id = doc_id AND lag(first_doc_id) OVER o = doc_id AND first_nth <> lag(first_nth) OVER o + 1) THEN 1 ELSE 0 END AS opens FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY nth)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r)
SELECT doc_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", sum(words)::BIGINT AS words, count(*)::BIGINT AS units, arg_min(first_doc_id, nth) AS first_doc_id, arg_min(first_start, nth)::BIGINT AS first_start FROM s GROUP BY doc_id, run HAVING sum(words) >= {least_words}"""
