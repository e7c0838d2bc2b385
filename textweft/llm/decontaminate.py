"""Benchmark decontamination by SimHash windows of the items' sizes, a multi-index over Hamming blocks and exact verification.

Item and window are multisets of five-word shingles (one shingle of all its words where an item is shorter). An item
contaminates a text if some window of as many words as the item, or all of a text that has fewer, has a weighted Jaccard, the sum of the smaller counts over the
sum of the larger, of at least the threshold.

1. *Regions.* A window that reaches the threshold shares a shingle with its item. One pass over the texts looks every shingle up in
   tables of bits of all the benchmark's shingles, one for each size of items by powers of two, and keeps the words around hits; all
   else can hold no match. What it writes is small next to the corpus.
2. *Fingerprints.* In a region, every window of the size of an item that has a hit there gets a 64-bit SimHash of its weighted
   shingles, from running sums of votes.
3. *Multi-index.* Fingerprints are cut into four 16-bit blocks. Two fingerprints within a Hamming radius r agree in some block up
   to ``r // 4`` bits, so an index that holds each item block under every value within that distance returns all items within
   the radius.
4. *Verification.* Candidates are verified by their exact weighted Jaccard.

The corpus is read once. Regions are searched with the benchmark in blocks of a bounded number of bytes, one after another; within a
block the index is built for a bounded number of items at a time, of those that share a shingle with the regions at hand. So memory
has a bound for any benchmark, and no part of it is left out. A text is never cut: a task holds the words of one slice of texts, or of
one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.llm import textkernel as tk
from textweft.llm.filters import member
from textweft.plans.tables import new_path, written

THRESHOLD = 0.8
#: Bits that a window's fingerprint may differ from its item's. At the threshold 10 of 64 differ on average, with a deviation of 3.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Bytes of benchmark texts that one pass over the regions takes along.
BENCHMARK_BYTES = 16 << 20
#: Items that one index holds, and bits of a table of shingles, as powers of two.
INDEX_ITEMS, LEAST_BITS, TABLE_BITS = 512, 20, 24


class Items(NamedTuple):
    """Some benchmark items. ``el[cut[i]:cut[i + 1]]`` are the sorted shingles of item i, ``wt`` their counts; ``size`` its words."""

    ids: np.ndarray
    size: np.ndarray
    cut: np.ndarray
    el: np.ndarray
    wt: np.ndarray


def items_of(ids: list, texts: list[str | None], k: int = tk.SHINGLE) -> Items:
    """Items that have a word; an id that occurs twice is two items."""
    column = pa.array(texts, pa.large_string())
    els, wts, counts, sizes, kept = [np.zeros(0, tk.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, part in tk.slices(column):
        w = tk.words(part)
        el, row, wt = tk.weighted(*tk.shingles(w, k))
        size = np.diff(w.first)
        some = np.flatnonzero(size)
        els.append(el)
        wts.append(wt)
        counts.append(np.bincount(row, minlength=len(part))[some])
        sizes.append(size[some])
        kept.append(some + at)
    cut = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return Items(np.array(ids, dtype=object)[np.concatenate(kept)], np.concatenate(sizes), cut, np.concatenate(els), np.concatenate(wts))


def _bits(h: np.ndarray) -> np.ndarray:
    """Votes of +1 and -1 of each shingle for each of 64 bits."""
    spread = tk.mix(h, 64)
    return np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprint(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).view(np.uint64).reshape(-1)


class MultiIndex:
    """All fingerprints within ``radius`` bits of a query, by blocks. ``find`` gives (query, item) pairs, each once."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius = prints, radius
        near = [0]
        for n in range(1, min(radius // BLOCKS, BLOCK_BITS) + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), n)]
        flips = np.array(near, np.uint16)
        self.tables = []
        for block in self._blocks(prints):
            values = (block[:, None] ^ flips[None, :]).reshape(-1)
            who = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), who[order]))

    @staticmethod
    def _blocks(prints: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(x) for x in np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS).T]

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = []
        for block, (cut, who) in zip(self._blocks(queries), self.tables, strict=True):
            lo = cut[block.astype(np.int64)]
            n = cut[block.astype(np.int64) + 1] - lo
            query = np.repeat(np.arange(len(queries)), n)
            at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            item = who[at]
            close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
            pairs.append(query[close] * len(self.prints) + item[close])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.prints), found % len(self.prints)


class Table(NamedTuple):
    """Bits of the shingles of ``n`` words that items of at most ``longest`` words have, by the low and by the high bits of the key."""

    n: int
    longest: int
    width: int
    low: np.ndarray
    high: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that may be in the table: of all others one in some thousands or, in a full table, hundreds."""
        maybe = np.flatnonzero(member(self.low, keys & ((1 << self.width) - 1)))
        return maybe[member(self.high, keys[maybe] >> (48 - self.width))]


def _item_keys(k: int):
    """``(n, grade, key)`` of each item's shingles: their words, the power of two that bounds the item's words, and 48 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tk.slices(batch["text"]):
                w = tk.words(texts)
                h, row = tk.shingles(w, k)
                size = np.diff(w.first)[row]
                grade = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(size, k).astype(np.int32)), pa.array(grade), pa.array((h >> tk.U(16)).view(np.int64))], ["n", "grade", "key"])

    return run


def shingle_tables(items: DataFrame, k: int = tk.SHINGLE) -> list[Table]:
    """Tables for a pass over the texts, of all of ``items(text)``: one for each size of items, by powers of two."""
    keys = written(items.select("text").mapInArrow(_item_keys(k), "n int, grade int, key long").distinct(), "item-keys")
    kinds = {(r["n"], r["grade"]): r["keys"] for r in keys.groupBy("n", "grade").agg(F.count("*").alias("keys")).collect()}  # k + 30 at most
    tables = {(n, g): Table(n, 1 << g, w := max(LEAST_BITS, min(TABLE_BITS, (64 * c).bit_length())), *np.zeros((2, 1 << (w - 6)), np.int64)) for (n, g), c in kinds.items()}
    width = " ".join(f"when n = {n} and grade = {g} then {t.width}" for (n, g), t in tables.items())
    if not tables:
        return []
    wide = keys.withColumn("w", F.expr(f"case {width} end"))
    place = wide.select("n", "grade", F.explode(F.array(F.expr("key & (shiftleft(1L, w) - 1)"), F.expr("shiftright(key, 48 - w) | shiftleft(1L, w)"))).alias("place"), "w")
    place = place.select("n", "grade", F.expr("shiftright(place, w)").alias("half"), F.expr("shiftright(place & (shiftleft(1L, w) - 1), 6)").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = place.groupBy("n", "grade", "half", "word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 << (TABLE_BITS - 6) for each kind at most
    kind = np.stack([found[c].to_numpy() for c in ("n", "grade", "half")]) if found.num_rows else np.zeros((3, 0))
    for (n, g), t in tables.items():
        for half, bits in enumerate((t.low, t.high)):
            own = np.flatnonzero((kind[0] == n) & (kind[1] == g) & (kind[2] == half))
            bits[found["word"].to_numpy()[own]] = found["bits"].to_numpy()[own]
    return [t._replace(low=t.low.view(np.uint8), high=t.high.view(np.uint8)) for _, t in sorted(tables.items())]


def _hits(w: tk.Words, tables: list[Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word where a hit begins, its words, and the words of the longest item that may have the shingle."""
    at_all, n_all, long_all = ([np.zeros(0, np.int64)] for _ in range(3))
    for n in sorted({t.n for t in tables}):
        h, at = tk.grams(w, n)
        h = (h >> tk.U(16)).view(np.int64)
        for t in tables:
            if t.n == n:
                hit = at[t.has(h)]
                at_all.append(hit)
                n_all.append(np.full(len(hit), n))
                long_all.append(np.full(len(hit), t.longest))
    return np.concatenate(at_all), np.concatenate(n_all), np.concatenate(long_all)


def _regions(tables: list[Table]):
    """Words around hits, as rows (doc_id, hashes, begins, ends); begins and ends are code points of each word in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tk.slices(batch["text"]):
                w = tk.words(texts)
                hit, n, longest = _hits(w, tables)
                if not len(hit):
                    continue
                row = w.row[hit]
                lo = np.maximum(hit + n - longest, w.first[row])
                hi = np.minimum(hit + longest, w.first[row + 1])
                order = np.argsort(lo, kind="stable")
                row, lo, hi = row[order], lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.concatenate([[True], (lo[1:] >= hi[:-1]) | (row[1:] != row[:-1])]))
                first, last = lo[new], np.append(hi[new[1:] - 1], hi[-1])
                points = tk.code_points(w.data)
                docs, hashes, begins, ends = [], [], [], []
                text_start = _row_starts(w, texts)
                for a, b, r in zip(first, last, row[new], strict=True):
                    docs.append(r + at)
                    hashes.append(w.hash[a:b].tobytes())
                    begins.append((points[w.start[a:b]] - points[text_start[r]]).astype("<i8").tobytes())
                    ends.append((points[w.end[a:b]] - points[text_start[r]]).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(docs)), *(pa.array(x, pa.binary()) for x in (hashes, begins, ends))], ["doc_id", "hashes", "begins", "ends"])

    return run


def _row_starts(w: tk.Words, texts: pa.Array) -> np.ndarray:
    """Bytes of ``w.data`` where each row begins; lower case may have other lengths than the text itself."""
    return np.concatenate([[0], np.cumsum(pc.binary_length(pc.utf8_lower(texts)).to_numpy(zero_copy_only=False))]).astype(np.int64)


@lru_cache(4)
def _index(key: bytes, radius: int) -> MultiIndex:
    return MultiIndex(np.frombuffer(key, np.uint64), radius)


def item_prints(items: Items) -> np.ndarray:
    votes = _bits(items.el) * items.wt[:, None].astype(np.int32)
    return _fingerprint(np.add.reduceat(votes, items.cut[:-1], axis=0)) if len(items.size) else np.zeros(0, np.uint64)


def weighted_jaccard(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts; elements sorted and distinct."""
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def matches_in(hashes: np.ndarray, items: Items, prints: np.ndarray, threshold: float, radius: int, k: int) -> list[tuple[int, int, int, float, int]]:
    """Of a region's words: (item, first word, words, similarity, Hamming distance) of each item's best window, the first of equals."""
    n = len(hashes)
    one = tk.Words(None, None, None, np.array([0, n]), np.zeros(n, np.int64), hashes)
    best: dict[int, tuple[float, int, int]] = {}
    owner = np.repeat(np.arange(len(items.size)), np.diff(items.cut))
    sizes = {int(x) for x in items.size if x < k}
    sizes |= {int(x) for x in np.unique(items.size[owner[np.isin(items.el, tk.grams(one, k)[0] >> tk.U(16))]])}
    index = _index(prints.tobytes(), radius)
    for size in sorted(s for s in sizes if s <= n):
        h = tk.grams(one, min(size, k))[0] >> tk.U(16)
        wide = max(1, size - k + 1)
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(h), axis=0, dtype=np.int32)])
        window_prints = _fingerprint(sums[wide:] - sums[:-wide])
        query, item = index.find(window_prints)
        right = items.size[item] == size
        for q, j in zip(query[right].tolist(), item[right].tolist(), strict=True):
            el, wt = np.unique(h[q : q + wide], return_counts=True)
            own = slice(items.cut[j], items.cut[j + 1])
            s = weighted_jaccard(el, wt, items.el[own], items.wt[own])
            if s >= threshold and (j not in best or s > best[j][0]):
                best[j] = (s, q, int(np.bitwise_count(window_prints[q] ^ prints[j])))
    # a region of fewer words than an item that it shares a shingle with is all of its text
    h = tk.grams(one, k)[0] >> tk.U(16)
    longer = np.unique(owner[np.isin(items.el, h)])
    longer = longer[(items.size[longer] > n) & (n - k + 1 >= threshold * (items.size[longer] - k + 1) - 1e-9)]
    if len(longer):
        el, wt = np.unique(h, return_counts=True)
        whole = _fingerprint(_bits(h).sum(axis=0, dtype=np.int32)[None, :])[0]
        for j in longer.tolist():
            own = slice(items.cut[j], items.cut[j + 1])
            s = weighted_jaccard(el, wt, items.el[own], items.wt[own])
            if s >= threshold:
                best[j] = (s, 0, int(np.bitwise_count(whole ^ prints[j])))
    return [(j, q, min(n, int(items.size[j])), s, d) for j, (s, q, d) in sorted(best.items())]


def _parts(regions: list[np.ndarray], items: Items, most: int, k: int) -> Iterator[Items]:
    """Items that an index is made of: all if they are few, else those that share a shingle with some region, ``most`` at a time."""
    n = len(items.size)
    if n <= most:
        yield items
        return
    shared = np.zeros(len(items.el), bool)
    for h in regions:
        one = tk.Words(None, None, None, np.array([0, len(h)]), np.zeros(len(h), np.int64), h)
        for size in (*{int(x) for x in items.size if x < k}, k):
            shared |= np.isin(items.el, tk.grams(one, size)[0] >> tk.U(16))
    owner = np.repeat(np.arange(n), np.diff(items.cut))
    some = np.unique(owner[shared])
    for at in range(0, len(some), most):
        own = some[at : at + most]
        place = np.concatenate([np.arange(items.cut[i], items.cut[i + 1]) for i in own])
        yield Items(items.ids[own], items.size[own], np.concatenate([[0], np.cumsum(np.diff(items.cut)[own])]), items.el[place], items.wt[place])


def _search(items: Items, item_type: pa.DataType, threshold: float, radius: int, k: int, index_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, begin, end, similarity, bits = [], [], [], [], [], []
            hashes, begins, ends = ([np.frombuffer(x, kind) for x in batch[c].to_pylist()] for c, kind in (("hashes", np.uint64), ("begins", "<i8"), ("ends", "<i8")))
            for part in _parts(hashes, items, index_items, k):
                prints = item_prints(part)
                for i, h in enumerate(hashes):
                    for j, at, n, s, d in matches_in(h, part, prints, threshold, radius, k):
                        doc.append(i)
                        item.append(part.ids[j])
                        begin.append(int(begins[i][at]))
                        end.append(int(ends[i][at + n - 1]))
                        similarity.append(s)
                        bits.append(d)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc, pa.int64())), pa.array(item, item_type), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(similarity, pa.float64()), pa.array(bits, pa.int32())], ["doc_id", "item_id", "start", "end", "similarity", "hamming"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, k: int = tk.SHINGLE, benchmark_bytes: int = BENCHMARK_BYTES, index_items: int = INDEX_ITEMS) -> DataFrame:
    """``(doc_id, item_id, start, end, similarity, hamming)``: the best window of each item in each region, as code points.

    Only texts that have a match have rows. Null and empty texts, and items without a word, match nothing. Rows without a
    doc_id or item_id take part, with null as id. Repeated rows of documents and items of equal id have a result each;
    ``best_windows`` makes one of them. Other columns of either table are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    tk.small_batches(spark)
    doc_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    own = benchmark.select("item_id", "text").filter("text is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n_blocks = -(-size // benchmark_bytes)
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, start long, end long, similarity double, hamming int"
    if not n_blocks:
        return spark.createDataFrame([], schema)
    texts = docs.select("doc_id", "text").filter("text is not null")
    found = written(texts.mapInArrow(_regions(shingle_tables(own, k)), f"doc_id {doc_type.simpleString()}, hashes binary, begins binary, ends binary"), "regions")
    # a block's matches go to one table, so the plan is the same for any number of blocks
    where = new_path(spark, "windows")
    for block in range(n_blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()  # about benchmark_bytes
        items = items_of([r["item_id"] for r in rows], [r["text"] for r in rows], k)
        found.mapInArrow(_search(items, to_arrow_type(item_type), threshold, radius, k, index_items), schema).write.mode("append").parquet(where)
    return spark.read.schema(schema).parquet(where)


def best_windows(found: DataFrame) -> DataFrame:
    """One row per document and item of what ``contaminated`` gives: the most similar window, then the first."""
    order = F.struct(-F.col("similarity"), "start", "end", "hamming")
    return found.groupBy("doc_id", "item_id").agg(F.min(order).alias("m")).select("doc_id", "item_id", "m.start", "m.end", (-F.col("m.col1")).alias("similarity"), "m.hamming")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no contaminated text; rows without a doc_id stay."""
    bad = written(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
