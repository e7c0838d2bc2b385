"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the multiset of its five-word shingles (one shingle of all its words where there are fewer), a weight being the
number of occurrences. The similarity is the probability Jaccard: the sum over shared d of
``1 / sum_x max(a[x] / a[d], b[x] / b[d])``, which is plain Jaccard when no shingle repeats.

*Signature.* Every shingle is a Poisson process whose rate is its weight; each arrival goes to a random register, and a
register keeps the shingle of its earliest arrival. Arrivals after a time limit can't matter once all registers are full,
so each shingle stops there; where a register is still empty the limit is raised for that text. Two texts agree in a register
with a probability equal to their similarity.

*Candidates.* Texts of equal word sequences are one representative. Representatives that agree in all rows of a band meet.

*Verification.* No group is expanded into pairs. In each band group every member is verified against one hub, the member that
meets most others over all its bands; linked members become one class. What is left are members of a group whose classes differ. Of them
a pair is verified unless one of two bounds proves that it can't reach the threshold. ``1 - similarity`` is a metric, so
``|d(x, hub) - d(y, hub)| <= 1 - threshold`` must hold; a document of several texts has no one distance and is not bound by it. And every bit that a bitmap of x's shingles has and y's has not stands for a
shingle that only x has; such shingles' share of x's weight is at most ``1 - similarity``, and among sets without repeats they bound
plain Jaccard. So the classes are the connected components of all candidate pairs whose exact similarity reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.llm import textkernel as tk
from textweft.llm.components import components
from textweft.llm.filters import bit_table, member, place_of
from textweft.plans.tables import written

THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: Bits of a text's bitmap, and texts that are signed at a time.
BITMAP, SIGNED_ROWS = 2048, 4096


def prob_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Signatures ``(n_rows, registers)`` of weighted sets given as parallel arrays; zeros for an empty set."""
    signature = np.zeros((n_rows, registers), tk.U)
    totals = np.bincount(row, weight, n_rows)
    todo = totals > 0
    stretch = np.log(registers) + 3
    while todo.any():
        limit = np.zeros(n_rows)
        limit[todo] = registers * stretch / totals[todo]
        active = np.flatnonzero(todo[row])
        time = np.zeros(len(active))
        best = np.full(n_rows * registers, np.inf)
        who = np.full(n_rows * registers, -1)
        step = 0
        while len(active):
            bits = tk.mix(element[active], 100 + step)
            u = ((bits >> tk.U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / weight[active]
            alive = time <= limit[row[active]]
            active, time = active[alive], time[alive]
            slot = row[active] * registers + (tk.mix(bits[alive], 7) % tk.U(registers)).astype(np.int64)
            np.minimum.at(best, slot, time)
            first = time == best[slot]
            who[slot[first]] = active[first]
            step += 1
        full = np.flatnonzero(who >= 0)
        signature.reshape(-1)[full] = element[who[full]] + tk.U(1)
        todo &= np.isinf(best.reshape(n_rows, registers)).any(axis=1)
        stretch *= 3
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; keys of different bands differ."""
    s = signature.reshape(len(signature), bands, rows)
    key = np.zeros(s.shape[:2], tk.U) + np.arange(1, bands + 1, dtype=tk.U)
    for i in range(rows):
        key = tk.mix(key ^ s[:, :, i], i)
    return key.view(np.int64)


def probability_jaccard(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets, elements sorted and distinct; 0 if one is empty."""
    common, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(common) / (len(ea) + len(eb) - len(common))
    a, b = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # of x at or after d the term is a[x] / a[d], before d it is b[x] / b[d]; equal ratios agree in both
    after = np.cumsum(a[::-1])[::-1] + only_a
    before = np.concatenate([[0.0], np.cumsum(b)[:-1]]) + only_b
    return float((1 / (after / a + before / b)).sum())


def _pack(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _signatures(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tk.slices(batch["text"], rows=SIGNED_ROWS):
                w = tk.words(texts)
                n = len(texts)
                signature = prob_minhash(*_parts(w, k), n, bands * rows)
                k1, k2 = tk.sequence_keys(w)
                none = np.diff(w.first) == 0
                keys = pa.array(band_keys(signature, bands, rows).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, n), pa.array(k1.view(np.int64), mask=none), pa.array(k2.view(np.int64), mask=none),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), keys)],
                    ["doc_id", "k1", "k2", "bands"])
    return run


def _parts(w: tk.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tk.weighted(*tk.shingles(w, k))


def _sets(k: int, table: np.ndarray):
    """Sets of the rows whose ``place`` has a bit in ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch["place"].to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(member(table, place)))
            for at, texts in tk.slices(batch["text"]):
                e, row, count = _parts(tk.words(texts), k)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                packed = _pack(e)
                el = [packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                # without repeats the weights are all one, and none are sent
                n = np.bincount(row, minlength=len(texts))
                total = np.bincount(row, count, len(texts)).astype(np.int64)
                wt = [b"" if (c := count[a:b]).max(initial=1) == 1 else c.astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (BITMAP // 64))
                bits = pa.ListArray.from_arrays(offsets, pa.array(_bitmaps(e, row, len(texts)).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), pa.array(el, pa.binary()), pa.array(wt, pa.binary()), pa.array(n), pa.array(total), bits], ["id", "el", "wt", "n", "total", "bits"])

    return run


def _bitmaps(e: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """A bit for each shingle, as signed words ``(n_rows, BITMAP // 64)``."""
    bits = np.zeros((n_rows, BITMAP), np.uint8)
    bits[row, (tk.mix(e, 9) % tk.U(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _may_reach(threshold: float) -> str:
    """SQL for pairs x, y whose bitmaps don't prove a similarity below the threshold."""
    words = range(BITMAP // 64)
    only_x = " + ".join(f"bit_count(x.bits[{i}] & ~y.bits[{i}])" for i in words)
    only_y = " + ".join(f"bit_count(y.bits[{i}] & ~x.bits[{i}])" for i in words)
    least = threshold - 1e-9
    share = f"x.total - ({only_x}) >= {least} * x.total and y.total - ({only_y}) >= {least} * y.total"
    common = f"least(x.n - ({only_x}), y.n - ({only_y}))"
    return f"{share} and (x.n < x.total or y.n < y.total or {1 + least} * {common} >= {least} * (x.n + y.n))"


def _weights(wt: bytes, n: int) -> np.ndarray:
    return np.frombuffer(wt, "<u4") if wt else np.ones(n, np.uint32)


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for i, (ea, wa, eb, wb) in enumerate(zip(*(batch[c].to_pylist() for c in ("el_a", "wt_a", "el_b", "wt_b")), strict=True)):
            ea, eb = _unpack(ea), _unpack(eb)
            out[i] = probability_jaccard(ea, _weights(wa, len(ea)), eb, _weights(wb, len(eb)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(out)], ["a", "b", "similarity"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of every pair."""
    id_type = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("el").alias("el_a"), F.col("wt").alias("wt_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("el").alias("el_b"), F.col("wt").alias("wt_b")), "b")
    return written(both.mapInArrow(_similarities, f"a {id_type}, b {id_type}, similarity double"), "verified")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = tk.SHINGLE) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    ``class_id`` is the smallest doc_id of the class and ``n_links`` the number of the document's verified links: each joins two
    representatives, most of them a member and the hub of its band group, so it is no count of all near pairs. Texts without a word
    (null and empty ones too) and rows without a doc_id are in no group: class_id is their own doc_id. Rows that share a doc_id are
    one document, which has the links of all its texts. Repeated rows come out as often as they go in. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    tk.small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text")
    signed = written(own.mapInArrow(_signatures(bands, rows, k), f"doc_id {id_type}, k1 long, k2 long, bands array<long>"), "signed")
    named = signed.filter("k1 is not null and doc_id is not null")
    reps = written(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.any_value("bands").alias("bands")), "reps")
    # a doc_id has several representatives if it has several texts: they share a node, the doc_id
    ids = written(reps.groupBy("rep").agg((F.count("*") > 1).alias("several"), F.any_value("bands").alias("own")), "ids")
    many = reps.join(ids.filter("several"), "rep", "left_semi")
    members = ids.filter("not several").select("rep", F.explode("own").alias("band")).union(many.select("rep", F.explode("bands").alias("band")).distinct())
    groups = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(members.join(written(groups, "groups"), "band"), "met")
    # the member that meets most others is the hub of nearly all its groups, so a group around one text has few pairs to verify
    popular = written(met.groupBy("rep").agg(F.sum("n").alias("met")), "popular")
    hubs = met.join(popular, "rep").groupBy("band").agg(F.max(F.struct("met", "rep"))["rep"].alias("hub"))
    met = written(met.join(written(hubs, "hubs"), "band").select("band", "rep", "hub"), "met-hub")
    # the filter keeps most sets from being made, and out of the join's exchange
    wanted = popular.select("rep")
    width, table = bit_table(wanted, "rep")
    some = own.filter("doc_id is not null").withColumn("place", place_of(F.col("doc_id"), width))
    some = some.mapInArrow(_sets(k, table), f"id {id_type}, el binary, wt binary, n long, total long, bits array<long>").join(wanted, F.col("id") == F.col("rep"), "left_semi")
    # repeated rows of a document have equal sets, and a doc_id with several texts keeps all of them
    sets = written(some.dropDuplicates(["id", "el", "wt"]), "sets")

    def ordered(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    good = F.col("similarity") >= threshold
    first = _verified(ordered(met, "rep", "hub"), sets)
    # copies of a text, and several texts under one doc_id, are links without verification
    copied = reps.filter("rep <> last").select("k1", "k2", "rep")
    same = named.select("doc_id", "k1", "k2").join(copied, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    linked = first.filter(good).select("a", "b")
    classes = components(linked)
    at = written(met.join(classes, F.col("rep") == F.col("node"), "left").select("band", "rep", "hub", F.coalesce("class_id", "rep").alias("c")), "placed")
    open_ = at.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    near = first.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "similarity").union(first.select("b", "a", "similarity")).groupBy("rep", "hub").agg(F.max("similarity").alias("similarity"))
    left = at.join(written(open_, "open"), "band").join(near, ["rep", "hub"], "left")
    distance = F.when(F.col("rep") == F.col("hub"), 0.0).otherwise(1 - F.coalesce("similarity", F.lit(0.0)))
    left = left.join(sets.select(F.col("id").alias("rep"), "n", "total", "bits"), "rep").join(ids, "rep").select("band", "rep", "c", distance.alias("d"), "n", "total", "bits", "several", "own")
    left = written(left, "left")
    if not left.isEmpty():
        # several texts have no one distance from a hub; of the bands that a pair shares the smallest gives it
        close = f"(x.several or y.several or (abs(x.d - y.d) <= {1 - threshold + 1e-9} and array_min(array_intersect(x.own, y.own)) = x.band))"
        rest = left.alias("x").join(left.alias("y"), F.expr(f"x.band = y.band and x.c < y.c and {close} and {_may_reach(threshold)}"))
        rest = ordered(rest.select(F.col("x.rep").alias("p"), F.col("y.rep").alias("q")), "p", "q").join(first, ["a", "b"], "left_anti")
        linked = written(linked.union(_verified(rest, sets).filter(good).select("a", "b")).distinct(), "linked")
    classes = components(linked.union(same))
    # of a pair with several texts each two that are near give a link
    links = linked.distinct()
    ends = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links"))
    of = written(classes.join(ends, F.col("node") == F.col("a"), "left").select("node", "class_id", "n_links"), "classes")
    return signed.select("doc_id").join(of, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest doc_id, and of its rows the first by text and
    the other columns. Rows without a doc_id stay."""
    classes = written(near_duplicates(docs, **options).select("doc_id", "class_id"), "classes")
    # the ids that go are few, and rows of all others needn't move for them
    gone = written(classes.filter("doc_id <> class_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = written(classes.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if not again.isEmpty():
        columns = docs.columns
        repeated = docs.join(again, "doc_id", "left_semi")
        first = repeated.groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in columns if c not in ("doc_id", "text")))).alias("r"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(first.select("doc_id", "r.*").select(columns))
    return kept.select(docs.columns)
