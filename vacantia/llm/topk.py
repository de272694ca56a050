"""Exact top-k search by distributed histogram selection.

Scores are integers, so the k-th highest score of each query can be located by its bits: every
pass scores all candidates, counts per query how many fall into each of 2**bits equal bins of the
span still in question, and keeps the one bin that holds the k-th score.  When that span is one
score wide, a last pass keeps what lies above it and, of what equals it, the smallest ids.

A block of candidates counts only its own highest bins, down to its own k-th score: the k-th of all
is never below the k-th of a part, so what it leaves out cannot matter.  Candidates are dealt to
slots, and each slot is sent the query blocks (a group of at most ``GROUP`` a slot) ahead of its
candidates; nothing is collected or broadcast.

Vectors that are null, or hold null or non-finite components, or differ in length from the query,
take no part.  Repeated ids are candidates as often as they come; a query's own id never is.
Candidates with a null id take no part either.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.common import partitions, stored

SCALE, BLOCK, QUERIES, GROUP = 1024, 2048, 1024, 64


def clean_vectors(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """Ids and scaled integer components of the vectors that take part, as long arrays."""
    x = F.col(vec).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


BLOCKED = "block bigint, dim int, ids binary, v binary"
COUNTS = "block bigint, at bigint, bin bigint, n bigint"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed ``size`` at a time into binary blocks, each with a number of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc_lengths(batch["v"])
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                for at in range(0, part.num_rows, size):
                    cut = part.slice(at, size)
                    v = cut["v"].flatten().to_numpy(zero_copy_only=False)
                    v = v.astype(next(f"<i{w}" for w in (2, 4, 8) if w == 8 or (-(1 << 8 * w - 1) < v.min(initial=0) and v.max(initial=0) < 1 << 8 * w - 1)))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([int(dim)], pa.int32()),
                                                      pa.array([cut["id"].to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                                                      pa.array([v.tobytes()], pa.binary())], names=["block", "dim", "ids", "v"])
                    number += 1

    return rows.mapInArrow(run, BLOCKED)


def pc_lengths(lists: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.list_value_length(lists))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2**53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def arrays(ids: bytes, v: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; its components are as wide as its largest one needs."""
    return np.frombuffer(ids, "<i8"), np.frombuffer(v, f"<i{len(v) // (len(ids) // 8 * dim)}").reshape(-1, dim).astype(np.int64)


LEAST = -(2**63) + 1


def scored(slots: DataFrame, schema: str, give) -> DataFrame:
    """``give(query ids, candidate ids, scores, query block)`` for every pair of blocks of a slot; a query's own id scores LEAST.

    The query blocks of a slot come first and are held, at most ``GROUP`` or so; candidates pass by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[dict]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["low"] is not None:
                    asked.setdefault(row["dim"], []).append(row)
                    continue
                if row["dim"] not in asked:
                    continue
                ci, c = arrays(row["ids"], row["v"], row["dim"])
                for of in asked[row["dim"]]:
                    qi, q = arrays(of["ids"], of["v"], of["dim"])
                    s = scores(q, c)
                    s[qi[:, None] == ci[None, :]] = LEAST
                    made = give(qi, ci, s, of)
                    if made is not None:
                        yield made

    return slots.mapInArrow(run, schema)


def span_arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["low"], "<i8"), np.frombuffer(row["above"], "<i8")


def in_slots(cands: DataFrame, queries: DataFrame, groups: int, salts: int) -> DataFrame:
    """Candidate blocks in ``salts`` parts, once per group of query blocks, each part behind the blocks of its group."""
    # blocks are numbered by the task that made them and by their place in it, so that both spread evenly
    number = F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1)
    none = F.lit(None).cast("binary")
    each = cands.select("block", "dim", "ids", "v", none.alias("low"), none.alias("above"), F.pmod(number, F.lit(salts)).alias("salt"),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = queries.select("block", "dim", "ids", "v", "low", "above", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                           F.pmod(number, F.lit(groups)).cast("int").alias("group"))
    slot = (F.col("group") * salts + F.col("salt")).cast("int")
    return (each.unionByName(asked).repartitionById(groups * salts, slot).sortWithinPartitions(F.col("low").isNull())
            .select("block", "dim", "ids", "v", "low", "above"))


def refine(pairs: DataFrame, width: int, bits: int, k: int) -> DataFrame:
    """(block, at, bin, n): how many scores lie in each bin of ``width >> bits`` of a query's span."""
    step = max(1, width >> bits)

    def give(qi: np.ndarray, ci: np.ndarray, s: np.ndarray, row: dict) -> pa.RecordBatch | None:
        low, above = span_arrays(row)
        top = np.sort(np.partition(s, max(0, s.shape[1] - k), axis=1)[:, -k:], axis=1)[:, 0] if s.shape[1] > k else np.full(len(qi), LEAST)
        r, c = np.nonzero((s >= np.maximum(low, top)[:, None]) & (s < (low + width)[:, None]) & (s > LEAST))
        if not len(r):
            return None
        bin_ = (s[r, c] - low[r]) // step
        both, n = np.unique(np.stack([r, bin_]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array(both[0]), pa.array(both[1]), pa.array(n.astype(np.int64))],
                                          names=["block", "at", "bin", "n"])

    return scored(pairs, COUNTS, give)


def with_spans(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """Query blocks again, with the low end of each query's span and the count above it, in the block's order."""
    # merged at every size: blocks are small in a file and many times that in memory, no table for the driver
    each = spans.repartition(partitions(spans.sparkSession), "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "low", "above"))).alias("s")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            low = [np.array([x["low"] for x in r["s"]], "<i8").tobytes() for r in rows]
            above = [np.array([x["above"] for x in r["s"]], "<i8").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch["block"], batch["dim"], batch["ids"], batch["v"], pa.array(low, pa.binary()), pa.array(above, pa.binary())],
                                             names=["block", "dim", "ids", "v", "low", "above"])

    return queries.join(each, "block").select("block", "dim", "ids", "v", "s").mapInArrow(
        run, BLOCKED + ", low binary, above binary")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, bits: int = 12, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose id ``every`` divides.

    Every pass reads the stored blocks again.  Block numbers are made once and stored, so that
    passes agree on them.
    """
    spark = vectors.sparkSession
    rows = stored(clean_vectors(vectors, vec, key))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    cands = stored(blocks(rows, BLOCK))
    n_asked = asked.count()
    queries = stored(blocks(asked.repartition(max(1, -(-n_asked // QUERIES)), "id"), QUERIES))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qi), row["block"])), pa.array(np.arange(len(qi)))], names=["block", "at"])

    each = queries.select("block", "ids").mapInArrow(ids, "block bigint, at bigint")
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    span_bits = int(most + 1).bit_length() + 1
    spans = stored(each.select("block", "at", F.lit(-(1 << (span_bits - 1))).cast("long").alias("low"), F.lit(0).cast("long").alias("above")))
    # more slots than candidates a query would send more bytes of queries than of candidates
    salts = max(1, min(partitions(spark), cands.count(), rows.count() // max(1, n_asked)))
    groups = max(1, -(-queries.count() // GROUP))
    while True:
        pairs = in_slots(cands, with_spans(queries, spans), groups, salts)
        if span_bits == 0:
            break
        step_bits = max(0, span_bits - bits)
        counts = refine(pairs, 1 << span_bits, span_bits - step_bits, k).groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "at").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        found = (counts.withColumn("over", F.coalesce(F.sum("n").over(down), F.lit(0)))
                 .join(spans.select("block", "at", "above").hint("merge"), ["block", "at"]).withColumn("want", F.lit(k) - F.col("above"))
                 .filter((F.col("over") < F.col("want")) & (F.col("over") + F.col("n") >= F.col("want")))
                 .select("block", "at", F.col("bin").alias("_bin"), F.col("over").alias("_over")))
        # fewer than k candidates in all: the span stays at its low end, everything is above it
        spans = stored(spans.join(found.hint("merge"), ["block", "at"], "left").select(
            "block", "at", (F.col("low") + F.coalesce("_bin", F.lit(0)) * (1 << step_bits)).alias("low"),
            (F.col("above") + F.coalesce("_over", F.lit(0))).alias("above")))
        span_bits = step_bits

    def give(qi: np.ndarray, ci: np.ndarray, s: np.ndarray, row: dict) -> pa.RecordBatch | None:
        kth, above = span_arrays(row)
        r, c = np.nonzero((s > kth[:, None]) & (s > LEAST))
        tr, tc = np.nonzero((s == kth[:, None]) & (s > LEAST))
        order = np.lexsort((ci[tc], tr))
        tr, tc = tr[order], tc[order]
        place = np.arange(len(tr)) - np.repeat(np.flatnonzero(np.diff(tr, prepend=-1)), np.diff(np.flatnonzero(np.diff(tr, prepend=-1)), append=len(tr))) if len(tr) else tr
        keep = place < k - above[tr]
        r, c = np.concatenate([r, tr[keep]]), np.concatenate([c, tc[keep]])
        if not len(r):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), row["block"])), pa.array(r), pa.array(qi[r]), pa.array(ci[c]), pa.array(s[r, c])],
                                          names=["block", "at", "query_id", "vec_id", "score"])

    kept = scored(pairs, "block bigint, at bigint, query_id bigint, vec_id bigint, score bigint", give)
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
