"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and packed into buckets of near-equal length (one row with packed
arrays each). Each block of queries first meets the bucket of the longest vectors, which gives each
query a score to beat from the start. A bucket that is too short for all queries of a block is not
sent to it. In the others, the score to beat, the query's length and the bucket's largest length give
a local threshold on the cosine. Above 1 the bucket is skipped for the query. A high threshold selects candidates by
coordinates: on the query's largest coordinates a candidate must lie in the interval that the
threshold leaves. A low one selects by length: only vectors long enough to reach the score.
What is left is verified by integer products. Bounds are widened by a relative 1e-9, so rounding
never prunes a vector that belongs to the result.

Queries and buckets meet in an equi-join on the bucket's group, for which query blocks (a stated
set) are repeated; neither side is broadcast. Ties go to the smaller id.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither
as query nor as candidate, nor do rows with a null id; vectors meet only vectors of their own
dimension; components beyond +-2**53 after scaling count as +-2**53, scores beyond a long as the
nearest long (the result's type holds no more); rows that repeat an id are rows of their own: each such
query gets its own ranking, and all rows but the query's own are candidates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import staged, with_workers

BUCKET, BLOCK, FOCUS, HIGH = 2048, 1024, 3, 0.5
#: Dimensions whose longest bucket is sent to all tasks (BUCKET vectors each); beyond them no score is fixed first.
FIRST = 8
LOW = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, dim, norm2, the packed integers floor(scale * x) and a number for each row of the vectors that take part."""
    with_workers(vectors.sparkSession)
    src = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = x.values
                if v.null_count:
                    continue
                a = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
                if len(a) and np.isfinite(v.to_numpy(zero_copy_only=False)).all():
                    ids.append(i)
                    out.append(np.clip(a, -(2.0**53), 2.0**53).astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(a) for a in out], pa.int32()), pa.array([float((a.astype(np.float64) ** 2).sum()) for a in out], pa.float64()), pa.array([a.tobytes() for a in out], pa.binary())], names=["vec_id", "dim", "norm2", "v"])

    return src.mapInArrow(run, "vec_id long, dim int, norm2 double, v binary").withColumn("row", F.monotonically_increasing_id())


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in their order, packed: dim, n, longest, first (row), rows, ids, vs; a pack has one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            cols = [[held[0][1]], [len(held)], [max(r[2] for r in held) ** 0.5], [held[0][4]], *([np.array([r[i] for r in held], "<i8").tobytes()] for i in (4, 0)), [b"".join(r[3] for r in held)]]
            types = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["dim", "n", "longest", "first", "rows", "ids", "vs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "norm2", "v", "row"))):
                if held and (len(held) >= size or held[0][1] != row[1]):
                    yield pack()
                    held = []
                held.append(row)
        if held:
            yield pack()

    return rows.mapInArrow(run, "dim int, n int, longest double, first long, rows binary, ids binary, vs binary")


class Pool:
    """The best k of each query row of a block so far; ``floors``: scores that k rows reach at least."""

    def __init__(self, rows: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.rows, self.q, self.k = rows, q, k
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.best = np.full(len(rows), LOW) if floors is None else floors.copy()  # the k-th score, once it is known
        self.at, self.score, self.vec, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        other = row != self.rows[at]
        at, score, vec, row = (np.concatenate([a, b[other]]) for a, b in ((self.at, at), (self.score, score), (self.vec, vec), (self.row, row)))
        order = np.lexsort((row, vec, np.negative(score.astype(np.float64)), at)) if (np.abs(score) < 1 << 53).all() else np.lexsort((row, vec, ~score, at))
        at, score, vec, row = at[order], score[order], vec[order], row[order]
        nth = np.arange(len(at)) - np.searchsorted(at, np.arange(len(self.rows)))[at]
        last = nth == self.k - 1
        self.best[at[last]] = np.maximum(self.best[at[last]], score[last])
        keep = nth < self.k
        self.at, self.score, self.vec, self.row = at[keep], score[keep], vec[keep], row[keep]

    def need(self) -> float:
        """The length that a vector must have to matter to any query of the block."""
        if (self.best <= 0).any() or not (self.norm > 0).all():
            return 0.0
        return float((self.best / self.norm).min() * (1 - 1e-9))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


def meet(pool: Pool, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, longest: float) -> None:
    """One bucket: prune by local thresholds, verify, and add to the pool."""
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    open_ = pool.best == LOW
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(open_, -np.inf, pool.best / (pool.norm * longest) * (1 - 1e-9 * np.sign(pool.best)))
    local = np.where(np.isnan(local), -np.inf, local)  # zero vectors: 0 / 0
    by_length, by_coordinate = np.flatnonzero(local < HIGH), np.flatnonzero((local >= HIGH) & (local <= 1))
    found: list[tuple] = []
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(open_ | (pool.best <= 0), 0.0, pool.best / pool.norm * (1 - 1e-9))[by_length]
        near = norm >= np.nan_to_num(need, nan=0.0, posinf=0.0).min()
        s = products(pool.q[by_length], c[near])
        if s.shape[1] > pool.k:
            floor = np.maximum(pool.best[by_length], np.partition(s, s.shape[1] - pool.k - 1, axis=1)[:, s.shape[1] - pool.k - 1])  # one more, as the query itself may be among them
        else:
            floor = pool.best[by_length]
        r, x = np.nonzero(s >= floor[:, None])
        found.append((by_length[r], s[r, x], ids[near][x], rows[near][x]))
    if len(by_coordinate):
        unit = c / np.maximum(norm, 1e-300)[:, None]
        for i in by_coordinate:
            qi, t = pool.q[i] / pool.norm[i], local[i]
            ok = np.ones(len(c), bool)
            for f in np.argsort(-np.abs(qi))[:FOCUS]:
                # A vector of cosine >= t with the query has its f-th coordinate in this interval.
                half = np.sqrt(max(0.0, 1 - qi[f] ** 2) * (1 - t * t)) + 1e-9
                if qi[f] >= 0:
                    high = 1.0 if qi[f] >= t else qi[f] * t + half
                    low = qi[f] * t - half
                else:
                    low = -1.0 if -qi[f] >= t else qi[f] * t - half
                    high = qi[f] * t + half
                ok &= (unit[:, f] >= low) & (unit[:, f] <= high + 1e-9)
            at = np.flatnonzero(ok)
            if len(at):
                s = products(pool.q[i : i + 1], c[at])[0]
                good = s >= pool.best[i]
                found.append((np.full(int(good.sum()), i), s[good], ids[at][good], rows[at][good]))
    if found:
        pool.add(*(np.concatenate([f[j] for f in found]) for j in range(4)))


def _arrays(r: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r[f"{prefix}rows"], "<i8"), np.frombuffer(r[f"{prefix}ids"], "<i8"), np.frombuffer(r[f"{prefix}vs"], "<i8").reshape(-1, r["dim"])


def with_floors(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Query blocks with ``floors`` (the k-th score of each query among the longest bucket's vectors) and ``need``."""
    none = queries.withColumn("floors", F.lit(None).cast("binary")).withColumn("need", F.lit(0.0))
    if buckets.select("dim").distinct().limit(FIRST + 1).count() > FIRST:
        return none
    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("rows", "ids", "vs", "longest"), F.struct("longest", "first")).alias("x"))
    top = F.broadcast(longest.select("dim", *(F.col(f"x.{c}").alias(f"c_{c}") for c in ("rows", "ids", "vs", "longest"))))  # at most FIRST buckets
    names = [*queries.columns, "floors", "need"]
    shape = T.StructType([*queries.schema.fields, T.StructField("floors", T.BinaryType()), T.StructField("need", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, needs = [], []
            for r in batch.to_pylist():
                rows, _, q = _arrays(r, "")
                pool = Pool(rows, q, k)
                c_rows, c_ids, c = _arrays(r, "c_")
                meet(pool, c_rows, c_ids, c, r["c_longest"])
                floors.append(pool.best.astype("<i8").tobytes())
                needs.append(pool.need())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(floors, pa.binary()), pa.array(needs, pa.float64())], names=names)

    return queries.join(top, "dim").select(*queries.columns, "c_rows", "c_ids", "c_vs", "c_longest").mapInArrow(run, shape)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over vec_id)."""
    rows = staged(quantized(vectors, scale), "topk-vectors")
    buckets = staged(packed(rows.repartitionByRange("dim", F.desc("norm2"), "vec_id").sortWithinPartitions("dim", F.desc("norm2"), "vec_id"), bucket), "topk-buckets")
    n = buckets.count()
    groups = max(1, min(n, max(12, n // 32)))
    blocks = packed(rows.where(is_query).repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id"), block)
    queries = staged(with_floors(blocks, buckets, k), "topk-queries")
    c = buckets.select(F.pmod(F.xxhash64("dim", "longest", "first"), F.lit(groups)).alias("g"), F.col("dim").alias("c_dim"), "longest", *(F.col(x).alias(f"c_{x}") for x in ("rows", "ids", "vs")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    q = queries.select("dim", F.col("first").alias("block"), "rows", "ids", "vs", "floors", "need", every.alias("of"))
    met = (F.col("of") == F.col("g")) & (F.col("dim") == F.col("c_dim")) & (F.col("longest") >= F.col("need"))
    pairs = q.join(c.hint("shuffle_hash"), met).select("dim", "block", "of", "rows", "ids", "vs", "floors", "longest", "c_rows", "c_ids", "c_vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, at, own = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pool.rows[pool.at]), pa.array(own[pool.at]), pa.array(pool.vec), pa.array(pool.row), pa.array(pool.score)], names=["query_row", "query_id", "vec_id", "row", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["dim"], r["block"], r["of"]):
                    if pool is not None:
                        yield out()
                    at = (r["dim"], r["block"], r["of"])
                    q_rows, own, qv = _arrays(r, "")
                    pool = Pool(q_rows, qv, k, None if r["floors"] is None else np.frombuffer(r["floors"], "<i8").astype(np.int64))
                c_rows, c_ids, cv = _arrays(r, "c_")
                meet(pool, c_rows, c_ids, cv, r["longest"])
        if pool is not None:
            yield out()

    found = pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
