"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots. Slot ``i`` maps the golden-ratio point ``frac(i * phi)`` through
the cumulative target weights to a source, so every stretch of the sequence holds each source
close to its share. The slots of a source are ranked, and its ``k``-th slot takes the ``k``-th of
equally large blocks of tokens (words) of the source's documents in shuffled order, which are laid
end to end once per epoch. Blocks cut documents where they end; over the whole mix a document is
taken as a whole in every full epoch.

No step gathers a source in one task: ranks and running token counts are made of a running sum
over chunks (a few thousand rows per source) and a running sum within a chunk. What the
driver holds is one row per source, and the number of sources is checked (``max_sources``).

Defined cases: a null text has size 0; documents of size 0 are never taken (``taken`` 0); a null
source is a source of its own, last in order; rows that repeat a ``doc_id`` are documents of their
own (each has its own place in the stream); a null ``doc_id`` is kept; an empty table gives an
empty result; a source whose target is too small for a slot of the schedule gets one slot at its
end; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, staged, with_workers

WEIGHTS = (3, 1, 2)
#: The golden ratio as a 64-bit fraction (odd, so that points never repeat below 2**64 slots).
STEP = 0x9E3779B97F4A7C15
ONE = 1 << 64


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares ``total`` by weight; shares stop at ``most`` times the size, the excess is reshared."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = level * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def plan(sized: DataFrame, share: float, most: float, weights: tuple[float, ...], block: int, max_sources: int) -> tuple[list[dict], int, int]:
    """A row per source (index, size, target, range of points), the number of slots and of documents."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; the plan of a mix is made on the driver")
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.words) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), most)
    total = sum(targets)
    slots = max(1, round(total / block)) if total else 0
    edges, acc = [], 0.0
    for t in targets:
        acc += t
        edges.append(ONE if total and acc >= total * (1 - 1e-12) else int(acc / (total or 1.0) * ONE))
    found = [{"s": i, "source": r.source, "source_size": sizes[i], "target": targets[i], "edge": edges[i]} for i, r in enumerate(rows)]
    return found, slots, sum(int(r.docs) for r in rows)


def schedule(spark: SparkSession, rows: list[dict], slots: int) -> DataFrame:
    """(slot, s, rank): the source of each slot and the slot's rank, from 0, within its source."""
    wanted = [r["s"] for r in rows if int(r["target"]) > 0]
    shape = "slot long, s int, rank long"
    if not wanted:
        return spark.createDataFrame([], shape)
    edges = np.array([min(r["edge"], ONE - 1) for r in rows], np.uint64)
    chunk = max(1, -(-slots // 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = slot.astype(np.uint64) * np.uint64(STEP)  # modulo 2**64: the fractional part
            s = np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // chunk), pa.array(s.astype(np.int32))], names=["slot", "chunk", "s"])

    hit = staged(with_workers(spark).range(slots).mapInArrow(run, "slot long, chunk long, s int"), "mix-slots")
    per_chunk = hit.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.select("s", "chunk", (F.sum("n").over(W.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    within = hit.withColumn("k", F.row_number().over(W.partitionBy("s", "chunk").orderBy("slot")) - 1)
    ranked = within.join(before, ["s", "chunk"]).select("slot", "s", (F.col("before") + F.col("k")).alias("rank"))
    # Sources that no point fell on (at most max_sources): one slot each, after the others.
    seen = {r.s for r in hit.select("s").distinct().collect()}
    late = [(slots + k, s, 0) for k, s in enumerate(s for s in wanted if s not in seen)]
    return ranked.unionByName(spark.createDataFrame(late, shape)) if late else ranked


def sized_documents(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and place in the shuffle; the text is read here and nowhere else."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key"), F.xxhash64("text").alias("same"), *carry)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 256, seed: int = 17, max_sources: int = 100_000, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (documents, pieces, slots).

    documents: doc_id, same (hash of the text), size, source_size, target, taken, row, s and ``carry``. pieces:
    row, epoch, s, rank, first, words: which words of which document a block holds. slots: slot,
    s, rank. Joining pieces with slots on (s, rank) gives the mix in order. The blocks of a source
    hold the first ``target`` words of its repeated stream; slots left over at its end hold none.
    """
    spark = docs.sparkSession
    sized = staged(sized_documents(docs, seed, carry), "mix-sizes")
    rows, slots, n = plan(sized, share, most, weights, block, max_sources)
    order = schedule(spark, rows, slots)
    n_slots = {r.s: r.n for r in order.groupBy("s").agg(F.count("*").alias("n")).collect()}
    per_source = [(r["s"], r["source"], r["source_size"], r["target"], int(r["target"]), max(1, -(-int(r["target"]) // n_slots.get(r["s"], 1)))) for r in rows]
    # At most max_sources rows, checked in plan().
    sources = F.broadcast(spark.createDataFrame(per_source, "s int, of string, source_size long, target double, goal long, block long"))
    bins = min(1 << 16, max(128, n // 2000))
    keyed = sized.join(sources, sized["source"].eqNullSafe(sources["of"])).withColumn("bin", F.pmod(F.shiftright("key", 3), F.lit(bins)))
    # Place in the source's shuffled stream: running sums over bins of the shuffle key and within a bin.
    per_bin = keyed.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    up = W.partitionBy("s").orderBy("bin")
    before = per_bin.select("s", "bin", (F.sum("words").over(up) - F.col("words")).alias("words_before"), (F.sum("rows").over(up) - F.col("rows")).alias("rows_before"))
    inside = W.partitionBy("s", "bin").orderBy("key", "doc_id", "size", "same", *carry)
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.select("doc_id", "same", *carry, "size", "source_size", "target", "s", "goal", "block", "bin", F.sum("size").over(running).alias("upto"), F.row_number().over(inside).alias("nth"))
    placed = placed.join(before, ["s", "bin"]).select("doc_id", "same", *carry, "size", "source_size", "target", "s", "goal", "block", (F.col("words_before") + F.col("upto") - F.col("size")).alias("start"), F.concat_ws(":", "s", F.col("rows_before") + F.col("nth")).alias("row"))
    placed = staged(placed, "mix-places")
    epochs = placed.where("size > 0 and goal > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("epoch"))
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    spans = epochs.select("row", "s", "block", "epoch", begin.alias("a"), F.least(begin + F.col("size"), F.col("goal")).alias("b")).where("a < b")
    cut = spans.select("*", F.expr("explode(sequence(a div block, (b - 1) div block))").alias("rank"))
    low, high = F.greatest("a", F.expr("rank * block")), F.least("b", F.expr("(rank + 1) * block"))
    pieces = cut.select("row", "epoch", "s", "rank", (low - F.col("a")).alias("first"), (high - low).alias("words"))
    taken = pieces.join(order.select("s", "rank"), ["s", "rank"]).groupBy("row").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, "row", "left").select("doc_id", "same", *carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row", "s")
    return documents, pieces, order


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    A document that a full epoch takes comes whole; the one at which the mix of a source ends is
    cut after the taken words (joined by single spaces). Each row is a document of its own, also
    where others have the same id, text or source: ``docs`` is written once with a number for each row.
    """
    names = docs.columns
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row_"), own.alias("own")), "mix-rows")
    at = {c: f"own.c{i}" for i, c in enumerate(names)}
    src = numbered.select("row_", *(F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")))
    taken, _, _ = mix(src, carry=("row_",), **options)
    take = taken.where("taken > 0").select(F.col("row_").alias("of_"), "size", "taken")
    back = numbered.join(take.hint("merge"), F.col("row_") == F.col("of_"))
    parts = back.select("own", "size", "taken", F.explode(F.expr("sequence(0L, (taken - 1) div size)")).alias("epoch"))
    words = F.expr("least(size, taken - epoch * size)")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(at["text"]), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words == F.col("size"), F.col(at["text"])).otherwise(cut)
    fresh = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return parts.select(*(fresh.get(c, F.col(at[c])).alias(c) for c in names))
