"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to groups that share one of ``radius + 1`` bands of their bits
(two fingerprints within the radius agree in one band at least, so no link is lost), sorted by
population count and cut into tiles: rows that hold up to ``tile`` fingerprints as one packed
array. Tiles of a group are compared pair by pair with numpy's exclusive-or and bit counts, unless
their population counts differ by more than the radius everywhere; then no pair of them can link.
A tile pair gives the links' spanning forest (at most as many rows as fingerprints), never all
pairs, and linked fingerprints are joined to components by alternating large-star and small-star
steps, each written to the shared folder.

Copies share a fingerprint and are one node from the start, so a huge group of copies costs
nothing. Tiles come from a range partitioning by (band, count, fingerprint), which cuts even a
band that holds a third of all fingerprints into equal parts, and the tile pairs of such a band are
dealt to parts of bounded work; so are the neighbours of a node with very many links.

Defined cases: a null text or one without words has fingerprint zero, linked like any other; one
to three words are one shingle; rows that repeat a ``doc_id`` each get a row; a null ``doc_id``
gets the component of its fingerprint but never names one (unless all of a component are null:
then the component is null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import forget, slices, staged, with_workers

RADIUS, SHINGLE, TILE = 4, 4, 4096
#: Tiles of one group that a part of it holds on the left side.
GROUP = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([hash_(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        cut = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((hash_(joined[a:b], 42) for a, b in cut), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) of every row and its fingerprint as a signed long: the last column, ``fp``."""
    with_workers(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own)), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                fps = [fingerprint(x.as_py(), shingle) for x in batch.column("t")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema).toDF(*keep, "fp")


def tiles(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (bk, lo, hi, n, first, fps): packed fingerprints of one band, by population count."""
    with_workers(nodes.sparkSession)
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    keys = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(k << 32) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    banded = nodes.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("bk"))
    ranged = banded.repartitionByRange("bk", "pop", "fp").sortWithinPartitions("bk", "pop", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def rows(fp, pop, bk, last: bool):
            """Full tiles of what is held; all but the last stretch of equal bk unless ``last``."""
            cuts = np.flatnonzero(np.diff(bk)) + 1
            starts = np.concatenate([[0], cuts, [len(bk)]])
            out, done = [], 0
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                for i in range(a, b, tile):
                    j = min(b, i + tile)
                    if j == len(bk) and not last and j - i < tile:
                        break
                    out.append((int(bk[i]), int(pop[i]), int(pop[j - 1]), j - i, int(fp[i]), fp[i:j].astype("<i8").tobytes()))
                    done = j
            return out, done

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bk", "lo", "hi", "n", "first", "fps"])

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("fp", "pop", "bk")]
            held = now if left is None else [np.concatenate(x) for x in zip(left, now)]
            if len(held[0]):
                out, done = rows(*held, last=False)
                left = [x[done:] for x in held]
                if out:
                    yield packed(out)
        if left is not None and len(left[0]):
            yield packed(rows(*left, last=True)[0])

    return ranged.mapInArrow(run, "bk long, lo int, hi int, n int, first long, fps binary")


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def links_of(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between tiles ``a`` and ``b`` (None: within ``a``)."""
    all_ = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    step, us, vs, held = max(1, (1 << 20) // max(1, len(right))), [], [], 0

    def reduce() -> None:
        nonlocal us, vs, held
        label = forest(len(all_), np.concatenate(us), np.concatenate(vs))
        u = np.flatnonzero(label != np.arange(len(all_)))
        us, vs, held = [u], [label[u]], len(u)

    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ right[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + shift
        keep = x < y
        if keep.any():
            us.append(x[keep])
            vs.append(y[keep])
            held += int(keep.sum())
            if held > 1 << 20:
                reduce()
    if not us:
        return []
    reduce()
    return list(zip(all_[us[0]].astype(np.int64).tolist(), all_[vs[0]].astype(np.int64).tolist()))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): pairs of fingerprints that connect whatever links of up to ``radius`` bits connect."""
    found = staged(tiles(nodes, radius, tile), "simhash-tiles")
    # A group of many tiles is spread over parts: each of its tiles belongs to one part and meets all
    # the group's tiles there, so a part compares GROUP tiles with the others, however large the group.
    many = found.groupBy("bk").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    packed = found.join(many, "bk")
    part = F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")
    a = packed.select("bk", part.alias("part"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("first").alias("a_first"), F.col("n").alias("a_n"), F.col("fps").alias("a_fps"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    b = packed.select(F.col("bk").alias("b_bk"), every.alias("b_part"), F.col("lo").alias("b_lo"), F.col("first").alias("b_first"), F.col("fps").alias("b_fps"))
    same = F.col("a_first") == F.col("b_first")
    after = (F.col("a_lo") < F.col("b_lo")) | ((F.col("a_lo") == F.col("b_lo")) & (F.col("a_first") < F.col("b_first")))
    near = F.col("b_lo") - F.col("a_hi") <= radius
    met = (F.col("bk") == F.col("b_bk")) & (F.col("part") == F.col("b_part"))
    pairs = a.join(b.hint("merge"), met & ((same & (F.col("a_n") > 1)) | (after & near)))
    pairs = pairs.select("a_fps", F.when(~same, F.col("b_fps")).alias("b_fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(batch.column(0), batch.column(1)):
                left = np.frombuffer(x.as_py(), "<u8")
                right = np.frombuffer(y.as_py(), "<u8") if y.is_valid else None
                found += links_of(left, right, radius)
                if len(found) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["u", "v"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, by large-star and small-star steps until stable."""
    pairs = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def starred(edges_: DataFrame, large: bool) -> DataFrame:
        """Edges (u, v) hold u > v. A node's smallest neighbour takes its larger, or smaller, neighbours."""
        if not large:  # a node's smaller neighbours: few, as the large step has gathered them
            low = edges_.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
            joined = edges_.join(low.hint("merge"), F.col("u") == F.col("c"))
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
            return out.where("u <> v").distinct()
        # A hub may hold most links, so its neighbours are dealt to parts, and each part learns the hub's minimum.
        near = edges_.union(edges_.select("v", "u")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
        per_part = near.groupBy("u", "part").agg(F.min("v").alias("m"))
        low = per_part.groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        told = per_part.select("u", "part").join(low.hint("merge"), F.col("u") == F.col("c")).select("c", F.col("part").alias("of"), "m")
        joined = near.where("v > u").join(told.hint("merge"), (F.col("u") == F.col("c")) & (F.col("part") == F.col("of")))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    before = state(pairs)
    while True:
        larger = staged(starred(pairs, large=True), "stars")
        smaller = staged(starred(larger, large=False), "stars")
        forget(pairs, larger)
        pairs, now = smaller, state(smaller)
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    marked = staged(fingerprints(docs, shingle), "simhash-fps")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    stars = components(links(nodes, radius, tile))
    members = stars.union(stars.select("root", "root").distinct())
    named = members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "rep")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = named.select("node", "root").join(smallest, "root").select(F.col("node").alias("fp"), F.col("component_id"))
    labelled = staged(nodes.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "simhash-components")
    return marked.join(labelled.hint("merge"), "fp").select("doc_id", "fp", "component_id")
