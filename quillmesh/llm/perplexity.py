"""Quality rules: base rules and the perplexity of a modified Kneser-Ney n-gram model.

The model's n-grams are of ``ORDER`` characters (letters lower-cased, digits and white space folded)
within one language. Spark counts them over all texts; continuation counts of the lower orders
come from the distinct n-grams above them, and discounts, back-off weights and probabilities are
joins and windows over n-gram tables. n-grams of the two highest orders seen once give all their
mass to the back-off, so a text does not vouch for its own noise. Every n-gram of the corpus is in
the model, so the probability of each is stored as one number, in sorted arrays of 64-bit hashes,
one pair of arrays for each of ``shards`` ranges of the hash.

The model grows with the corpus and is never broadcast. Documents are packed once into compressed
blocks; a block asks each shard for its own distinct n-grams (packed hashes). A shard's arrays and
what it is asked meet in one sorted stream, so that a task holds the arrays of one shard at a time,
loaded once; the answers come back by block, and the block's documents are scored against them.

Verdict: a document outside its language's perplexity band is rejected. The mean of n log
probabilities scatters less the longer the text is, so what is compared is the distance of the log
perplexity from the language's median, times ``sqrt(n / (1 + n / STEADY))``: by the square root of the
length up to about ``STEADY`` characters, and no further beyond. The band reaches ``reach`` times
the distance from the median to the quartile of this measure on either side. Medians and quartiles
come from exact counts of values rounded to 1/10,000 over all documents that pass the base rules, so
reruns agree. Quartiles of a language of n such documents are drawn towards those of all documents as
if ``PRIOR`` documents of these were added; there is no size at which a rule switches.

Defined cases: a null text counts as empty, has no words and fails the base rules; a null language
is a language of its own, and so is an empty one; rows that repeat a ``doc_id`` each get their own row;
a null ``doc_id`` is kept; a text of one language and length may tie with the band's edge and is kept;
very long texts are counted and scored in parts that overlap by ORDER - 1 characters; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import delete, forget, shared_dir, slices, staged, texts_of, with_workers

ORDER, BLOCK_BYTES = 3, 8 << 20
REACH, STEADY, PRIOR = 5.0, 8000, 25
#: Parts of a language's documents that meet its band in separate rows, and rounding steps of the bands' measure.
SALTS, GRAIN = 64, 10_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PAD = "\x02"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, marks = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            marks[i : i + 3] = b"\x01\x01\x01"
    return sum(marks)


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode("utf-8", "replace")
    words, seen, dup = data.split(), set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    spaces = len(data) - sum(map(len, words))
    return len(words), len(text) - spaces, sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), dup, repeated(words)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, data, h, n, lang, gram): documents packed with their base statistics, and the block's
    distinct n-grams, so that counting and asking never open the texts again."""
    src = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            whole = pa.Table.from_batches(held).combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            held, size, made = [], 0, made + 1
            u, n, langs, text = distinct(whole)
            own = ((first + made, pa.int64()), (out.getvalue().to_pybytes(), pa.binary()), (u.view(np.int64), pa.list_(pa.int64())), (n, pa.list_(pa.int64())), (langs.tolist(), pa.list_(pa.string())), (text.tolist(), pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in own], names=["block", "data", "h", "n", "lang", "gram"])

        for whole in batches:
            for batch in slices(whole, most=BLOCK_BYTES // 4):
                stats = np.array([base_stats(x) for x in texts_of(batch)], np.int64).reshape(-1, len(STATS))
                held.append(pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, k]) for k in range(len(STATS)))], names=[*batch.schema.names, *STATS]))
                size += batch.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
        if held:
            yield flush()

    return src.mapInArrow(run, "block long, data binary, h array<long>, n array<long>, lang array<string>, gram array<string>")


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def grams(pieces: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owners, codes, starts): the n-gram that ends at each character of each piece but its first
    ORDER - 1, which are context; the piece's number; all code points, and where in them each n-gram starts."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[((codes >= 9) & (codes <= 13)) | (codes == 32)] = 32
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = np.maximum(lengths - (ORDER - 1), 0)
    owners = np.repeat(np.arange(len(pieces)), n)
    firsts = np.cumsum(lengths) - lengths - (np.cumsum(n) - n)
    at = np.arange(len(owners)) + firsts[owners]
    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), 7) for x in langs], np.uint64)
    h = seeds[owners]
    for k in range(ORDER):
        h ^= codes[at + k].astype(np.uint64)
        h *= MULTIPLIER
        h ^= h >> np.uint64(29)
    return h, owners, codes, at


def keyed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in the order they first occur, and each hash's place among them."""
    found = pa.array(h).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)


def parts(table: pa.Table, most: int = 1 << 20) -> Iterator[tuple[list[str], list[str], list[int]]]:
    """A block's texts, lower-cased and each after ORDER - 1 characters of context, their languages and
    rows, in parts of about ``most`` characters; a text longer than that comes in several pieces."""
    pieces, langs, rows, held = [], [], [], 0
    for i, (text, lang) in enumerate(zip(table.column("text"), table.column("lang"))):
        low = PAD * (ORDER - 1) + (text.as_py() or "").lower()
        for start in range(0, max(1, len(low) - ORDER + 1), most):
            piece = low[start : start + most + ORDER - 1]
            if held and held + len(piece) > most:
                yield pieces, langs, rows
                pieces, langs, rows, held = [], [], [], 0
            pieces.append(piece)
            langs.append(lang.as_py())
            rows.append(i)
            held += len(piece)
    if pieces:
        yield pieces, langs, rows


def distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct n-grams, sorted by hash: hashes, counts, languages and texts."""
    hs, ns, cs, ls = [], [], [], []
    for pieces, langs, _ in parts(table):
        h, owner, codes, starts = grams(pieces, langs)
        u, place = keyed(h)
        at = np.zeros(len(u), np.int64)
        at[place[::-1]] = np.arange(len(h))[::-1]  # the first occurrence is written last
        hs.append(u)
        ns.append(np.bincount(place, minlength=len(u)))
        cs.append(codes[starts[at][:, None] + np.arange(ORDER)])
        ls.append(np.array(langs, object)[owner[at]] if len(at) else np.zeros(0, object))
    every, counts, codes, langs_ = (np.concatenate(x) for x in (hs, ns, cs, ls))
    u, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    text = np.ascontiguousarray(codes[first].astype("<u4")).view(f"<U{ORDER}").ravel() if len(u) else np.zeros(0, "<U1")
    return u, np.bincount(inverse, counts, minlength=len(u)).astype(np.int64), langs_[first], text


def counted(packed: DataFrame) -> DataFrame:
    """(h, lang, gram, n) for each block's distinct n-grams."""
    return packed.select(F.explode(F.arrays_zip("h", "n", "lang", "gram")).alias("x")).select("x.h", "x.lang", "x.gram", "x.n")


def discounts(level: DataFrame, prune: bool) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more of one order."""
    n1, n2, n3, n4 = (float(x or 0) for x in level.agg(*(F.sum(F.when(F.col("a") == k, 1)) for k in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]
    return (1.0 if prune else d[0], d[1], d[2])


def model(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(h, logp): ln p of the last character of every n-gram after the ones before it; and the tables it reads."""
    top = staged(counts.groupBy("h").agg(F.first("lang").alias("lang"), F.first("gram").alias("gram"), F.sum("n").alias("a")), "ngrams")
    levels, made = {ORDER: top}, [top]
    for k in range(ORDER - 1, 0, -1):
        above = levels[k + 1]
        levels[k] = staged(above.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("a")), f"ngrams-{k}")
        made.append(levels[k])
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(levels[k], prune=k >= ORDER - 1 and k > 1)
        discount = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        by = W.partitionBy("lang", "context")
        own = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
        total, free = F.sum("a").over(by), F.sum(discount).over(by)
        cols = [c for c in ("h", "lang", "gram") if c in levels[k].columns]
        own = own.select(*cols, ((F.col("a") - discount) / total).alias("direct"), (free / total).alias("gamma"), F.count("*").over(by).alias("v"))
        if below is None:
            p = own.withColumn("p", F.col("direct") + F.col("gamma") / F.col("v"))
        else:
            low = below.select(F.col("lang").alias("l"), F.col("gram").alias("suffix"), F.col("p").alias("p_low"))
            p = own.join(low, (F.col("lang") == F.col("l")) & (F.substring("gram", 2, k - 1) == F.col("suffix"))).withColumn("p", F.col("direct") + F.col("gamma") * F.col("p_low"))
        below = p.select(*cols, "p")
        if k < ORDER:
            below = staged(below, f"probabilities-{k}")
            made.append(below)
    return below.select("h", F.log("p").alias("logp")), made


def sharded(scored: DataFrame, shards: int) -> DataFrame:
    """(s, hashes, logps): the model as sorted hash arrays, by hash modulo ``shards``."""

    def pack(table: pa.Table) -> pa.Table:
        h, p = table.column("h").to_numpy().view(np.uint64), table.column("logp").to_numpy().astype("<f4")
        order = np.argsort(h)
        return pa.table({"s": pa.array([table.column("s")[0].as_py()], pa.int32()), "hashes": pa.array([h[order].astype("<u8").tobytes()], pa.binary()), "logps": pa.array([p[order].tobytes()], pa.binary())})

    return scored.select(F.pmod("h", F.lit(shards)).cast("int").alias("s"), "h", "logp").groupBy("s").applyInArrow(pack, "s int, hashes binary, logps binary")


def split(u: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each hash (as Spark's pmod of the signed long), and the order by (shard, hash)."""
    s = np.mod(u.view(np.int64), shards)
    return s, np.lexsort((u, s))


def requests(packed: DataFrame, shards: int) -> DataFrame:
    """(block, s, asked): each block's distinct hashes, packed and sorted, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in zip(batch.column("block"), batch.column("h")):
                u = x.values.to_numpy().view(np.uint64)
                s, order = split(u, shards)
                u, s = u[order], s[order]
                at = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else np.zeros(1, int)
                rows = [(b.as_py(), int(s[i]), u[i:j].astype("<u8").tobytes()) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "s", "asked"])

    return packed.select("block", "h").mapInArrow(run, "block long, s int, asked binary")


def answers(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """(block, got): per block the log probabilities of its distinct hashes, by (shard, hash)."""
    nothing = F.lit(None).cast("binary")
    arrays = shards.select("s", F.lit(-1).cast("long").alias("block"), F.col("hashes").alias("x"), F.col("logps").alias("y"))
    stream = arrays.union(asked.select("s", "block", F.col("asked").alias("x"), nothing.alias("y"))).repartition("s").sortWithinPartitions("s", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = np.zeros(0, "<u8"), np.zeros(0, "<f4")
        for batch in batches:
            for i in range(batch.num_rows):
                s, block, x, y = (c[i] for c in batch.columns)
                if block.as_py() < 0:  # a shard's arrays come before what it is asked
                    keys, logs = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<f4")
                else:
                    got = logs[np.searchsorted(keys, np.frombuffer(x.as_py(), "<u8"))].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([s.as_py()], pa.int32()), pa.array([got], pa.binary())], names=["block", "s", "got"])

    met = stream.mapInArrow(run, "block long, s int, got binary")
    return met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("s", "got"))).alias("x")).select("block", F.col("x.got").alias("got"))


def perplexities(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, lang, the base statistics, n_chars and perplexity (null without characters), written to the shared folder."""
    spark = with_workers(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or buckets
    # Bucketed by block where it is written, so that the last join does not move the texts again.
    name = f"ngram_blocks_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("n_chars", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, g, hashes in zip(batch.column("data"), batch.column("got"), batch.column("h")):
                table, u = opened(x.as_py()), hashes.values.to_numpy().view(np.uint64)
                _, order = split(u, shards)
                logs = np.empty(len(u), np.float64)
                if len(u):
                    logs[order] = np.frombuffer(b"".join(p.as_py() for p in g.values), "<f4")
                sums, counts = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)
                for pieces, langs, rows in parts(table):
                    h, owner, *_ = grams(pieces, langs)
                    if len(h):
                        own, place = keyed(h)
                        np.add.at(sums, rows, np.bincount(owner, logs[np.searchsorted(u, own)][place], minlength=len(pieces)))
                        np.add.at(counts, rows, np.bincount(owner, minlength=len(pieces)))
                ppl = np.exp(-sums / np.maximum(counts, 1))
                cols = [table.column(c).combine_chunks() for c in ("doc_id", "lang", *STATS)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), pa.array(ppl, mask=counts == 0)], names=schema.names)

    try:
        blocks(docs).write.option("compression", "zstd").bucketBy(buckets, "block").option("path", at).saveAsTable(name)
        packed = spark.table(name)
        scored, made = model(counted(packed))
        stored = staged(sharded(scored, shards), "ngram-arrays")
        forget(*made)
        got = staged(answers(requests(packed, shards), stored), "ngram-answers")
        both = packed.join(got.hint("shuffle_hash"), "block", "left")
        none = F.expr("cast(array() as array<binary>)")
        out = both.select("data", "h", F.coalesce("got", none).alias("got")).mapInArrow(run, schema)
        lang = F.when(F.col("lang") != "", F.expr("substring(lang, 2)"))
        done = staged(out.withColumn("lang", lang), "perplexities")
        forget(stored, got)
        return done
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, at)


def quantiles(values: DataFrame, by: list[str], at: tuple[float, ...]) -> DataFrame:
    """``by`` columns, n and q0, q1, ...: exact quantiles of ``x`` rounded to 1 / GRAIN, from counts of the
    rounded values (the values' range bounds how many there are), so that no group of rows meets in a task."""
    counts = values.groupBy(*by, F.round(F.col("x") * GRAIN).cast("long").alias("b")).agg(F.count("*").alias("k"))
    every = W.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("k").over(every.orderBy("b"))).withColumn("n", F.sum("k").over(every))
    cols = [(F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("b"))) / GRAIN).alias(f"q{i}") for i, p in enumerate(at)]
    return run.groupBy(*by).agg(F.first("n").alias("n"), *cols)


def judged(docs: DataFrame, reach: float = REACH, steady: float = STEADY, prior: float = PRIOR, shards: int | None = None) -> DataFrame:
    """The columns of ``perplexities`` with base_failed, low, high (the band for the text's length) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = perplexities(docs, shards).withColumn("base_failed", failed).withColumn("key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    usable = scored.where("not base_failed and perplexity is not null").select("key", F.log("perplexity").alias("x"), "n_chars")
    length = F.greatest("n_chars", F.lit(1))
    scale = F.sqrt(length / (1 + length / steady))
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_chars"), F.lit(SALTS)).cast("int")

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    median = staged(quantiles(usable, ["key"], (0.5,)).select("key", F.col("q0").alias("median")), "perplexity-medians")
    usable = usable.withColumn("part", F.pmod(F.xxhash64("x", "n_chars"), F.lit(SALTS)).cast("int"))
    met = usable.join(salted(median), ["key", "part"])
    spread = staged(met.select("key", ((F.col("x") - F.col("median")) * scale).alias("x")), "perplexity-spreads")
    own = quantiles(spread, ["key"], (0.25, 0.5, 0.75))
    every = quantiles(spread.select(F.lit(0).alias("all"), "x"), ["all"], (0.25, 0.5, 0.75)).select("all", *(F.col(f"q{i}").alias(f"a{i}") for i in range(3)))
    share = F.col("n") / (F.col("n") + prior)
    mixed = [(share * F.col(f"q{i}") + (1 - share) * F.col(f"a{i}")).alias(f"q{i}") for i in range(3)]
    bands = own.withColumn("all", F.lit(0)).join(every, "all").join(median, "key").select("key", "median", *mixed)
    wide = F.greatest(F.col("q2") - F.col("q0"), F.lit(1e-3)) / 4  # neither side is narrower than this
    bands = staged(bands.select("key", "median", (F.col("q1") - reach * F.greatest(F.col("q1") - F.col("q0"), wide)).alias("below"), (F.col("q1") + reach * F.greatest(F.col("q2") - F.col("q1"), wide)).alias("above")), "perplexity-bands")
    out = scored.withColumn("part", salt).join(salted(bands), ["key", "part"], "left")
    edge = lambda c: F.exp(F.col("median") + F.col(c) / scale)
    out = out.withColumn("low", edge("below")).withColumn("high", edge("above"))
    inside = ((F.log("perplexity") - F.col("median")) * scale).between(F.col("below"), F.col("above"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("key", "part", "median", "below", "above")
