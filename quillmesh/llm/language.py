"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds the letters' vectors,
permuted by place, by multiplication; a text's vector bundles (adds) those of its n-grams; a
language's prototype bundles those of its training texts. A text gets the language whose
prototype has the largest cosine with the text's vector.

Letters are folded to 63 symbols (a to z each one of their own, all other letters by code point),
and every run of other characters counts as one border symbol. Vectors follow from the seed, so
every worker makes the same ones. Training sums over all labelled texts that are not held out;
its result is a table of one vector per language. Texts meet it in blocks of languages and keep the
closest one so far, so that neither the driver nor a worker holds more than a block of prototypes.
Long texts are read in pieces that share a character on either side, so an n-gram is never lost
and memory does not grow with the text.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn
from, every text is ``und`` with score 0; rows that repeat a ``doc_id`` count each on their own; a
null ``doc_id`` counts as not held out; equal cosines go to the language first in order; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import slices, staged, texts_of, with_workers

DIM, SYMBOLS, N, SEED = 1024, 64, 3, 11
#: Languages that meet the texts at a time, characters of a piece, n-grams of a matrix product.
LANGS, PIECE, WIDTH = 1000, 1 << 20, 8192
_WORKER: dict = {}  # tables of fixed size: 1 MB of symbols, 200 kB of letters


def symbols() -> np.ndarray:
    """Code point -> symbol; 0 for all that is not a letter."""
    if "symbols" not in _WORKER:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
        _WORKER["symbols"] = out
    return _WORKER["symbols"]


def letters(dim: int, seed: int) -> list[np.ndarray]:
    """The symbols' vectors, permuted (rotated) for each place of an n-gram."""
    key = ("letters", dim, seed)
    if key not in _WORKER:
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        _WORKER[key] = [np.roll(base, N - 1 - k, axis=1) for k in range(N)]
    return _WORKER[key]


def bind(grams: np.ndarray, dim: int, seed: int) -> np.ndarray:
    out = None
    for k, table in enumerate(letters(dim, seed)):
        part = table[grams // SYMBOLS ** (N - 1 - k) % SYMBOLS]
        out = part if out is None else out * part
    return out


def grams_of(texts: list[str], context: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, one around each letter, and the text each belongs to.

    With ``context`` the first and the last character of a text are its neighbours' and not its own.
    """
    if not context:
        texts = [f"\n{x}\n" for x in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    own[(ends - lengths)[lengths > 0]] = False
    own[ends[lengths > 0] - 1] = False
    sym = symbols()[codes]
    at = np.flatnonzero(own & (sym != 0))
    grams = np.zeros(len(at), np.int64)
    for k in range(N):  # N = 3: what stands next to a letter is a letter or the border of its word
        grams = grams * SYMBOLS + sym[at + k - N // 2]
    return grams, np.repeat(np.arange(len(texts)), lengths)[at]


def pieces(texts: Iterable[str], most: int | None = None) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of the texts, with context on either side, and their texts' numbers, in parts of about ``most`` characters."""
    most = most or PIECE
    cut, rows, held = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text)), most):
            end = start + most
            piece = (text[start - 1 : end + 1] if start else "\n" + text[: end + 1]) + ("\n" if end >= len(text) else "")
            if held and held + len(piece) > most:
                yield cut, np.array(rows)
                cut, rows, held = [], [], 0
            cut.append(piece)
            rows.append(i)
            held += len(piece)
    if cut:
        yield cut, np.array(rows)


def bundle(grams: np.ndarray, owner: np.ndarray, n: int, dim: int, seed: int) -> np.ndarray:
    """(n, dim): the sum of the n-gram vectors of each owner."""
    out = np.zeros((n, dim))
    if not len(grams):
        return out
    present = np.flatnonzero(np.bincount(grams, minlength=SYMBOLS**N))
    place = np.zeros(SYMBOLS**N, np.int64)
    place[present] = np.arange(len(present))
    at = place[grams]
    if len(present) > WIDTH:
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
    for i in range(0, len(present), WIDTH):
        low, high = np.searchsorted(at, (i, i + WIDTH)) if len(present) > WIDTH else (0, len(at))
        block = present[i : i + WIDTH]
        counts = np.bincount(owner[low:high] * len(block) + at[low:high] - i, minlength=n * len(block)).reshape(n, -1)
        out += counts.astype(np.float32) @ bind(block, dim, seed).astype(np.float32)  # whole numbers below 2**24: exact
    return out


def train(docs: DataFrame, usable: Column, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(lang, vec): the languages' prototypes of unit length, from the rows where ``usable``."""
    with_workers(docs.sparkSession)
    src = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["lang", "vec"])
            held.clear()
            return out

        for whole in batches:
            for batch in slices(whole, most=PIECE, rows=LANGS):
                langs = batch.column("lang").to_pylist()
                own = sorted(set(langs))
                number = {x: i for i, x in enumerate(own)}
                of = np.array([number[x] for x in langs])
                vecs = np.zeros((len(own), dim))
                for cut, rows in pieces(texts_of(batch)):
                    grams, owner = grams_of(cut, context=True)
                    vecs += bundle(grams, of[rows[owner]], len(own), dim, seed)
                for x, v in zip(own, vecs):
                    held[x] = held.get(x, 0) + v
                if len(held) > LANGS:
                    yield flush()
        yield flush()

    sums = src.mapInArrow(run, "lang string, vec array<double>").select("lang", F.posexplode("vec").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    vecs = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("vec"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return staged(vecs.select("lang", F.transform("vec", lambda x: x / F.greatest("norm", F.lit(1e-12))).alias("vec")), "language-prototypes")


def predict(docs: DataFrame, prototypes: DataFrame, dim: int = DIM, seed: int = SEED, block: int = LANGS) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of every row.

    The languages come in blocks of ``block``, in order; each block is one pass over the texts
    that carries the closest language so far, so any number of them is compared.
    """
    sc = with_workers(docs.sparkSession).sparkContext
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("cos"))

    def closest(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known = sent.value
            for whole in batches:
                for batch in slices(whole, most=PIECE, rows=512):
                    n = batch.num_rows
                    vecs, some = np.zeros((n, dim)), np.zeros(n, bool)
                    for cut, rows in pieces(texts_of(batch)):
                        grams, owner = grams_of(cut, context=True)
                        vecs += bundle(grams, rows[owner], n, dim, seed)
                        some[rows[owner]] = True
                    cos = vecs @ known.T / np.maximum(np.linalg.norm(vecs, axis=1), 1e-12)[:, None]
                    best, top = cos.argmax(axis=1), cos.max(axis=1)
                    before = batch.column("cos").to_numpy()
                    better = some & (top > before)  # equal cosines stay with the language first in order
                    pred = [names[b] if x else old for b, x, old in zip(best, better, batch.column("lang_pred").to_pylist())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(pred, pa.string()), pa.array(np.where(better, top, before))], names=["doc_id", "text", "lang_pred", "cos"])

        return run

    last = None
    while rows := (prototypes if last is None else prototypes.where(F.col("lang") > last)).orderBy("lang").limit(block).collect():
        last = rows[-1].lang
        sent = sc.broadcast(([r.lang for r in rows], np.array([r.vec for r in rows])))
        found = found.mapInArrow(closest(sent), f"doc_id {id_type}, text string, lang_pred string, cos double")
    return found.select("doc_id", "lang_pred", F.least(F.greatest("cos", F.lit(0.0)), F.lit(1.0)).alias("score"))
