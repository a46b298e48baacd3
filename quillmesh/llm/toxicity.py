"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of the word (those seen in two or more training documents; all
others share one) joined with the mean embedding of its runs of four characters (as UTF-8 units).
Two gated recurrent layers read a window of words in both directions, attention pools the states,
and a logistic output scores the window. All overlapping windows of a whole text are scored; the
document's score is a logistic function of the largest and the mean window logit.

Training runs on the driver over a sample of labelled documents with fixed bounds (``max_docs``
of either class, ``max_chars`` characters together), whatever the size of the tables; every word of a
sampled text is trained on. Scoring is one pass without a shuffle; what is sent to the workers is the
network, whose size the bounds of the sample fix.

Defined cases: a null or empty text (or one without words) scores as a window without words; rows
that repeat a ``doc_id`` are scored each on their own; labels that are null or whose document is
missing are not used, of several labels of a document the largest counts, and of several texts of a
sampled ``doc_id`` the first in order; a null ``doc_id`` counts
as not held out; with no labelled document of either class every score is 0; an empty table gives
an empty result; other columns are carried on request, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import crc_mod, engine, forget, slices, staged, texts_of, with_workers

WINDOW, STRIDE, HIDDEN, PAIR_BITS = 48, 24, 8, 15
PAIRS = 1 << PAIR_BITS
WORD_DIM, PAIR_DIM, ATTEND = 10, 6, 8
MAX_DOCS, MAX_CHARS, EPOCHS, THRESHOLD = (3000, 1500), 1 << 25, 4, 0.3
CACHE = 60_000  # words whose projections a worker keeps; no effect on results


_SEPARATE = bytes(32 if chr(i) in ".,;:!?\"'()[]|*&%$#<>" else i for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).split()


def word_features(words: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words (0: not known), hashes of their runs of four UTF-8 units, and where each word's runs start."""
    ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
    codes = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03\x00\x00", np.uint8).astype(np.uint32)
    grams = ((codes[:-3] * 2654435761 ^ codes[1:-2] * 40503) * 16777619 ^ codes[2:-1] * 2246822519 ^ codes[3:] * 374761393) * np.uint32(2654435769)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    keep = np.ones(len(grams) + 1, bool)
    keep[ends - 1] = keep[ends - 2] = False  # grams that would start at the last two units of a word
    starts = np.concatenate([[0], ends[:-1]]) - 2 * np.arange(len(words))
    return ids, (grams >> np.uint32(32 - PAIR_BITS)).astype(np.int64)[keep[:-1]], starts


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of all overlapping windows over n words; one window for n <= window."""
    return np.arange(0, max(1, n - window + stride), stride) if n > window else np.zeros(1, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(words: int, seed: int = 5) -> dict[str, np.ndarray]:
    r, d = np.random.default_rng(seed), WORD_DIM + PAIR_DIM
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    net = {"words": f(words, WORD_DIM, scale=0.1), "pairs": f(PAIRS, PAIR_DIM, scale=0.1), "attend": f(2 * HIDDEN, ATTEND, scale=0.3), "ask": f(ATTEND, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    for way in "fb":
        net |= {f"x_{way}": f(d, 3 * HIDDEN, scale=0.4), f"h_{way}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"b_{way}": np.zeros(3 * HIDDEN, np.float32)}
    return net


def embed(net: dict, ids: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(np.concatenate([starts, [len(pairs)]])).astype(np.float32)
    mean = np.add.reduceat(net["pairs"][pairs], starts, axis=0) / counts[:, None]
    return np.concatenate([net["words"][ids], mean], axis=1).astype(np.float32), counts


def layer(gates: np.ndarray, wh: np.ndarray, active: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """One direction. gates: (T, N, 3H) input projections; windows are sorted from long to short,
    so those that hold word t are the first ``active[t]``."""
    steps, n, h3 = gates.shape
    hd = h3 // 3
    h, out = np.zeros((n, hd), np.float32), np.zeros((steps, n, hd), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        k = active[t]
        old = h[:k]
        gh = old @ wh
        gx = gates[t, :k]
        zr = sigmoid(gx[:, : 2 * hd] + gh[:, : 2 * hd])
        z, r = zr[:, :hd], zr[:, hd:]
        c = np.tanh(gx[:, 2 * hd :] + r * gh[:, 2 * hd :])
        new = c + z * (old - c)
        if tape is not None:
            tape.append((t, k, old.copy(), z, r, c, gh[:, 2 * hd :]))
            h = h.copy()
        h[:k] = new
        out[t, :k] = new
    return out


def layer_back(tape: list, grad: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input projections and of ``wh``; grad: of the layer's output."""
    steps, n, hd = grad.shape
    gx, gw, dh = np.zeros((steps, n, 3 * hd), np.float32), np.zeros_like(wh), np.zeros((n, hd), np.float32)
    for t, k, old, z, r, c, ghc in reversed(tape):
        d = dh[:k] + grad[t, :k]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (old - c) * z * (1 - z)
        dr = dc * ghc * r * (1 - r)
        gx[t, :k] = np.concatenate([dz, dr, dc], axis=1)
        gh = np.concatenate([dz, dr, dc * r], axis=1)
        gw += old.T @ gh
        dh[:k] = d * z + gh @ wh.T
    return gx, gw


def pool(net: dict, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Attention over (T, N, 2H); the windows' logits."""
    u = np.tanh(states @ net["attend"])
    e = u @ net["ask"]
    e = np.where(np.arange(states.shape[0])[:, None] < np.maximum(lengths, 1)[None, :], e, -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    c = np.einsum("tn,tnh->nh", a, states)
    return c @ net["out"] + net["bias"][0], (u, a, c)


def window_logits(net: dict, projected: tuple[np.ndarray, np.ndarray], rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The logits of windows over ``rows`` (row numbers of ``projected`` in text order)."""
    out, order = np.empty(len(starts), np.float32), np.argsort(-lengths, kind="stable")
    rows = rows if len(rows) else np.zeros(1, np.int64)
    for i in range(0, len(order), chunk):
        own = order[i : i + chunk]
        n, steps = lengths[own], max(1, int(lengths[own[0]]))
        at = rows[np.minimum(starts[own][None, :] + np.arange(steps)[:, None], len(rows) - 1)]
        active = (n[None, :] > np.arange(steps)[:, None]).sum(axis=1)
        states = np.concatenate([layer(projected[0][at], net["h_f"], active, False), layer(projected[1][at], net["h_b"], active, True)], axis=2)
        out[own] = pool(net, states, n)[0]
    return out


def train_step(net: dict, moments: dict, at: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray, features: tuple, step: int, rate: float) -> float:
    """One Adam step over windows ``at`` (T, N), sorted from long to short, of word numbers."""
    used, local = np.unique(at, return_inverse=True)
    local = local.reshape(at.shape)
    ids, pairs, starts = features
    stops = np.concatenate([starts[1:], [len(pairs)]])
    spans = [pairs[a:b] for a, b in zip(starts[used], stops[used])]
    own_pairs, own_starts = np.concatenate(spans), np.cumsum([0, *map(len, spans[:-1])])
    x, counts = embed(net, ids[used], own_pairs, own_starts)
    steps = at.shape[0]
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    tapes: dict[str, list] = {"f": [], "b": []}
    proj = {w: x @ net[f"x_{w}"] + net[f"b_{w}"] for w in "fb"}
    states = np.concatenate([layer(proj[w][local], net[f"h_{w}"], active, w == "b", tapes[w]) for w in "fb"], axis=2)
    logit, (u, a, c) = pool(net, states, lengths)
    p = sigmoid(logit)
    g: dict[str, np.ndarray] = {}
    dl = ((p - y) * weight / len(y)).astype(np.float32)
    g["bias"], g["out"] = dl.sum(keepdims=True), c.T @ dl
    dc = dl[:, None] * net["out"][None, :]
    ds = a[:, :, None] * dc[None, :, :]
    da = np.einsum("nh,tnh->tn", dc, states)
    de = a * (da - (a * da).sum(axis=0))
    g["ask"] = np.einsum("tn,tna->a", de, u)
    du = de[:, :, None] * net["ask"] * (1 - u * u)
    g["attend"] = np.einsum("tnh,tna->ha", states, du)
    ds += du @ net["attend"].T
    dx = np.zeros_like(x)
    for k, w in enumerate("fb"):
        dg, g[f"h_{w}"] = layer_back(tapes[w], ds[:, :, k * HIDDEN : (k + 1) * HIDDEN], net[f"h_{w}"])
        per_word = np.zeros_like(proj[w])
        np.add.at(per_word, local.ravel(), dg.reshape(-1, 3 * HIDDEN))
        g[f"x_{w}"], g[f"b_{w}"] = x.T @ per_word, per_word.sum(axis=0)
        dx += per_word @ net[f"x_{w}"].T
    g["words"], g["pairs"] = np.zeros_like(net["words"]), np.zeros_like(net["pairs"])
    np.add.at(g["words"], ids[used], dx[:, :WORD_DIM])
    spread = np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts.astype(np.int64), axis=0)
    np.add.at(g["pairs"], own_pairs, spread)
    for k, v in g.items():
        m, s = moments.setdefault(k, (np.zeros_like(net[k]), np.zeros_like(net[k])))
        m *= 0.9
        m += 0.1 * v
        s *= 0.99
        s += 0.01 * v * v
        net[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * weight).mean())


def summary(logits: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Largest and mean logit of each document; windows: how many windows each has."""
    starts = np.concatenate([[0], np.cumsum(windows)[:-1]])
    return np.stack([np.maximum.reduceat(logits, starts), np.add.reduceat(logits, starts) / windows, np.ones(len(windows))], axis=1).astype(np.float64)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray] | None:
    """The trained network, or None if a class has no document."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng, number, rows = np.random.default_rng(seed), {}, []
    held = Counter()
    for t in texts:
        own = words_of(t)
        held.update(set(own))
        rows.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
    known = {w: i + 1 for i, w in enumerate(sorted(w for w, n in held.items() if n > 1))}
    features = word_features(list(number) or [b"\x00"], known)
    # Windows side by side hold every word once; the overlapping ones serve the documents' scores below.
    every = [(k, s) for k, r in enumerate(rows) for s in windows_of(len(r), stride=WINDOW)]
    doc, start = np.array([e[0] for e in every]), np.array([e[1] for e in every])
    flat, base = np.concatenate([*rows, [0]]), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    lengths = np.array([min(WINDOW, len(rows[k]) - s) for k, s in every])
    net, moments, step = new_network(len(known) + 1, seed), {}, 0
    share = y[doc].mean()
    lasting = np.ones(len(every), bool)
    weight = np.where(y[doc] > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for epoch in range(epochs):
        if epoch:
            # A toxic document's windows need not all be toxic: go on with those that look so, one at least.
            x, _ = embed(net, *features)
            now = window_logits(net, tuple(x @ net[f"x_{w}"] + net[f"b_{w}"] for w in "fb"), flat, base[doc] + start, lengths)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, doc, now)
            lasting = (y[doc] == 0) | (now > 0) | (now >= best[doc])
        order = rng.permutation(np.flatnonzero(lasting))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            own = own[np.argsort(-lengths[own], kind="stable")]
            n, steps = lengths[own], max(1, int(lengths[own].max()))
            at = flat[np.minimum((base[doc[own]] + start[own])[None, :] + np.arange(steps)[:, None], len(flat) - 1)]
            step += 1
            train_step(net, moments, at, n, y[doc[own]], weight[own], features, step, 0.01 * 0.5**epoch)
    # The document's score from its windows: logistic regression by Newton's method.
    x, _ = embed(net, *features)
    projected = tuple(x @ net[f"x_{w}"] + net[f"b_{w}"] for w in "fb")
    starts = [windows_of(len(r)) for r in rows]
    all_starts = np.concatenate([b + s for b, s in zip(base, starts)])
    all_lengths = np.concatenate([np.minimum(WINDOW, len(r) - s) for r, s in zip(rows, starts)])
    f = summary(window_logits(net, projected, flat, all_starts, all_lengths), np.array([len(s) for s in starts]))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        w -= np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(3), f.T @ (p - y) + 1e-2 * w)
    return net | {"document": w, "known": known}


class _Words(dict):
    """word -> row of the projections; new words wait in ``fresh`` until ``fill``."""

    def __init__(self, net: dict):
        super().__init__()
        self.net, self.fresh = net, []
        self.table = [np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in "fb"]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def fill(self) -> None:
        if self.fresh:
            first = len(self) - len(self.fresh)
            while len(self) > len(self.table[0]):
                self.table = [np.concatenate([t, np.zeros_like(t)]) for t in self.table]
            x, _ = embed(self.net, *word_features(self.fresh, self.net["known"]))
            for t, w in zip(self.table, "fb"):
                t[first : len(self)] = x @ self.net[f"x_{w}"] + self.net[f"b_{w}"]
            self.fresh = []

    def restart(self) -> None:
        if len(self) > CACHE:
            self.clear()


def score_texts(words: _Words, texts: list[str]) -> np.ndarray:
    words.restart()
    rows, counts = [], []
    for t in texts:
        own = words_of(t)
        rows.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
        counts.append(len(own))
    words.fill()
    if not len(words):
        words[b"\x00"]  # noqa: B018  a row for windows without words
        words.fill()
    flat, base = np.concatenate([*rows, np.zeros(1, np.int64)]), np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = [windows_of(n) for n in counts]
    lengths = np.concatenate([np.minimum(WINDOW, n - s) for n, s in zip(counts, starts)])
    logits = window_logits(words.net, (words.table[0], words.table[1]), flat, np.concatenate([b + s for b, s in zip(base, starts)]), lengths)
    f = summary(logits, np.array([len(s) for s in starts]))
    return 1 / (1 + np.exp(-np.clip(f @ words.net["document"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_docs: tuple[int, int] = MAX_DOCS, max_chars: int = MAX_CHARS) -> dict[str, np.ndarray] | None:
    """Fits on labelled documents that are not held out: up to ``max_docs`` of each class (clean,
    toxic), those of smallest hash, in that order as long as they have ``max_chars`` together."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs[k]) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most sum(max_docs) rows of two numbers
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    held = staged(found, "toxicity-sample")
    upto = F.sum(F.length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample only
    rows = held.select("doc_id", "text", "toxic", upto.alias("upto")).where(F.col("upto") <= max_chars).select("doc_id", "text", "toxic").collect()
    forget(held)
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, net: dict[str, np.ndarray] | None, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and the score as ``out``. Inside, columns go by place, so their names may be any."""
    own = [f"c{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own)), F.col("text").alias("t"))
    named = [F.col(k).alias(c) for c, k in zip(keep, own)]
    if net is None:
        return src.select(*named, F.lit(0.0).alias(out))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("s", T.DoubleType(), False)])
    sent = with_workers(docs.sparkSession).sparkContext.broadcast(net)
    key = str(sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = engine(("toxicity", key), lambda: _Words(sent.value))
        for whole in batches:
            for batch in slices(whole, "t", 2 << 20):
                got = score_texts(words, list(texts_of(batch, "t")))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got)], names=[*own, "s"])

    return src.mapInArrow(run, schema).select(*named, F.col("s").alias(out))
