"""Byte-level BPE by monoid tree reduction.

A piece of text (one match of the pattern) is encoded by halves: encode the left half, encode
the right half, and join the two token lists. The join re-encodes a window around the seam and
grows it until the tokens outside provably stay as they are.

Why that is exact: call two neighbouring tokens *stable* if encoding their concatenation gives
back those two tokens. If every neighbouring pair of a list is stable, the list is the encoding
of its concatenation: take the first merge of the whole run that would cross a border; until
then both tokens next to that border went through the same steps as in the run over the pair
alone, so that run would have crossed it too. A join therefore only has to make the window's
own encoding meet its neighbours in stable pairs.

Decoding is the monoid homomorphism back to bytes: the halves are decoded and concatenated.

Defined cases: a null text is an empty one and gives no tokens; repeated rows give repeated
results; other columns are carried on request (``keep``), whatever their names, or ignored; an
empty table gives an empty result; a null ``doc_id`` is kept. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import engine, slices, texts_of, with_workers

#: Entries of either half of a worker's caches of pieces (up to 64 characters), of merges and of
#: subtrees: tens of MB together. They have no effect on results.
CACHE = 75_000
PARTS = 100_000
#: Windows up to this many bytes are merged by plain scans, longer ones with a heap.
SHORT = 48
#: Bytes that a leaf of the tree holds at most.
LEAF = 4
#: Documents whose ids and bytes are held at once.
ROWS = 256


class Recent(dict):
    """A cache in two halves: when the young one is full it becomes the old one, whose entries are
    dropped unless they are asked again."""

    def __init__(self, most: int = CACHE):
        super().__init__()
        self.most, self.old = most, {}

    def again(self, key):
        """What the old half holds for a key that the young one lacks."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def read_ranks(path: str) -> bytes:
    """The file of ``base64(token) rank`` lines as it is; its size is that of a fixed vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class MonoidBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._merged: Recent = Recent(PARTS)
        self._trees: Recent = Recent(PARTS)

    # -- the plain merge loop, used on windows only --------------------------------------
    def merge(self, data: bytes) -> tuple[bytes, ...]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        if len(data) > SHORT:
            return self._heap(data)
        found = self._merged.get(data) or self._merged.again(data)
        if found is None:
            found = self._scan(data)
            self._merged.put(data, found)
        return found

    def _scan(self, data: bytes) -> tuple[bytes, ...]:
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        pairs = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
        return tuple(parts)

    def _heap(self, data: bytes) -> tuple[bytes, ...]:
        n, rank = len(data), self.ranks.get
        end, before, after, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            live[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = after[i]
        return tuple(out)

    # -- the monoid ------------------------------------------------------------------------
    def stable(self, a: bytes, b: bytes) -> bool:
        return len(m := self.merge(a + b)) == 2 and m[0] == a

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """Pairs within ``left`` and within ``right`` are stable already, so only new pairs are asked."""
        window = self.merge(left[-1] + right[0])
        if len(window) == 2 and window[0] == left[-1]:
            return left + right  # the seam is stable as it is
        i = j = 1
        while True:
            fits_left = i == len(left) or window[0] == left[-i] or self.stable(left[-i - 1], window[0])
            fits_right = j == len(right) or window[-1] == right[j - 1] or self.stable(window[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + window + right[j:]
            if not fits_left:
                i = min(len(left), i + max(1, i // 2))
            if not fits_right:
                j = min(len(right), j + max(1, j // 2))
            window = self.merge(b"".join(left[-i:] + right[:j]))

    def tree(self, data: bytes) -> tuple[bytes, ...]:
        n = len(data)
        if n <= LEAF or (data in self.ranks and len(self.merge(data)) == 1):
            return self.merge(data)
        if n > 2 * LEAF:
            return self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
        found = self._trees.get(data) or self._trees.again(data)
        if found is None:
            found = self.join(self.merge(data[: n // 2]), self.merge(data[n // 2 :]))
            self._trees.put(data, found)
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else [self.ranks[t] for t in self.tree(data)]


def decode_tree(ids: np.ndarray, tokens: np.ndarray) -> bytes:
    """Decodes halves and concatenates them; runs of up to 1,024 ids are leaves."""
    if len(ids) <= 1024:
        return b"".join(tokens[ids])
    half = len(ids) // 2
    return decode_tree(ids[:half], tokens) + decode_tree(ids[half:], tokens)


class _Pieces(Recent):
    """piece -> packed ids."""

    def __init__(self, bpe: MonoidBpe):
        super().__init__(CACHE)
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("i", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            self.put(piece, found)
        return found


class Tokenizer:
    """What a worker holds for one vocabulary: pieces' packed ids, and the bytes of each id."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = parse_ranks(raw)
        self.pieces, self.cut = _Pieces(MonoidBpe(ranks)), regex.compile(pattern)
        self.tokens = np.full(max(ranks.values(), default=-1) + 1, b"", object)
        for t, i in ranks.items():
            self.tokens[i] = t

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return decode_tree(ids, self.tokens)


def _tokenizer(raw: bytes, pattern: str) -> Tokenizer:
    return engine(("bpe", len(raw), hash(raw), pattern), lambda: Tokenizer(raw, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` of every row; with ``decoded``, also the bytes that the ids decode to.

    ``vocabulary`` is the path of a ranks file on the driver; its content (of fixed size) is
    sent to the workers once. Inside, columns go by place, so their names may be any.
    """
    spark = with_workers(docs.sparkSession)
    sent = spark.sparkContext.broadcast(read_ranks(vocabulary))
    own = [f"c{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own)), F.col(f"`{text}`").alias("t"))
    back = decoded is not None
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *([T.StructField("back", T.BinaryType(), False)] if back else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(sent.value, pattern)
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20, ROWS):
                packed = [np.frombuffer(tok.encode(x), np.int32) for x in texts_of(batch, "t")]
                ends = np.cumsum([0, *map(len, packed)])
                cols = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*packed, np.zeros(0, np.int32)])))]
                if back:
                    cols.append(pa.array([tok.decode(x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    named = [F.col(k).alias(c) for c, k in zip(keep, own)]
    return src.mapInArrow(run, schema).select(*named, F.col("ids").alias(ids), *([F.col("back").alias(decoded)] if back else []))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded bytes; null ids decode to no bytes."""
    spark = with_workers(encoded.sparkSession)
    sent = spark.sparkContext.broadcast(read_ranks(vocabulary))
    names, at = encoded.columns, encoded.columns.index(ids)
    own = [f"c{i}" for i in range(len(names))]
    src = encoded.toDF(*own)
    schema = T.StructType([*src.schema.fields, T.StructField("back", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(sent.value, "")
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                got = [tok.decode(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema).toDF(*names, out)
