"""Byte-level BPE in numpy: texts to token ids and back, by a file of ranked tokens.

Each match of the split pattern is merged on its own.  A worker keeps the pieces it has met; new ones are
encoded together: sorted into buckets by length, each bucket a padded matrix of ids in which every row
merges its leftmost pair of the smallest rank each round.  Pairs are looked up in an open-addressing table.
Rows without a pair left are taken out, and the matrix narrows as rows get shorter.  Pieces too long for a
matrix are merged one by one with a heap, to the same result.

Cases: null texts are empty; an empty text has no ids; repeated rows are encoded alike; a null id is kept;
other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.work import take, text_pieces, tidied

PIECE = 1 << 20
#: Pieces that a worker remembers; beyond them it forgets all and goes on.
REMEMBERED = 200_000
#: Bytes of a piece up to which it takes part in a matrix, and cells of a matrix.
LONGEST, CELLS = 512, 1 << 19
_NONE = np.iinfo(np.int32).max


class PairTable:
    """From two token ids to the id that they merge to, by hashing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * len(pairs) + 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        key = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            spots, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[spots], self.values[spots] = key[put], value[put]
            left = np.ones(len(key), dtype=bool)
            left[put] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, a large number where there is none; ids below 0 are padding."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.shape, _NONE, dtype=np.int32)
        flat = out.reshape(-1)
        at = np.flatnonzero((a.reshape(-1) >= 0) & (b.reshape(-1) >= 0))
        key = key.reshape(-1)[at]
        slot = self._slot(key)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return out


class Codec:
    """The tokens of one rank file with the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern, regex.V0).findall
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.byte < 0).any():
            raise ValueError("the rank file must hold all single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.merge = pairs, PairTable(pairs)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.flat, self.ends = np.empty(1 << 16, dtype=np.int32), [0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and their bounds by text."""
        cut = [self.split(t) for t in texts]
        pieces = [p for c in cut for p in c]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list({p for p in pieces if p not in self.known})
        if new:
            ids, bounds = self._encode_pieces([p.encode() for p in new])
            base = self.ends[-1]
            while base + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            self.flat[base : base + len(ids)] = ids
            first = len(self.ends) - 1
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.ends.extend((bounds[1:] + base).tolist())
        which = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        ends = np.array(self.ends, dtype=np.int64)
        begin, length = ends[which], ends[which + 1] - ends[which]
        total = np.concatenate(([0], np.cumsum(length)))
        per_text = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        return self.flat[_ragged(begin, length)], total[per_text]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all runs of ids together, and their bounds."""
        length = self.size[ids]
        total = np.concatenate(([0], np.cumsum(length)))
        return self.bytes[_ragged(self.start[ids], length)], total[bounds]

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                done[i] = (whole,)
            elif len(p) > LONGEST:
                done[i] = self._merge_long(p)
            else:
                buckets.setdefault(-(-len(p) // 4) * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part], width), strict=True):
                    done[i] = ids
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in done]))).astype(np.int64)
        return (np.concatenate(done).astype(np.int32) if done else np.empty(0, dtype=np.int32)), bounds

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[np.arange(width) < length[:, None]] = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self.merge(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), [None] * n
        while True:
            spot = rank.argmin(axis=1)
            best = rank[np.arange(len(spot)), spot]
            over = best == _NONE
            if over.any():
                for r in np.flatnonzero(over):
                    out[row[r]] = ids[r, : length[row[r]]].copy()
                on = ~over
                row, ids, rank, spot, best = row[on], ids[on], rank[on], spot[on], best[on]
            if not len(row):
                return out
            length[row] -= 1
            width = int(length[row].max())
            here = np.arange(len(row))
            ids[here, spot] = best
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > spot[:, None]), axis=1) if width < ids.shape[1] else ids
            pair = np.arange(max(width - 1, 1))
            rank = np.take_along_axis(rank, np.minimum(pair + (pair > spot[:, None]), rank.shape[1] - 1), axis=1)
            if width == 1:
                rank[:] = _NONE
                continue
            left = spot > 0
            rank[here[left], spot[left] - 1] = self.merge(ids[here[left], spot[left] - 1], ids[here[left], spot[left]])
            right = spot < width - 1
            rank[here[right], spot[right]] = self.merge(ids[here[right], spot[right]], ids[here[right], spot[right] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := pairs.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (q, i, r, ids[after[j]]))
            if (k := before[i]) >= 0 and (q := pairs.get((ids[k], r))) is not None:
                heapq.heappush(heap, (q, k, ids[k], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes ``start[i] .. start[i] + length[i]`` of all i in a row."""
    total = int(length.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    some = length > 0
    start, length = start[some], length[some]
    out = np.ones(total, dtype=np.int64)
    out[0] = start[0]
    edge = np.cumsum(length)[:-1]
    out[edge] = start[1:] - (start[:-1] + length[:-1]) + 1
    return np.cumsum(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def codec(name: str, pattern: str | None = None) -> Codec:
    """The codec of a public tokenizer's rank file, which every machine reads from its own installation."""
    import public_tokenizers

    return Codec(read_ranks(public_tokenizers.path(name)), pattern or public_tokenizers.PATTERN)


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """One row for each input row: ``id_col``, ``ids`` and ``decoded``, the bytes that the ids stand for."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in batches:
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                data = raw.tobytes()
                ids, bounds = own.encode([data[at[i] : at[i + 1]].decode() for i in range(stop - first)])
                back, edges = own.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "id", np.arange(first, stop)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.Array.from_buffers(pa.binary(), stop - first, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(back)])],
                    names=["id", "ids", "decoded"],
                )
        own._forget()  # the worker may go on to other tasks

    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return base.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)
