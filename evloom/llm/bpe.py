"""Byte-level BPE encoding and decoding by matrix rounds over distinct pieces."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evloom.llm.hashing import mix
from evloom.llm.vocabulary import parse_ranks

_NONE = np.int64(1 << 40)  # rank of a pair that is no token
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WIDE = 96
_PIECES = 100_000
_CACHED = 300_000


class Merges:
    """Pair (left id, right id) -> id of their concatenation, in an open-addressing table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.uint64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64),) * 3
        bits = max(4, int(4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _FREE), np.full(1 << bits, _NONE)
        key = (left << np.uint64(32)) | right
        slot = mix(key) >> self.shift
        while len(key):  # a slot goes to the first that asks for it; the others move on by one
            free = np.flatnonzero(self.keys[slot] == _FREE)
            slots, first = np.unique(slot[free], return_index=True)
            self.keys[slots], self.values[slots] = key[free[first]], rank[free[first]].astype(np.int64)
            rest = self.keys[slot] != key
            key, rank, slot = key[rest], rank[rest], (slot[rest] + np.uint64(1)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; negative ids are padding and pair with nothing."""
        shape = left.shape
        key = ((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        out = np.full(key.shape, _NONE)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = mix(key[todo]) >> self.shift
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != _FREE)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(shape)

    def encode_equal(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bit) of pieces in one padded matrix.

        In every round each row merges its leftmost pair of minimum rank, its tail moves up by one, and
        only the two ranks next to the merge are looked up again; rows without a pair leave the matrix.
        """
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], -1)
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 1), _NONE)
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            done = np.flatnonzero(best == _NONE)
            if len(done):
                for r, n, line in zip(row[done], length[done], ids[done].astype("<u4")):
                    out[r] = line[:n].tobytes()
                left = np.flatnonzero(best != _NONE)
                row, ids, length, ranks, at, best = row[left], ids[left], length[left], ranks[left], at[left], best[left]
                if not len(row):
                    break
                width = int(length.max())
                ids, ranks = ids[:, :width], ranks[:, :width - 1]
            every, column = np.arange(len(row)), np.arange(ids.shape[1])
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1)], 1)
            ids = np.where(column > at[:, None], moved, ids)
            ids[every, at] = best
            gone = np.concatenate([ranks[:, 1:], np.full((len(row), 1), _NONE)], 1)
            ranks = np.where(column[:-1] > at[:, None], gone, ranks)
            after = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[every, np.minimum(at, ranks.shape[1] - 1)] = np.where(at + 1 < ids.shape[1], self.rank(ids[every, at], ids[every, after]), _NONE)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])
            length -= 1
        return out

    def encode_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap over a linked list: matrix rounds would cost its length squared."""
        ids = [int(self.single[b]) for b in piece]
        tokens = [piece[i:i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.ranks.get
        heap = [(r, i, 1, 1) for i in range(len(ids) - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if len(tokens[i]) != a or j >= len(ids) or len(tokens[j]) != b:
                continue  # one of the two has been merged since
            ids[i], tokens[i] = r, tokens[i] + tokens[j]
            ids[j], tokens[j] = -1, b""
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (r := get(tokens[x] + tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, len(tokens[x]), len(tokens[y])))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, in matrices of pieces of like length."""
        found: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            if len(raw) > _WIDE:
                found[piece] = self.encode_long(raw)
            else:
                buckets.setdefault(len(raw) if len(raw) < 16 else 16 + len(raw) // 8, []).append((piece, raw))
        for bucket in buckets.values():
            for start in range(0, len(bucket), 8192):
                part = bucket[start:start + 8192]
                found.update(zip([p for p, _ in part], self.encode_equal([r for _, r in part])))
        return found


@functools.lru_cache(maxsize=2)
def merges(ranks: bytes) -> Merges:
    return Merges(parse_ranks(ranks))


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each whole text as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded on its own, without special tokens. Distinct pieces of some
    hundred documents are encoded together and remembered (at most ``_CACHED`` of them per worker); a
    long text is worked off in slices of ``_PIECES`` pieces. Null and empty texts have no ids. Null
    ids, repeated rows and other columns do not matter. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, whose size does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = merges(shared.value), regex.compile(pattern)
        cache: dict[str, bytes] = {}

        def flush(work: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
            if len(cache) > _CACHED:
                cache.clear()
            missing = list({p for _, pieces in work for p in pieces if p not in cache})
            cache.update(table.encode(missing))
            for row, pieces in work:
                out[row].append(b"".join(map(cache.__getitem__, pieces)))

        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                out: list[list[bytes]] = [[] for _ in range(len(batch))]
                work, size = [], 0
                for row, text in enumerate(batch.column(1)):
                    matches = (m.group() for m in split.finditer(text.as_py() or ""))
                    while pieces := list(islice(matches, _PIECES)):
                        work.append((row, pieces))
                        size += len(pieces)
                        if size >= _PIECES:
                            flush(work, out)
                            work, size = [], 0
                flush(work, out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(x) for x in out], pa.binary())], ["__id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(
        run, f"__id {kind}, ids binary").withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ids) with the decoded bytes as ``decoded``; null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(shared.value).tokens
        for batch in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["__id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("__id"), "ids").mapInArrow(
        run, f"__id {kind}, ids binary, decoded binary").withColumnRenamed("__id", id_col)
