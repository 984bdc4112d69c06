"""Packing tokenised documents into sequences of equal length with balanced attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.vocabulary import encoding

GROUP_ROWS = 2048


def pack_pieces(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset) that place pieces of at most ``capacity`` tokens.

    As many sequences are opened as the tokens need. Pieces go, longest first, to the sequence of the
    lowest cost so far (``linear`` per token plus ``quadratic`` per token pair of the same piece) among
    those with room. A piece that fits nowhere is cut: its head fills the largest room and its rest
    queues again. So less than one sequence of padding remains in all.
    """
    bins = -(-sum(lengths) // capacity)
    cost, room, fill = [0.0] * bins, [capacity] * bins, [0] * bins
    ready = [(0.0, b) for b in range(bins)]
    full: list[tuple[int, int]] = []  # too little room for the current length; they return as lengths fall
    queue = [(-n, piece, 0) for piece, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    placed = []
    while queue:
        negative, piece, start = heapq.heappop(queue)
        n = -negative
        while full and -full[0][0] >= n:
            b = heapq.heappop(full)[1]
            heapq.heappush(ready, (cost[b], b))
        while ready and room[ready[0][1]] < n:
            b = heapq.heappop(ready)[1]
            heapq.heappush(full, (-room[b], b))
        if ready:
            b = heapq.heappop(ready)[1]
        else:
            b = heapq.heappop(full)[1]
            heapq.heappush(queue, (room[b] - n, piece, start + room[b]))
            n = room[b]
        placed.append((piece, start, n, b, fill[b]))
        fill[b] += n
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n
        if room[b]:
            heapq.heappush(ready, (cost[b], b))
    return placed


def pack(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024,
         added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece_cost.

    A document is its token ids (rank file content ``ranks``, splits by ``pattern``, ids under 65,536) and
    ``end_id``. Texts are split at the tokens ``added`` (text, id) first, which get their ids. Whole multiples of ``capacity`` become sequences of their own; what remains of each
    document is packed by ``pack_pieces`` in groups of about ``GROUP_ROWS`` documents, whose number
    grows with the table, so that no task holds more than one group. Groups are dealt by a hash of id
    and tokens, and equal rows within a task are spread by a running number.

    Null and empty texts are one piece, ``end_id`` alone. Rows of equal id are packed separately; a
    null id stays null. Other columns are ignored. An empty table gives no pieces.
    """
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, whose size does not depend on the data
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern, added)
        repeats: Counter[tuple] = Counter()
        for batch in batches:
            row, start, length, crc, total, group, kept = [], [], [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for number, text in enumerate(batch.column(1)):
                tokens = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                n = len(tokens)
                whole = zlib.crc32(tokens.tobytes())
                key = zlib.crc32(f"{ids[number]} {whole}".encode())
                repeats[key] += 1
                deal = zlib.crc32(f"{key} {repeats[key]}".encode())
                for at in range(0, n, capacity):
                    part = tokens[at:at + capacity]
                    row.append(number)
                    start.append(at)
                    length.append(len(part))
                    total.append(n)
                    group.append((deal + at // capacity) % groups)
                    is_full = len(part) == capacity
                    crc.append(zlib.crc32(part.tobytes()) if is_full else None)
                    kept.append(None if is_full else part.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(group, pa.int64()), pa.array(kept, pa.binary())],
                ["__id", "start", "length", "crc", "total", "group", "ids"])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("__id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths, starts = table["length"].to_pylist(), table["start"].to_pylist()
        known, ids = table["crc"].to_pylist(), table["ids"].to_pylist()
        base = table["group"][0].as_py() << 32
        out = []
        for piece, begin, n, sequence, offset in pack_pieces(lengths, capacity, linear, quadratic):
            crc = known[piece]
            if crc is None:
                crc = zlib.crc32(np.frombuffer(ids[piece], "<u2")[begin:begin + n].astype("<u4").tobytes())
            out.append((piece, starts[piece] + begin, n, crc, base + sequence, offset, linear * n + quadratic * n * n))
        columns = list(zip(*out))
        taken = pa.array(columns[0], pa.int64())
        kinds = [pa.int64()] * 3
        return pa.table([table["__id"].take(taken), *(pa.array(c, t) for c, t in zip(columns[1:4], kinds)), table["total"].take(taken),
                         pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.float64())],
                        ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_cost"])

    cut = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        pieces, f"__id {id_type}, start bigint, length bigint, crc bigint, total bigint, group bigint, ids binary")
    return cut.groupBy("group").applyInArrow(
        fill, f"__id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, piece_cost double"
    ).withColumnRenamed("__id", id_col)
