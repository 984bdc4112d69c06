"""Chat formatting by token-level assembly, and reading formatted conversations back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.vocabulary import encoding, parse_ranks

#: Control strings of the template and their reserved ids, above every id of the vocabulary.
BEGIN, END, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
RESERVED = {BEGIN: 60_000, END: 60_001, ROLE: 60_002, TEXT: 60_003}
_FIRST = min(RESERVED.values())
#: Strings that other templates give a meaning are escaped too.
CONTROLS = (*RESERVED, "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_ESCAPE = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PART = 1 << 20


def escape(text: str) -> str:
    """A text in which no control string occurs: each is broken by a backslash after its first character."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_conversations(turns: DataFrame, ranks: bytes, pattern: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, part, ids, mask): the formatted token sequence of every conversation.

    A conversation is ``<s>`` and, per row in the order of turn, ``[INST]`` role ``[/INST]`` text ``</s>``.
    Role and text are escaped and encoded on their own, so no content can become a control id; the
    reserved ids are spliced between them. The mask is the prefix sum of +1 where a text of
    ``loss_roles`` starts and -1 where it ends. ``ids`` are little-endian unsigned 32-bit integers, ``mask`` bytes.

    Null texts and roles are empty; rows without an id form one conversation, with null as its id;
    equal turns are ordered by role, then text; repeated rows are turns of their own. Other columns are
    ignored. An empty table has no conversations. Rows are encoded where they are read; a
    conversation then streams through its task in bounded parts (usually one), so even a very long one is never held as a whole.
    """
    shared = turns.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, whose size does not depend on the data
    reserved = {k: np.array([v], "<u4") for k, v in RESERVED.items()}
    kind = turns.schema["conv_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts = [escape(role or ""), escape(text or "")]
                coded = [encoder.encode_to_numpy(p, disallowed_special=()).astype("<u4") for p in parts]
                pieces = [reserved[ROLE], coded[0], reserved[TEXT], coded[1], reserved[END]]
                starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                change = np.zeros(starts[-1] + 1, np.int8)
                if role in loss_roles:
                    np.add.at(change, starts[[3, 4]], np.array([1, -1], np.int8))
                ids.append(np.concatenate(pieces).tobytes())
                masks.append(np.cumsum(change[:-1], dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary())],
                                             ["conv_id", "turn", "role", "text", "ids", "mask"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = assemble  # no id equals it
        part = 0
        held: tuple[list[bytes], list[bytes]] = ([], [])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], id_type), pa.array([part], pa.int64()), pa.array([b"".join(held[0])], pa.binary()),
                                               pa.array([b"".join(held[1])], pa.binary())],
                                              ["conv_id", "part", "ids", "mask"])

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key is assemble or conv != key:
                    if key is not assemble:
                        ready.append(row())
                    key, part, size = conv, 0, 1
                    held = ([reserved[BEGIN].tobytes()], [b"\0"])
                elif size >= _PART:
                    ready.append(row())
                    part, size = part + 1, 0
                    held = ([], [])
                held[0].append(ids)
                held[1].append(mask)
                size += len(mask)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if key is not assemble:
            yield row()

    coded = turns.select("conv_id", "turn", "role", "text").mapInArrow(
        segments, f"conv_id {kind}, turn {turns.schema['turn'].dataType.simpleString()}, role string, text string, ids binary, mask binary")
    placed = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return placed.mapInArrow(assemble, f"conv_id {kind}, part bigint, ids binary, mask binary")


def read_turns(ids: bytes, mask: bytes, tokens: dict[int, bytes]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of every turn in one part, from token ids and mask alone."""
    flat, under = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.int8)

    def text(chosen: np.ndarray) -> str:
        return unescape(b"".join(map(tokens.__getitem__, chosen.tolist())).decode("utf-8"))

    marks = np.flatnonzero(flat >= _FIRST)
    kinds = flat[marks]
    for i in np.flatnonzero(kinds == RESERVED[ROLE]):
        a, b, c = marks[i:i + 3]
        yield text(flat[a + 1:b]), text(flat[b + 1:c]), text(flat[b + 1:c][under[b + 1:c] == 1])


def code_points(tokens: dict[int, bytes]) -> np.ndarray:
    """Code points that begin in each token, by id; a reserved id stands for its control string."""
    counts = np.zeros(max(*tokens, *RESERVED.values()) + 1, np.int64)
    for rank, token in tokens.items():
        counts[rank] = sum(b & 0xC0 != 0x80 for b in token)
    for control, rank in RESERVED.items():
        counts[rank] = len(control)
    return counts


@dataclass
class _Digest:
    turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    all: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)


def read_back(formatted: DataFrame, ranks: bytes) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), decoded from the formatted output.

    ``formatted_chars`` counts the code points of the decoded ids, template and escapes included.

    ``formatted`` comes from ``format_conversations``, whose parts stand in order in their partition.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(ranks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in parse_ranks(shared.value).items()}
        counts = code_points(tokens)
        key: object = read
        seen = _Digest()
        rows: list[tuple] = []
        id_type = None

        def close() -> None:
            rows.append((key, seen.turns, seen.all.hexdigest(), seen.loss_chars, seen.loss.hexdigest(), seen.chars))

        def out() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, part, ids, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if key is not read:
                        close()
                    key, seen = conv, _Digest()
                seen.chars += int(counts[np.frombuffer(ids, "<u4")].sum())
                for role, text, loss in read_turns(ids, mask, tokens):
                    seen.turns += 1
                    seen.all.update(f"{role}\n{text}\n".encode())
                    seen.loss.update(loss.encode())
                    seen.loss_chars += len(loss)
            if rows:
                yield out()
                rows = []
        if key is not read:
            close()
            yield out()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
