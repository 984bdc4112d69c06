"""Substring deduplication: hash normalised units globally, keep the first occurrence, remove repeated runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.tables import keyed, written

#: Sentence marks that a space follows, marks of scripts that write none, and line breaks.
_SENTENCE_END = re.compile(r"[.!?\u061f\u06d4\u0964\u0965]+\s+|[\u3002\uff01\uff1f\uff0e]+\s*|\n+")


def split_units(text: str, unit_words: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text; together they cover it.

    A unit ends at a line break, or at a sentence end once it holds ``unit_words`` words. With one word, as by default,
    every sentence is a unit, so that the first sentence of a passage does not depend on what stands before it. The digest,
    of 128 bits, ignores case and the kind of white space.
    """
    units, start = [], 0
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[start:end].split()
        if len(words) >= unit_words or text[end - 1:end] == "\n" or end == len(text):
            if words:
                units.append((start, end, len(words), xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "replace"))))
                start = end
    return units


def repeated_runs(units: list[tuple[int, int, int, bytes]], repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """Spans (start, end) of maximal runs of repeated units with at least ``min_words`` words."""
    spans, words, start, end = [], 0, None, 0
    for k, (unit_start, unit_end, n, _) in enumerate([*units, (0, 0, 0, b"")]):
        if k < len(units) and k in repeated:
            start, end, words = unit_start if start is None else start, unit_end, words + n
        else:
            if start is not None and words >= min_words:
                spans.append((start, end))
            start, words = None, 0
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, unit_words: int = 1) -> DataFrame:
    """(id, text, n_units, n_removed_chars, removed) for every row of ``docs``.

    Units are sentences (at least ``unit_words`` words where the line allows it). A unit is repeated
    if the same normalised unit stands earlier, ordered by id, then content hash, then position;
    consecutive repeated units of at least ``min_words`` words in all are cut out, in every document but the first:
    a single sentence or line of so many words is enough, shorter ones go as part of a run. ``removed`` lists
    their offsets in the original text. The earliest occurrence always stays. Half a sentence is no unit: where a passage starts
    or ends within a sentence, its outer words stay.

    Null or empty text: no units, text unchanged. Null ids rank first. Rows that share id and text
    share the result. An empty table gives an empty table. Other columns are ignored.

    Only digests are grouped, with map-side combine, so a sentence that a third of all documents
    share is one partial row per task; the join back to its occurrences may be split.
    """
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[u[3] for u in split_units(t, unit_words)] if isinstance(t, str) else [] for t in batch["__text"]]
            yield pd.DataFrame({"__id": batch["__id"], "__th": batch["__th"], "__units": found})

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes, lost, removed = [], [], [], []
            for text, positions in zip(batch["__text"], batch["__positions"]):
                spans: list[tuple[int, int]] = []
                units = split_units(text, unit_words) if isinstance(text, str) else []
                if positions is not None and len(positions):
                    spans = repeated_runs(units, set(positions), min_words)
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text)
                sizes.append(len(units))
                lost.append(sum(b - a for a, b in spans))
                removed.append([{"start": a, "length": b - a} for a, b in spans])
            yield pd.DataFrame({"__id": batch["__id"], "text": texts, "n_units": sizes, "n_removed_chars": lost, "removed": removed})

    source = keyed(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    # split once: both the grouping and the join back read the digests, sixteen bytes a unit
    units = (written(source.mapInPandas(digests, f"__id {id_type}, __th bigint, __units array<binary>"), "units")
             .select("__id", "__th", F.posexplode("__units").alias("__pos", "__h")))
    place = F.struct("__id", "__th", "__pos")
    # written, so that both sides of the join are dealt by it alone and a hot digest may be split
    first = written(units.groupBy("__h").agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
                    .where("__n > 1").select("__h", "__first"), "firsts")
    later = units.join(first, "__h").where(~place.eqNullSafe(F.col("__first")))
    marked = (later.groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__positions"))
              .withColumnRenamed("__id", "__mid").withColumnRenamed("__th", "__mth"))
    joined = source.join(marked, (source["__th"] == marked["__mth"]) & source["__id"].eqNullSafe(marked["__mid"]), "left")
    done = joined.select("__id", "__text", "__positions").mapInPandas(
        cut_out, f"__id {id_type}, text string, n_units bigint, n_removed_chars bigint, removed array<struct<start:bigint,length:bigint>>")
    return done.withColumnRenamed("__id", id_col)
