"""Exact ranked search without a document index: an automaton of all item terms scans every text."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evloom.llm.tables import written

#: Terms are maximal runs of ASCII letters, ASCII digits and everything above ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule on UTF-8 bytes: A-Z fold, every separator becomes the guard.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GUARD = b" "
_STEP = 1 << 20
_BLOCK_BYTES = 1 << 20
_CELLS = 1 << 21
_SALTS = 32


def item_terms(text: Column) -> Column:
    """The distinct terms of a text; a null text has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({TERM})"), F.lit(1)))


def _steps(texts: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """Folded texts with their numbers, a megabyte at a time; a longer text is cut at a guard."""
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0
    for number in range(len(texts)):
        text = (texts[number].as_py() or b"").translate(_FOLD)
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > _STEP:
                gap = text.rfind(_GUARD, start + 1, start + _STEP)
                gap = gap if gap > 0 else text.find(_GUARD, start + _STEP)
                end = gap if gap > 0 else end
            numbers.append(number)
            parts.append(text[start:end])
            size += end - start
            start = end
            if size >= _STEP:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


class TermScan:
    """Counts of fixed terms in texts. Guards on both sides of a term are part of its pattern, so that only whole terms match."""

    def __init__(self, terms: list[str]) -> None:
        self.n_terms = len(terms)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            # UTF-8 bytes as one-byte characters: texts stay compact, and no match can begin inside a character
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", number)
        if terms:
            self.automaton.make_automaton()

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term, occurrences) by text then term, and the number of terms of every text."""
        lengths = np.zeros(len(texts), np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for numbers, parts in _steps(texts):
            joined = _GUARD + _GUARD.join(parts) + _GUARD
            owners = np.array(numbers)
            ends = np.cumsum([len(p) + 1 for p in parts])
            solid = np.frombuffer(joined, np.uint8) != 32
            begins = np.flatnonzero(solid[1:] & ~solid[:-1])
            np.add.at(lengths, owners, np.diff(np.searchsorted(begins, np.append(0, ends))))
            if self.n_terms:
                found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2)
                owner = owners[np.searchsorted(ends, found[:, 0] - 1, "right")]
                key, count = np.unique(owner * self.n_terms + found[:, 1], return_counts=True)
                keys.append(key)
                counts.append(count)
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        return key // max(1, self.n_terms), key % max(1, self.n_terms), total, lengths


def _scanned(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document: its number of terms, the item terms it holds and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermScan(shared.value)
        for batch in batches:
            owner, term, count, lengths = terms.count(batch.column("__text"))
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(lengths), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(count))], names=["__id", "n", "terms", "counts"])

    schema = T.StructType([docs.schema["__id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.LongType()))])
    return written(docs.mapInArrow(scan, schema), "scanned")


class ItemScores:
    """Integer scores of documents for the items of a block, and the best of them per item."""

    def __init__(self, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, n_docs: int, n_words: int, k: int) -> None:
        self.weights, self.first, self.items, self.n_items, self.k = weights, first, items, n_items, k
        self.n_docs, self.n_words = n_docs, max(1, n_words)
        #: A score that k documents of this task are known to reach.
        self.floor = np.ones(n_items, np.int64)

    def matrix(self, lengths: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        norm = 50 + (50 * lengths * self.n_docs) // self.n_words
        share = self.weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * norm[owner]))
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        scores = np.zeros(len(lengths) * self.n_items, np.int64)
        np.add.at(scores, np.repeat(owner, many) * self.n_items + self.items[at], np.repeat(share, many))
        return scores.reshape(len(lengths), self.n_items)

    def best(self, scores: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the k best rows of each item, ties by ``order``; rows that k earlier ones beat are left out."""
        if len(scores) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=0)[-self.k])
        row, item = np.nonzero(scores >= self.floor)
        by = np.lexsort((order[row], -scores[row, item], item))
        row, item = row[by], item[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        return row[place < self.k], item[place < self.k]


def _ranked(scanned: DataFrame, scores: ItemScores, keys: np.ndarray) -> DataFrame:
    """The best documents of every Arrow batch for every item of the block."""
    shared = scanned.sparkSession.sparkContext.broadcast((scores, keys))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, keys = shared.value
        scores.floor = np.ones(scores.n_items, np.int64)
        step = max(1, _CELLS // max(1, scores.n_items))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids, terms = batch.column("__id"), batch.column("terms")
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                owner = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy())
                matrix = scores.matrix(batch.column("n").to_numpy(), owner, terms.flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
                row, item = scores.best(matrix, order)
                yield pa.RecordBatch.from_arrays([pa.array(keys[item]), ids.take(pa.array(row)), pa.array(matrix[row, item])],
                                                 names=["__item", "doc_id", "score"])

    kind = scanned.schema["__id"].dataType
    schema = T.StructType([T.StructField("__item", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    return scanned.mapInArrow(rank, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of highest score for every item: item_id, rank, doc_id, score; ties by ascending id.

    Items are dealt into blocks of about ``block_bytes`` of terms, so that what a task holds is bounded
    however many items there are; every block is one scan of all whole texts. Per task only rows that may
    be among an item's first ``k`` leave the scan, in batches; the rest of the ranking is done by Spark.

    Null texts have no terms and are never returned. Items without terms, or with terms that no document
    holds, have no rows. Item rows that share an id are one item. Repeated document rows are ranked each;
    a null document id comes last among ties. Other columns of both tables are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("__id"), F.encode(F.col(text_col), "UTF-8").alias("__text"))
    told = (items.select(F.col(item_col).alias("item_id"), F.explode(item_terms(F.col(item_text_col))).alias("term"))
            .groupBy("item_id").agg(F.collect_set("term").alias("terms")).withColumn("__item", F.monotonically_increasing_id()))
    told = written(told, "items")
    size = told.agg(F.sum(F.aggregate("terms", F.lit(0), lambda s, t: s + F.octet_length(t) + 16))).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    found, totals = [], None
    for number in range(blocks):
        held = told.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == number).select("__item", "terms").orderBy("__item").collect()
        if not held:
            continue
        terms = sorted(set().union(*(r["terms"] for r in held)))
        place = {t: n for n, t in enumerate(terms)}
        pairs = np.array(sorted((place[t], n) for n, r in enumerate(held) for t in r["terms"]), np.int64)
        scanned = _scanned(texts, terms)
        totals = totals or scanned.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(terms), np.int64)
        for row in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row["term"]] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * row["count"] + 1)))
        scores = ItemScores(weights, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1], len(held), totals[0], totals[1], k)
        found.append(_ranked(scanned, scores, np.array([r["__item"] for r in held], np.int64)))
    if not found:
        empty = told.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
        return empty.join(texts.select(F.col("__id").alias("doc_id")).limit(0)).select("item_id", "rank", "doc_id", "score")
    # salted first, so that the rows of an item need not meet in one task
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("__item", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).orderBy(*by_score)
    place = F.row_number().over(Window.partitionBy("__item").orderBy(*by_score))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(told.select("__item", "item_id"), "__item").select("item_id", "rank", "doc_id", "score")
