"""Hard negatives by exact inner products: length buckets with sorted coordinate lists cut the candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.llm.tables import written

_BUCKET = 4096
_FOCUS = 5
#: Components of rows and of anchors that meet in one task.
_SHARD_COMPONENTS = 2_000_000
_BLOCK_COMPONENTS = 500_000
_SLACK = 1e-9


class LengthBuckets:
    """Vectors of one dimension, longest first, in buckets; every coordinate of a bucket has a sorted list, made when first needed."""

    def __init__(self, vectors: np.ndarray, size: int = _BUCKET) -> None:
        lengths = np.sqrt((vectors ** 2).sum(1))
        self.order = np.argsort(-lengths, kind="stable")
        self.vectors, self.lengths = vectors[self.order], lengths[self.order]
        self.units = np.divide(self.vectors, self.lengths[:, None], out=np.zeros_like(self.vectors), where=self.lengths[:, None] > 0)
        self.starts = range(0, len(vectors), size)
        self.size = size
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        #: Vectors whose product was computed, of all that were asked about.
        self.verified = self.asked = 0

    def _sorted(self, start: int, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, coordinate) not in self.lists:
            values = self.units[start:start + self.size, coordinate]
            order = np.argsort(values, kind="stable")
            self.lists[start, coordinate] = values[order], order + start
        return self.lists[start, coordinate]

    def _feasible(self, start: int, unit: np.ndarray, cosine: float, focus: np.ndarray) -> np.ndarray:
        """Rows of the bucket whose focus coordinates all allow that cosine with ``unit``."""
        # a vector within the angle of the anchor lies, on each axis, between the cosines of the sum and the difference of the angles
        angle, own = math.acos(min(1.0, cosine)), np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(math.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + _SLACK
        spans = []
        for coordinate, at_least, at_most in zip(focus, low, high):
            values, rows = self._sorted(start, coordinate)
            spans.append((np.searchsorted(values, at_least, "left"), np.searchsorted(values, at_most, "right"), rows))
        widths = [to - of for of, to, _ in spans]
        first = int(np.argmin(widths))
        of, to, rows = spans[first]
        found = rows[of:to]
        if widths[first] == min(self.size, len(self.vectors) - start):
            return found
        for n in np.argsort(widths):
            if n != first and len(found):
                values = self.units[found, focus[n]]
                found = found[(values >= low[n]) & (values <= high[n])]
        return found

    def _seeds(self, start: int, unit: np.ndarray, focus: np.ndarray, many: int) -> np.ndarray:
        """Rows at the favourable ends of the focus lists."""
        ends = [self._sorted(start, c)[1][-many:] if unit[c] > 0 else self._sorted(start, c)[1][:many] for c in focus]
        return np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)

    def probe(self, anchor: np.ndarray, floor: Callable[[], float], take: Callable[[np.ndarray, np.ndarray], None], many: int = 8) -> None:
        """Give ``take`` every row (by its original number) whose product with ``anchor`` may reach ``floor()``, with the exact product."""
        length = math.sqrt(float((anchor ** 2).sum()))
        unit = anchor / length if length else anchor
        focus = np.argsort(-np.abs(anchor), kind="stable")[:_FOCUS]
        exact = length * (self.lengths[0] if len(self.lengths) else 0) < 2 ** 53
        whole = anchor.astype(np.int64)

        def verify(rows: np.ndarray) -> None:
            self.verified += len(rows)
            products = self.vectors[rows] @ anchor if exact else self.vectors[rows].astype(np.int64) @ whole
            take(self.order[rows], products.astype(np.int64))

        for start in self.starts:
            bucket = np.arange(start, min(start + self.size, len(self.vectors)))
            self.asked += len(bucket)
            least, most = floor(), length * self.lengths[start]
            if least > 0 and least > most * (1 + _SLACK):
                self.asked += len(self.vectors) - bucket[-1] - 1
                return
            seeds = np.zeros(0, np.int64)
            if start == 0 and length and len(bucket) > 4 * many * _FOCUS:
                seeds = self._seeds(start, unit, focus, many)
                verify(seeds)
                least = floor()
            if least > 0 and most > 0:
                bucket = self._feasible(start, unit, least / most * (1 - _SLACK), focus)
            verify(np.setdiff1d(bucket, seeds, assume_unique=True) if len(seeds) else bucket)


class Best:
    """The ``k`` best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.ids = self.scores = np.zeros(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.scores) == self.k:
            near = scores >= self.scores[-1]
            ids, scores = ids[near], scores[near]
        if len(ids):
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            first = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[first], scores[first]


def _by_dimension(rows: pa.Table, anchors: pa.Table):
    """(rows, anchors, row vectors, anchor vectors, labels of both as numbers) of every dimension that both have."""
    labels = pa.chunked_array([*rows["label"].chunks, *anchors["label"].chunks], rows.schema.field("label").type).combine_chunks()
    codes = labels.dictionary_encode().indices.to_numpy() if len(labels) else np.zeros(0, np.int64)
    sizes = [pc.list_value_length(t["v"]).to_numpy() for t in (rows, anchors)]
    for dimension in np.intersect1d(*sizes):
        at = [np.flatnonzero(s == dimension) for s in sizes]
        chosen = [t.take(pa.array(i)) for t, i in zip((rows, anchors), at)]
        vectors = [pc.list_flatten(t["v"]).to_numpy().astype(np.float64).reshape(len(i), dimension) for t, i in zip(chosen, at)]
        yield (*chosen, *vectors, codes[at[0]], codes[len(rows) + at[1]])


def nearest_of_label(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Of the rows, the first ``k`` of every anchor's label other than the anchor: row, id, score."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for some, asking, vectors, queries, label, wanted in _by_dimension(rows, anchors):
        ids, own, keys = some["id"].to_numpy(), asking["id"].to_numpy(), asking["row"].to_numpy()
        indexes: dict[int, tuple[np.ndarray, LengthBuckets]] = {}
        for n, query in enumerate(queries):
            if wanted[n] not in indexes:
                at = np.flatnonzero(label == wanted[n])
                indexes[wanted[n]] = at, LengthBuckets(vectors[at])
            at, index = indexes[wanted[n]]
            best = Best(k)

            def take(found: np.ndarray, scores: np.ndarray) -> None:
                others = ids[at[found]] != own[n]
                best.add(ids[at[found[others]]], scores[others])

            index.probe(query, best.floor, take)
            out.append((np.full(len(best.ids), keys[n]), best.ids, best.scores))
    return pa.table(dict(zip(("row", "id", "score"), map(np.concatenate, zip(*out)))))


def hard_of_other_labels(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """Of the rows, the first ``k`` of other labels in the score range of every anchor's every positive: row, place, id, score."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for some, asking, vectors, queries, label, wanted in _by_dimension(rows, anchors):
        ids, keys, index = some["id"].to_numpy(), asking["row"].to_numpy(), LengthBuckets(vectors)
        for n, query in enumerate(queries):
            # the range of a negative score is empty
            goals = [(place, score, Best(k)) for place, score in enumerate(asking["scores"][n].as_py(), 1) if score >= 0]
            if not goals:
                continue

            def floor() -> float:
                return min(max(best.floor(), low * score / 100) for _, score, best in goals)

            def take(found: np.ndarray, scores: np.ndarray) -> None:
                others = label[found] != wanted[n]
                found, scores = found[others], scores[others]
                for _, score, best in goals:
                    fit = (100 * scores >= low * score) & (100 * scores <= high * score)
                    best.add(ids[found[fit]], scores[fit])

            index.probe(query, floor, take)
            out += [(np.full(len(best.ids), keys[n]), np.full(len(best.ids), place, np.int32), best.ids, best.scores) for place, _, best in goals]
    return pa.table(dict(zip(("row", "place", "id", "score"), map(np.concatenate, zip(*out)))))


def _met(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, found: Callable, schema: str) -> DataFrame:
    """Every shard of rows meets every block of anchors in a task of its own, of bounded size."""
    def cells(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = rows.withColumn("shard", dealt(shards)).withColumn("block", cells(blocks)).groupBy("shard", "block")
    right = anchors.withColumn("block", dealt(blocks)).withColumn("shard", cells(shards)).groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(found, schema)


def mine(rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_components: int = _SHARD_COMPONENTS,
         block_components: int = _BLOCK_COMPONENTS) -> DataFrame:
    """For every row where ``anchor`` holds and each of its positives, the best rows of other labels in a range of its score.

    A component x counts as floor(scale * x), a score is the integer inner product. Positives are the first
    ``positives`` other rows of the anchor's label; negatives are the first ``negatives`` rows of other labels
    with low / 100 <= negative score / positive score <= high / 100. Higher scores come first, then smaller ids.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors (a stated share of the rows) meet all rows in cells of bounded size that Spark deals out; inside
    a cell only rows that the coordinate lists allow are multiplied. Nothing is sampled or approximate.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do vectors
    whose scaled length is 2^28 or more, since a hundred times their scores would leave 64 bits. Ids are integers.
    Vectors meet only vectors of their own dimension, the empty one included. Rows that share an id are no
    positives of each other; otherwise repeated rows count each, repeated anchors too. Other columns are not read.
    """
    spark = rows.sparkSession
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    length = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = (rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                    scaled.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
            .where(length < 2.0 ** 56))
    kept = written(kept, "vectors")
    n, components, asked = kept.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0)),
                                    F.coalesce(F.sum(F.when(F.col("asks"), F.size("v") + 1)), F.lit(0))).first()
    parallel = 2 * spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil((components + n) / shard_components), min(parallel, math.ceil(n / 1024)))
    blocks = max(1, math.ceil(asked / block_components))
    every, anchors = kept.drop("asks"), written(kept.where("asks").drop("asks"), "anchors")

    def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = first(_met(every, anchors, shards, blocks, lambda r, a: nearest_of_label(r, a, positives), "row long, id long, score long"),
                 positives, "row")
    near = written(near, "positives")
    scores = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("scores"))
    hard = _met(every, anchors.join(scores, "row"), shards, blocks, lambda r, a: hard_of_other_labels(r, a, negatives, low, high),
                "row long, place int, id long, score long")
    chosen = first(hard, negatives, "row", "place").select("row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = near.select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (chosen.join(positive, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
