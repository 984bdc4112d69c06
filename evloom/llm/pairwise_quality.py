"""Document quality by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile as threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evloom.llm.hashing import SPACES, mix, word_hashes
from evloom.llm.tables import written
from evloom.operators.primitives import dense_index

_STEP = 1 << 21
_BLANK = np.zeros(256, bool)
_BLANK[32] = True
#: Byte classes whose shares of a text are features; what no class names is "other".
_CLASSES = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " ", "\n", ".,;:", "!?", "#*$%&|<>", "\"'()[]{}", "-_/\\@~^+=`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _n, _members in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _members]] = _n
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
#: Shares of byte classes; then words (logarithm), word length, distinct words, repeated windows of three words, repeated lines, line length.
N_FEATURES = _N_CLASSES + 6


def _repeats(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct values, and values that occur at least twice (all occurrences)."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(value)))
    return np.bincount(owner[at], minlength=n), np.bincount(owner[at], np.where(sizes > 1, sizes, 0), n)


def _hashes(texts: list[str], breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64)), *((d, w) for d, w, _ in word_hashes(texts, breaks))]
    owner, value = (np.concatenate(x) for x in zip(*found))
    return owner, value


def _described(texts: list[str]) -> np.ndarray:
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    owner = np.repeat(np.arange(n), sizes)
    classes = np.bincount(owner * _N_CLASSES + _CLASS[np.frombuffer(b"".join(raw), np.uint8)], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    owner, words = _hashes(texts, SPACES)
    # a line is one word once its blanks are another byte and its ends are blanks
    lines_of, lines = _hashes([t.replace(" ", "\x01").replace("\n", " ") for t in texts], _BLANK)
    many, rows = np.bincount(owner, minlength=n), np.bincount(lines_of, minlength=n)
    windows = mix(words[:-2] + mix(words[1:-1] + mix(words[2:]))) if len(words) > 2 else np.zeros(0, np.uint64)
    inside = owner[:-2] == owner[2:] if len(words) > 2 else np.zeros(0, bool)
    distinct, _ = _repeats(owner, words, n)
    _, again = _repeats(owner[:-2][inside] if len(words) > 2 else owner[:0], windows[inside], n)
    unique_lines, _ = _repeats(lines_of, lines, n)
    solid = sizes - classes[:, 3] - classes[:, 4]
    return np.column_stack([
        classes / np.maximum(1, sizes)[:, None], np.log1p(many), np.log1p(solid / np.maximum(1, many)), distinct / np.maximum(1, many),
        again / np.maximum(1, many - 2), (rows - unique_lines) / np.maximum(1, rows), np.log1p(sizes / np.maximum(1, rows))])


def features(texts: list[str | None]) -> np.ndarray:
    """One row of numbers per whole text; null counts as empty. Texts are described two megabytes at a time."""
    out, held, size = [np.zeros((0, N_FEATURES))], [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= _STEP:
            out.append(_described(held))
            held, size = [], 0
    if held:
        out.append(_described(held))
    return np.concatenate(out)


@dataclass
class Ranking:
    """Scores on the Bradley-Terry scale: the difference of two scores is the log-odds that one document is preferred."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    #: False if there was no pair to learn from, so that every score is one half.
    learned: bool = True

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, z ** 2], 1)

    def merit(self, x: np.ndarray) -> np.ndarray:
        return self._inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that the document is preferred to one at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.merit(x) - self.threshold, -30, 30)))


def preference_pairs(labels: np.ndarray, max_pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other): every document of the larger class with as many partners of the smaller as the bound allows."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    large = max(len(good), len(bad))
    rounds = max(1, min(len(good) * len(bad), max_pairs) // large)
    rng = np.random.default_rng(seed)

    def spread(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.resize(rng.permutation(x), large) for _ in range(rounds)])

    return spread(good), spread(bad)


def _sums(d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pair differences: the sum of what the logistic loss asks for, and of its curvature."""
    p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def _newton(model: Ranking, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], pairs: int, l2: float) -> None:
    """Newton steps on the mean logistic loss; ``sums`` gives the sums over all pairs at the present weights."""
    for _ in range(25):
        pull, bent = sums(model.weights)
        change = np.linalg.solve(l2 * np.eye(len(model.weights)) + bent / pairs, l2 * model.weights - pull / pairs)
        model.weights = model.weights - change
        if np.abs(change).max() < 1e-6:
            break


def fit(x: np.ndarray, labels: np.ndarray, quantile: float | None = None, max_pairs: int = 100_000, l2: float = 1e-3, seed: int = 5) -> Ranking:
    """The estimate of rows in memory; the threshold is a quantile of the scores of ``x``.

    Without ``quantile`` it is the share of documents that are not preferred.
    """
    n = x.shape[1] if x.ndim == 2 else N_FEATURES
    better, worse = preference_pairs(labels, max_pairs, seed)
    if not len(better):
        return Ranking(np.zeros(n), np.ones(n), np.zeros(2 * n), 0.0, learned=False)
    spread = x.std(0)
    model = Ranking(x.mean(0), np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * n), 0.0)
    inputs = model._inputs(x)
    _newton(model, lambda w: _sums(inputs[better] - inputs[worse], w), len(better), l2)
    model.threshold = float(np.quantile(model.merit(x), (labels == 0).mean() if quantile is None else quantile))
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _paired(known: DataFrame, good: int, bad: int, max_pairs: int, seed: int) -> tuple[DataFrame, int]:
    """(b, w): features of a preferred and of another document, and the number of pairs.

    Every document of the larger class has the same number of partners, all different, next to each other in the
    order of a hash; there are at least as many pairs as documents in the larger class, whatever ``max_pairs`` says.
    """
    c = F.col
    larger, smaller = max(good, bad), min(good, bad)
    rounds = max(1, min(larger * smaller, max_pairs) // larger)
    # one numbering: the other documents first, then the preferred ones
    at = written(dense_index(known.where("y in (0, 1)"), [c("y").asc(), F.xxhash64(F.lit(seed), "__id").asc(), c("__id").asc()], "n"), "numbered")
    better, worse = at.where("y = 1").select((c("n") - bad).alias("n"), c("x").alias("b")), at.where("y = 0").select("n", c("x").alias("w"))
    many, few = (better, worse) if good >= bad else (worse, better)
    met = many.withColumn("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: (c("n") + r) % smaller)))
    return written(met.join(few, "n").select("b", "w"), "pairs"), larger * rounds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          quantile: float | None = None, max_pairs: int = 100_000, l2: float = 1e-3, seed: int = 5) -> Ranking:
    """Fit on all labelled documents; only sums over features reach the driver.

    Features cover whole texts. Rows with a null id, label or text teach nothing; of several labels of a
    document the largest counts, of several texts the first. Without documents of both labels every score is
    one half. Without ``quantile`` the threshold leaves the share of documents that are not preferred below it.
    """
    c = F.col
    marks = written(labels.where(c(id_col).isNotNull() & c(label_col).isNotNull()).groupBy(c(id_col).alias("__id")).agg(F.max(c(label_col)).cast("int").alias("__y")), "marks")
    texts = docs.where(c(text_col).isNotNull()).select(c(id_col).alias("__id"), c(text_col).alias("__text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "__x"])

    schema = T.StructType([texts.schema["__id"], T.StructField("__x", T.ArrayType(T.DoubleType()))])
    # all texts are described where they lie, so that 18 numbers a document meet the labels and no text is shuffled
    known = written(texts.mapInArrow(describe, schema).join(marks, "__id").groupBy("__id").agg(F.max("__y").alias("y"), F.min("__x").alias("x")), "features")
    at = range(N_FEATURES)
    told = known.agg(F.count("*").alias("n"), F.count_if(c("y") == 1).alias("good"), F.count_if(c("y") == 0).alias("bad"),
                     *[F.avg(c("x")[i]).alias(f"m{i}") for i in at], *[F.stddev_pop(c("x")[i]).alias(f"s{i}") for i in at]).first()
    if not told["good"] or not told["bad"]:
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, learned=False)
    spread = np.array([told[f"s{i}"] for i in at])
    model = Ranking(np.array([told[f"m{i}"] for i in at]), np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * N_FEATURES), 0.0)
    pairs, size = _paired(known, told["good"], told["bad"], max_pairs, seed)
    width = 2 * N_FEATURES

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + width, width))
            for batch in batches:
                pull, bent = _sums(model._inputs(_matrix(batch.column("b"))) - model._inputs(_matrix(batch.column("w"))), weights)
                total += np.vstack([pull, bent])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        found = pairs.mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # width * (width + 1) numbers
        total = np.zeros((1 + width) * width)
        for r in found:
            total[r["k"]] = r["v"]
        total = total.reshape(1 + width, width)
        return total[0], total[1:]

    _newton(model, sums, size, l2)

    def merits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(model.merit(_matrix(batch.column("x"))))], names=["__id", "v"])

    # the quantile lies between two neighbours in the order of all scores
    place = (told["bad"] / told["n"] if quantile is None else quantile) * (told["n"] - 1)
    low = int(place)
    ranked = dense_index(known.select("__id", "x").mapInArrow(merits, T.StructType([known.schema["__id"], T.StructField("v", T.DoubleType())])), [c("v").asc(), c("__id").asc()], "k")
    ends = [r["v"] for r in ranked.where(c("k").between(low, low + 1)).orderBy("k").collect()]
    model.threshold = float(ends[0] + (place - low) * (ends[-1] - ends[0]))
    return model


def score(docs: DataFrame, model: Ranking, text_col: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with the score as ``name`` (an existing column of that name is replaced).

    Only the text is read, always whole; a null text scores like an empty one. Rows stay as they are,
    repeated ones included; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(features(texts.to_pylist())))

    return docs.withColumn(name, scored(F.col(text_col)))
