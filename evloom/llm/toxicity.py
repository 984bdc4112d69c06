"""Toxicity score of whole texts: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.hashing import PUNCTUATION, mix, word_hashes

#: Terms are words and, because abuse is inflected, their first bytes.
PREFIXES = (4, 5, 6)
_SALTS = np.array([0, 0x51ED27, 0xA3C59B, 0xF1EA5E], np.uint64)


def _terms(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, term), not yet distinct, for groups of documents."""
    lowered = [t.lower() if isinstance(t, str) else None for t in texts]
    for documents, words, starts in word_hashes(lowered, PUNCTUATION, PREFIXES):
        kinds = [words, *(mix(p ^ salt) for p, salt in zip(starts, _SALTS[1:]))]
        yield np.tile(documents, len(kinds)), np.concatenate(kinds).view(np.int64)


def _distinct(documents: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, documents))
    documents, terms = documents[order], terms[order]
    new = np.ones(len(terms), bool)
    new[1:] = (documents[1:] != documents[:-1]) | (terms[1:] != terms[:-1])
    return documents[new], terms[new]


@dataclass
class Vocabulary:
    """The selected terms; a filter of 2^22 slots keeps the exact lookup off nearly all words."""

    terms: np.ndarray

    def __post_init__(self) -> None:
        self.terms = np.sort(np.asarray(self.terms, np.int64))
        self.slots = np.zeros(1 << 22, bool)
        self.slots[self._slot(self.terms)] = True

    @staticmethod
    def _slot(terms: np.ndarray) -> np.ndarray:
        return terms.view(np.uint64) >> np.uint64(42)

    def matches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, index of a selected term), distinct."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for documents, terms in _terms(texts):
            hit = np.flatnonzero(self.slots[self._slot(terms)])
            documents, terms = documents[hit], terms[hit]
            at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
            real = self.terms[at] == terms if len(self.terms) else np.zeros(0, bool)
            found.append((documents[real], at[real]))
        return _distinct(*(np.concatenate(x) for x in zip(*found)))


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over term pairs of the products of their factors, through the logistic function.

    A pair such as an insult next to a group name gets its own share, which additive weights cannot give.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    #: False if the labels it was fitted on lacked a class, so that its scores tell nothing apart.
    both_classes: bool = True

    def margin(self, rows: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(rows, self.weights[columns], n)
        sums = np.stack([np.bincount(rows, f[columns], n) for f in self.factors.T], 1)
        squares = np.bincount(rows, (self.factors ** 2).sum(1)[columns], n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, columns, n)[0], -40, 40)))


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_terms: int, n_factors: int = 4,
        epochs: int = 150, rate: float = 0.05, l2: float = 1e-4, seed: int = 11) -> FactorizationMachine:
    """Adam on the mean logistic loss over all rows; repeatable for a given seed and row order."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, n_factors)),
                                 bool(0 < labels.sum() < len(labels)))
    moments: dict[str, list] = {k: [0.0, 0.0] for k in ("bias", "weights", "factors")}
    for step in range(1, epochs + 1):
        margin, sums = model.margin(rows, columns, len(labels))
        slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / len(labels)
        each = slope[rows]
        gradient = {
            "bias": slope.sum(),
            "weights": np.bincount(columns, each, n_terms) + l2 * model.weights,
            "factors": np.stack([np.bincount(columns, each * (sums[rows, f] - model.factors[columns, f]), n_terms)
                                 for f in range(n_factors)], 1) + l2 * model.factors,
        }
        for name, g in gradient.items():
            first, second = moments[name]
            moments[name] = first, second = [0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g]
            change = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            setattr(model, name, getattr(model, name) - change)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_labelled: int = 20_000, max_terms: int = 4096, min_documents: int = 3, min_gain: float = 8.0
          ) -> tuple[Vocabulary, FactorizationMachine]:
    """Fit on at most ``max_labelled`` labelled documents, taken in the order of a hash of their id.

    That bound, the number of terms and the number of factors fix the size of everything that reaches
    the driver (a few megabytes). Term counts of the sample are summed in Spark over its whole texts;
    the terms with the largest log-likelihood ratio against the label are kept. Rows with a null id,
    label or text teach nothing. Without usable labels the model is the constant one half; the model says
    whether it saw both classes.
    """
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    # max_labelled rows of two numbers: a proven bound
    known = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
             .join(F.broadcast(sample), "__id"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = batch["__y"].to_numpy()
            parts = [_distinct(*x) for x in _terms(list(batch["__text"]))]
            for documents, terms in parts:
                kinds, at = np.unique(terms, return_inverse=True)
                yield pd.DataFrame({"__t": kinds, "__n": np.bincount(at, minlength=len(kinds)).astype(np.int64),
                                    "__p": np.bincount(at, y[documents], len(kinds)).astype(np.int64)})

    totals = known.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    n, positive = int(totals[0]), int(totals[1])
    if n == 0:
        return Vocabulary(np.zeros(0, np.int64)), FactorizationMachine(0.0, np.zeros(0), np.zeros((0, 1)), both_classes=False)
    share = positive / n
    seen = (known.select("__text", "__y").mapInPandas(counts, "__t bigint, __n bigint, __p bigint")
            .groupBy("__t").agg(F.sum("__n").alias("n"), F.sum("__p").alias("p")).where(F.col("n") >= min_documents))

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    negative = F.col("n") - F.col("p")
    gain = 2 * (part(F.col("p"), F.col("n") * share) + part(negative, F.col("n") * (1 - share)))
    chosen = seen.select("__t", gain.alias("gain")).where(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "__t").limit(max_terms)
    vocabulary = Vocabulary(np.array([r[0] for r in chosen.collect()], np.int64))

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            documents, columns = vocabulary.matches(list(batch["__text"]))
            lists = np.split(columns, np.searchsorted(documents, np.arange(1, len(batch))))
            yield pd.DataFrame({"__id": batch["__id"], "__y": batch["__y"], "__c": [x.tolist() for x in lists]})

    id_type = docs.schema[id_col].dataType.simpleString()
    examples = (known.mapInPandas(matched, f"__id {id_type}, __y int, __c array<int>")
                .groupBy("__id").agg(F.max("__y").alias("__y"), F.min("__c").alias("__c")).orderBy("__id").collect())
    columns = np.array([c for r in examples for c in r["__c"]], np.int64)
    rows = np.repeat(np.arange(len(examples)), [len(r["__c"]) for r in examples])
    return vocabulary, fit(rows, columns, np.array([r["__y"] for r in examples], float), len(vocabulary.terms))


def score(docs: DataFrame, vocabulary: Vocabulary, model: FactorizationMachine, text_col: str = "text",
          name: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name`` (an existing column of that name is replaced).

    Null and empty texts hold no term and get the score of the bias. Only the text is read. Rows,
    repeated ones included, stay as they are; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.terms, model))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, fitted = shared.value
        known = Vocabulary(terms)
        for texts in batches:
            yield pd.Series(fitted.score(*known.matches(list(texts)), len(texts)))

    return docs.withColumn(name, scored(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their columns; trained on ``labels``.

    A model that did not see both classes rejects nothing.
    """
    names = docs.columns
    vocabulary, model = train(docs, labels)
    if not model.both_classes:
        return docs
    return score(docs, vocabulary, model, name="__toxicity").where(F.col("__toxicity") < threshold).select(*names)
