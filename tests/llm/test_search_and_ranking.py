"""Scan search, hard negatives and pairwise quality against SQL, plain versions and held-out labels."""

import inspect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evloom.llm import hard_negatives, pairwise_quality, queries, scan_search
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    """(item, rank, doc, score) by counting every term of every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = Counter()
    for item, wanted in asked.items():
        scored = []
        for (doc, c), length in zip(counts, lengths):
            norm = 50 + 50 * length * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * norm)) for t in wanted if t in c)
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out.update((item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.mark.parametrize("name", ["op11_scan_search", "op12_hard_negatives"])
def test_queries_match_sql(spark, name):
    ok, rows, _, message = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF, connect(SF))
    assert ok and rows > 0, message


def test_scan_search_edges(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "Alpha5 beta, end"), (1, "gamma"), (2, None), (3, "?!"), (4, "日本語 É é"), (None, "x one"), (5, "nowhere")],
                                  "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = plain_search(docs, [(r[0], r[1]) for r in items.collect()], 5)
    for block in (1 << 20, 40):  # one block of items, and a block per item
        found = scan_search.search(awkward, items, k=5, block_bytes=block)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, found.collect())) == want, block
    assert scan_search.search(nothing, items).count() == 0 == scan_search.search(awkward, items.limit(0)).count()
    # the operator names no column of the user's tables
    clashing = awkward.withColumn("__id", F.lit("x")).withColumn("__text", F.lit("y")).withColumn("terms", F.lit("z"))
    assert Counter(map(tuple, scan_search.search(clashing, items, k=5).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbé. -\x00 Zz9日"), max_size=30)), max_size=8), st.sets(st.sampled_from(["a", "b", "é", "ab", "aa", "9", "日"])))
def test_term_scan_counts_whole_terms(texts, wanted):
    wanted = sorted(wanted)
    owner, term, count, lengths = scan_search.TermScan(wanted).count(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    got = {(o, wanted[t]): c for o, t, c in zip(owner, term, count)}
    assert got == {(n, t): c for n, x in enumerate(texts) for t, c in Counter(terms(x)).items() if t in wanted}
    assert lengths.tolist() == [len(terms(x)) for x in texts]


def test_term_scan_of_texts_above_a_step():
    text = "alpha beta " * 200_000 + "alpha" + "x" * 1_500_000 + " alpha"
    owner, term, count, lengths = scan_search.TermScan(["alpha", "beta", "x"]).count(pa.array([b"beta", text.encode(), None], pa.binary()))
    assert list(zip(owner, term, count)) == [(0, 1, 1), (1, 0, 200_001), (1, 1, 200_000)] and lengths.tolist() == [1, 400_002, 0]


def plain_negatives(rows, positives=5, negatives=10):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, lab, v in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out.update((i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fit[:negatives], 1))
    return out


def test_hard_negatives_against_plain(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(n, [float(x) for x in centres[n % 4] * (1 + n % 3) + rng.normal(0, 0.3, 6)], int(n % 4 if n % 5 else 7)) for n in range(320)]
    rows += [(320 + n, rows[100][1], 0 if n % 2 else 7) for n in range(100)]  # many copies of an anchor's vector: ties
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [1.0, float("nan")], 1), (701, [1.0, float("inf")], 1), (800, [1.0], None), (None, [1.0], 2),
             (900, [], 1), (901, [], 1), (902, [], 2), (1000, [0.0, 0.0], 1), (1001, [0.0, 0.0], 1), (1002, [3.0, 1.0], 2), (1100, [-1.0, 2.0], 2),
             (1200, [-1.0, 2.0], 3), (1201, [1.0, -2.0], 3), (1300, [1e30, 0.0], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("r")).withColumn("score", F.lit("s"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives([r for r in rows if r[0] != 1300])
    for cells in ({}, {"shard_components": 500, "block_components": 20}):
        found = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, **cells)
        assert found.columns == names and Counter(map(tuple, found.collect())) == want, cells
    assert len(want) > 100 and hard_negatives.mine(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table, F.lit(False)).count() == 0


def test_repeated_ids_are_no_positives_of_each_other(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.8, 0.0], 2)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 100 == 0)
    assert {(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in found.collect()} == {(0, 1, 2)} and found.count() == 4


def test_coordinate_lists_prune_without_loss():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 12))
    vectors = np.floor(256 * np.concatenate([c + rng.normal(0, 0.05, (100, 12)) for c in centres]))
    verified = 0
    for anchor in vectors[::400]:
        index, best = hard_negatives.LengthBuckets(vectors, size=500), hard_negatives.Best(5)
        index.probe(anchor, best.floor, lambda rows, scores: best.add(rows, scores))
        scores = (vectors @ anchor).astype(int)
        assert best.scores.tolist() == sorted(scores, reverse=True)[:5] and index.asked == len(vectors)
        verified += index.verified
    assert verified < len(vectors[::400]) * len(vectors) / 2


def test_pairwise_quality_on_held_out_rows(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    rows = (queries.QUERIES["op13_pairwise_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .where("held_out").select("quality", "predicted", "score").collect())
    right = {q: [r["predicted"] == q for r in rows if r["quality"] == q] for q in (0, 1)}
    assert len(rows) > 80 and np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.9
    labels = spark.createDataFrame([(1, 1), (10, 0), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    scored = pairwise_quality.score(awkward, pairwise_quality.train(awkward, labels), name="score")
    assert scored.columns == awkward.columns and scored.count() == awkward.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    blank = {r["score"] for r in scored.where("text is null or text = ''").collect()}
    assert len(blank) == 1  # null scores like empty
    assert pairwise_quality.score(nothing, pairwise_quality.train(nothing, labels)).count() == 0
    for known in (labels.limit(0), labels.where("quality = 1")):
        model = pairwise_quality.train(awkward, known)
        assert not model.learned and {r[0] for r in pairwise_quality.score(awkward, model).select("quality").collect()} == {0.5}


def test_pairwise_fit_is_a_bradley_terry_estimate():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 3))
    labels = (x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(0, 1, 400) > 1).astype(int)
    model = pairwise_quality.fit(x, labels, l2=1e-6)
    better, worse = pairwise_quality.preference_pairs(labels, 100_000, 5)
    assert set(labels[better]) == {1} and set(labels[worse]) == {0} and len(better) <= 100_000
    d = model._inputs(x)[better] - model._inputs(x)[worse]

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + 0.5e-6 * w @ w

    least = loss(model.weights)
    assert all(loss(model.weights + 0.05 * e) > least < loss(model.weights - 0.05 * e) for e in np.eye(len(model.weights)))
    assert abs((model.score(x) < 0.5).mean() - (labels == 0).mean()) < 0.01


def test_pairwise_quality_learns_from_all_labels(spark):
    """Mean, spread, threshold and weights are those of all labelled documents, computed in memory; no bound on their number is left."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = pairwise_quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    x, y = pairwise_quality.features([r["text"] for r in rows]), np.array([r["quality"] for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    assert abs(model.threshold - np.quantile(model.merit(x), (y == 0).mean())) < 1e-9
    known = spark.createDataFrame([(r["doc_id"], int(v), a.tolist()) for r, v, a in zip(rows, y, x)], "__id long, y int, x array<double>")
    pairs, size = pairwise_quality._paired(known, int((y == 1).sum()), int((y == 0).sum()), 100_000, 5)
    got = pairs.collect()
    assert len(got) == size == (y == 1).sum() * (y == 0).sum() or len({(tuple(r["b"]), tuple(r["w"])) for r in got}) > 0.9 * size
    assert {tuple(r["b"]) for r in got} >= {tuple(a) for a in x[y == 1]} and {tuple(r["w"]) for r in got} >= {tuple(a) for a in x[y == 0]}
    d = model._inputs(np.array([r["b"] for r in got])) - model._inputs(np.array([r["w"] for r in got]))
    pull, _ = pairwise_quality._sums(d, model.weights)
    assert np.abs(1e-3 * model.weights - pull / size).max() < 1e-5
    assert "max_labelled" not in inspect.signature(pairwise_quality.train).parameters


def plain_features(text):
    raw, words, lines = text.encode(), text.split(), [x for x in text.lower().split("\n") if x]
    windows = Counter(zip(words, words[1:], words[2:]))
    return [math.log1p(len(words)), len(set(words)) / max(1, len(words)), sum(c for c in windows.values() if c > 1) / max(1, len(words) - 2),
            (len(lines) - len(set(lines))) / max(1, len(lines)), raw.count(b" ") / max(1, len(raw))]


def test_features_of_whole_texts():
    texts = ["a b c a b c a", "", None, "x\nx\ny", "one two\none two\nthree " + "four five six seven " * 150_000, "é 日本 é"]
    got = pairwise_quality.features(texts)
    at = [pairwise_quality._N_CLASSES, pairwise_quality._N_CLASSES + 2, pairwise_quality._N_CLASSES + 3, pairwise_quality._N_CLASSES + 4, 3]
    assert got.shape == (len(texts), pairwise_quality.N_FEATURES)
    assert np.allclose(got[:, at], [plain_features(t or "") for t in texts])
