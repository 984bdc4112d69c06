"""The condition index finds the matches that a comparison of all pairs finds, without making all pairs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from evloom.operators import adjudication
from evloom.operators import alignment as al

FIELDS = "experiment_id string, field string, raw string, value double, unit string, qualifier string, basis string, ambiguous boolean"
WIDE = ["pH", "Temperature", "Concentration_wt_percent", "Oil_Type", "Emulsion_Type"]


def tables(spark, experiments, references):
    """experiments: (id, doi, {field: (raw, value, unit, basis)}); references: (id, doi, {field: text})."""
    fields = [(i, f, raw, v, u, "exact", b, False) for i, _, told in experiments for f, (raw, v, u, b) in told.items()]
    texts = [(i, d, f, t) for i, d, told in references for f, t in told.items()]
    return (spark.createDataFrame(fields, FIELDS), spark.createDataFrame([(i, d) for i, d, _ in experiments], "experiment_id string, doi string"),
            spark.createDataFrame(texts, "row_id long, doi string, field string, reference string"),
            spark.createDataFrame([(i, d) for i, d, _ in references], "row_id long, doi string"))


def number(x, unit=None, basis=None):
    return (str(x), float(x), unit, basis)


def plain(spark, fields, experiments, reference, rows):
    """Outcome per experiment from all pairs of a DOI, each judged field by field."""
    pairs = experiments.join(rows, "doi")
    judged = al.with_agreement(fields.where(F.col("field").isin(al.CONDITIONS)).join(pairs, "experiment_id").join(reference.drop("doi"), ["row_id", "field"]))
    told = defaultdict(list)
    for r in judged.collect():
        told[r["experiment_id"], r["row_id"]].append(bool(r["agreement"]))
    size = defaultdict(int)
    for r in rows.collect():
        size[r["doi"]] += 1
    ok = [(r["experiment_id"], r["row_id"]) for r in pairs.collect()
          if all(told[r["experiment_id"], r["row_id"]]) and (size[r["doi"]] == 1 or len(told[r["experiment_id"], r["row_id"]]) >= 2)]
    of_e, of_r = defaultdict(list), defaultdict(list)
    for e, r in ok:
        of_e[e].append(r)
        of_r[r].append(e)
    out = {}
    for r in experiments.collect():
        partners = of_e[r["experiment_id"]]
        matched = len(partners) == 1 and len(of_r[partners[0]]) == 1
        out[r["experiment_id"]] = ("matched" if matched else "ambiguous" if partners else "unmatched", partners[0] if matched else None, len(partners))
    return out


def test_same_matches_as_all_pairs(spark):
    rng = random.Random(6)
    values = [0.0, 1e-9, 1.005e-6, 2.0, 2.03, 2.05, -2.0, 7, 7.1, 7.3]

    def told(make, text):
        out = {}
        for f in WIDE[:3]:
            if rng.random() < 0.6:
                out[f] = make(rng.choice(values), f)
        for f in WIDE[3:]:
            if rng.random() < 0.7:
                out[f] = text(rng.choice(["Olive", "olive ", "Sun", "5"]))
        return out

    def amount(v, field):
        return number(v, {"Concentration_wt_percent": "%"}.get(field), rng.choice(["mass", "volume"]) if field == WIDE[2] else None)

    experiments = [(f"e{i}", f"10.1234/{i % 7}", told(amount, lambda t: (t, 5.0 if t == "5" else None, None, None))) for i in range(120)]
    references = [(i, f"10.1234/{i % 6 if i < 60 else 6}", told(lambda v, _: rng.choice([str(v), f">{v}"] if rng.random() < 0.2 else [str(v)]), lambda t: t)) for i in range(61)]
    data = tables(spark, experiments, references)
    got = {r["experiment_id"]: (r["outcome"], r["row_id"], r["candidate_rows"]) for r in al.align(*al.possible_matches(*data)).collect()}
    want = plain(spark, *data)
    assert got == want and len({x[0] for x in want.values()}) == 3


def test_meetings_are_linear_in_a_hot_source(spark):
    """One DOI holds all rows, all share two conditions, and a number tells them apart."""
    n = 400
    experiments = [(f"e{i}", "10.1234/hot", {"pH": number(1.1 ** i), "Oil_Type": ("Olive", None, None, None), "Emulsion_Type": ("o/w", None, None, None)}) for i in range(n)]
    references = [(i, "10.1234/hot", {"pH": str(1.1 ** i), "Oil_Type": "olive", "Emulsion_Type": "O/W"}) for i in range(n)]
    fields, exps, reference, rows = tables(spark, experiments, references)
    met = []
    meetings = al.condition_meetings

    def counted(e, r):
        out = meetings(e, r)
        met.append(out[0].count())
        return out
    al.condition_meetings = counted
    try:
        result = al.align(*al.possible_matches(fields, exps, reference, rows))
        assert result.where("outcome = 'matched' and experiment_id = concat('e', row_id)").count() == n
    finally:
        al.condition_meetings = meetings
    assert met[0] <= 2 * n  # all pairs would be n * n


def test_copies_of_one_condition_make_one_meeting(spark):
    """Rows that differ only in what the other side does not state are compared once."""
    experiments = [(f"e{i}", "10.1234/x", {"pH": number(i + 1), "Oil_Type": ("a", None, None, None), "Emulsion_Type": ("b", None, None, None)}) for i in range(50)]
    references = [(i, "10.1234/x", {"Oil_Type": "a", "Emulsion_Type": "b", "Temperature": str(i)}) for i in range(50)]
    data = tables(spark, experiments, references)
    got = {r["experiment_id"]: (r["outcome"], r["candidate_rows"]) for r in al.align(*al.possible_matches(*data)).collect()}
    assert got == {f"e{i}": ("ambiguous", 50) for i in range(50)}


def test_bootstrap_weights(spark):
    steps = adjudication.poisson_steps()
    assert steps == sorted(steps) and abs(steps[0] - 0.36787944117144233) < 1e-15 and steps[-1] > 1 - 1e-14
    rng = random.Random(1)
    rows = [(f"f{i}", str(j), "x", "r", "p", rng.random() < 0.8, True, True, False, False, "text") for i in range(60) for j in range(1 + i % 4)]
    cols = "study_family string, experiment_id string, field string, reviewer string, source_locator string, correct boolean, recoverable boolean, accepted boolean, abstained boolean, additional_to_manual boolean, source_type string"
    got = adjudication.family_bootstrap(spark.createDataFrame(rows, cols).repartition(5)).first()
    # resampling whole families by hand
    sums = defaultdict(lambda: [0, 0])
    for r in rows:
        sums[r[0]][0] += 1
        sums[r[0]][1] += r[5]
    families = list(sums.values())
    draws = sorted(sum(x[1] for x in d) / sum(x[0] for x in d) for d in (rng.choices(families, k=60) for _ in range(2000)))
    assert got["families"] == 60
    assert abs(got["precision_lower"] - draws[50]) < 0.03 and abs(got["precision_upper"] - draws[-50]) < 0.03


def test_sources_without_reference_rows_get_no_signature(spark):
    data = tables(spark, [("a", "d1", {"pH": number(7), "Oil_Type": ("oil", None, None, None)}), ("b", "d2", {"pH": number(7)}), ("c", "d3", {})],
                  [(1, "d1", {"pH": "7", "Oil_Type": "oil"}), (2, "d1", {"pH": "9", "Oil_Type": "oil"})])
    matches, exps, refs = al.possible_matches(*data)
    assert {r["experiment_id"]: r["esig"] is None for r in exps.collect()} == {"a": False, "b": True, "c": True}
    got = {r["experiment_id"]: (r["outcome"], r["candidate_rows"]) for r in al.align(matches, exps, refs).collect()}
    assert got == {"a": ("matched", 1), "b": ("unmatched", 0), "c": ("unmatched", 0)}
