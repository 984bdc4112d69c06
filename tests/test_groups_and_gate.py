"""Ordinals in groups of any size, merges that keep conflicts, and a gate that refuses faulty snapshots."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evloom.operators import structure as sx
from evloom.operators.identity import _once
from evloom.operators.primitives import group_ordinals, neighbours, next_in_group
from evloom.sources.publication import Publications
from evloom.streaming.living import folders


def test_ordinals_and_neighbours(spark):
    rng = random.Random(4)
    # one group holds two thirds of all rows, another has a null key
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(10 ** 6)) for i in range(900)]
    numbered = group_ordinals(spark.createDataFrame(rows, "k string, id int, at int").repartition(5), ["k"], [F.col("at").asc(), F.col("id").asc()], "n", block=50)
    got = {r["id"]: (r["n"], r["next"]) for r in next_in_group(numbered, ["k"], "n", {"id": "next"}).collect()}
    groups = defaultdict(list)
    for k, i, at in rows:
        groups[k].append((at, i))
    want = {}
    for members in groups.values():
        order = [i for _, i in sorted(members)]
        want.update({i: (n + 1, order[n + 1] if n + 1 < len(order) else None) for n, i in enumerate(order)})
    assert got == want
    assert group_ordinals(spark.createDataFrame(rows, "k string, id int, at int").limit(0), ["k"], [F.col("at").asc()], "n").count() == 0


def test_merge_keeps_conflicts_and_joins_evidence(spark):
    cols = "document_hash string, sample_label string, pos int, name string, text string, value double, unit string, basis string, status string, place struct<page:int,path:array<string>>"
    rows = [("d", " S1", 1, "pH", "7", 7.0, None, None, "uncertain", (1, ["a"])), ("d", "S1 ", 2, "pH", "7", 7.0, None, None, "accepted", (1, ["a"])),
            ("d", "S1", 3, "pH", "8", 8.0, None, None, "accepted", (1, ["b"])), ("d", "S1", 4, "pH", "7", 7.0, None, None, "accepted", (2, None)),
            ("d", " ", 5, "pH", "9", 9.0, None, None, "accepted", (1, ["a"])), ("e", "S1", 6, "pH", "8", 8.0, None, None, "rejected", (1, ["a"]))]
    tied = sx.tied_by_label(spark.createDataFrame(rows, cols))
    merged = {(r["text"], r["pos"]): (r["status"], r["conflict"]) for r in sx.merge_conditions(tied).collect()}
    assert merged == {("7", 1): ("accepted", False), ("8", 3): ("accepted", True), ("8", 6): ("rejected", False)}
    pieces = sx.union_evidence(tied.where("experiment_key is not null"), ["document_hash", "text"], ["place"]).collect()
    assert sorted((r["document_hash"], r["text"], r["pos"]) for r in pieces) == [("d", "7", 1), ("d", "7", 4), ("d", "8", 3), ("e", "8", 6)]


def test_relations_once_by_content(spark):
    rows = [(3, "w", "t", {"a": "1"}, [("x", None)]), (1, "w", "t", {"a": "1"}, [("x", None)]), (2, "w", "t", {"a": "2"}, [("x", None)]), (4, "v", "t", {"a": "1"}, [("x", None)]), (5, "w", None, None, [])]
    frame = spark.createDataFrame(rows, "input_pos int, component string, target string, more map<string,string>, dates array<struct<d:string,p:int>>")
    assert sorted((r["component"], r["target"] or "", str(r["more"])) for r in _once(frame).collect()) == [
        ("v", "t", "{'a': '1'}"), ("w", "", "None"), ("w", "t", "{'a': '1'}"), ("w", "t", "{'a': '2'}")]


def test_gate(spark):
    store = Publications(spark, folders(spark, "gate")[0])
    assert store.read() == {}
    documents = spark.createDataFrame([("d", "a.pdf", "0" * 64, "completed")], "document_id string, filename string, sha256 string, status string")
    tables = {"documents": documents, "experiments": spark.createDataFrame([("e",)], "experiment_id string"),
              "measurements": spark.createDataFrame([("m", "e", "exact", 1.0)], "measurement_id string, experiment_id string, qualifier string, value double")}

    def audit(staged):
        return sx.snapshot_violations(staged, ["value"])

    assert store.publish(tables, audit) == [] and store.read()["documents"].count() == 1
    more = spark.createDataFrame([("d", "a.pdf", "0" * 64, "completed"), (None, "b.pdf", "xyz", " ")], documents.schema)
    nameless = spark.createDataFrame([("", "e", "exact", 1.0), ("m", "e", "exact", float("nan"))], tables["measurements"].schema)
    refused = store.publish(tables | {"documents": more, "measurements": nameless}, audit)
    assert {v for _, v in refused} == {"document id is missing", "status is missing", "hash is not a SHA-256", "measurement id is missing", "number is not finite"}
    assert store.current()["number"] == 1 and store.read()["documents"].count() == 1
    assert len([n for n in store.folder.names() if n.startswith("snapshot")]) == 1  # the refused one is gone
    assert store.publish(tables | {"documents": more.limit(1)}, audit) == [] and store.current()["number"] == 2


def test_a_successor_keeps_tables_by_name_and_is_audited_whole(spark):
    store = Publications(spark, folders(spark, "kept")[0])
    documents = spark.createDataFrame([("d", "a.pdf", "0" * 64, "completed")], "document_id string, filename string, sha256 string, status string")
    experiments = lambda *ids: spark.createDataFrame([(i,) for i in ids], "experiment_id string")
    measurements = spark.createDataFrame([("m", "e", "exact", 1.0), ("n", "f", "exact", 2.0)], "measurement_id string, experiment_id string, qualifier string, value double")
    audit = lambda staged: sx.snapshot_violations(staged, ["value"])
    assert store.publish({"documents": documents, "experiments": experiments("e", "f"), "measurements": measurements}, audit) == []
    first = store.current()["snapshot"]
    # kept measurements are checked against the new experiments
    assert store.publish({"experiments": experiments("e", "e", "g")}, audit, kept=["documents", "measurements"]) and store.current()["number"] == 1
    assert sorted(store.publish({"experiments": experiments("e", "e", "g")}, audit, kept=["documents", "measurements"])) == [("e", "experiment id repeats"), ("n", "parent experiment is missing")]
    assert store.publish({"experiments": experiments("e", "f", "g")}, audit, kept=["documents", "measurements"]) == []
    names = store.folder.names(store.current()["snapshot"])
    assert names == ["experiments"] and store.folder.names(first) == ["documents", "experiments", "measurements"]
    assert {k: v.count() for k, v in store.read().items()} == {"documents": 1, "experiments": 3, "measurements": 2}


def test_contract_violations_of_odd_ids(spark):
    measurements = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), (None, "x"), ("b", None), ("c", "gone"), ("d", "gone")], "measurement_id string, experiment_id string").selectExpr(
        "*", "'exact' AS qualifier", "1.0D AS value")
    experiments = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "experiment_id string")
    got = sx.contract_violations(measurements, experiments, ["value"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("y", "experiment id repeats"), ("a", "measurement id repeats"), (None, "measurement id repeats"), ("b", "parent experiment is missing"),
                                                                  ("c", "parent experiment is missing"), ("d", "parent experiment is missing")], key=repr)
    # whole ids are not dealt out to be counted: one aggregate of experiment ids and one of hashes come before
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 0 and plan.count("Aggregate [measurement_id") == 1 and "LeftSemi" in plan


def test_neighbours_across_blocks_and_partitions(spark):
    """The following row is found in the same block, in the next block and in the next partition, and never in another group."""
    rows = [(k, i) for k, n in (("a", 1), ("b", 500), (None, 90), ("c", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id int").repartition(5)
    got = neighbours(df, ["k"], [F.col("id").asc()], {"id": "next", "k": "same"}, block=40).collect()
    assert sorted(got, key=repr) == sorted([(k, i, i + 1 if (k, i + 1) in rows else None, k if (k, i + 1) in rows else None) for k, i in rows], key=repr)
    assert neighbours(df.limit(0), ["k"], [F.col("id").asc()], {"id": "next"}).count() == 0


def test_fingerprint_query_deals_rows_into_tasks_by_their_number(spark):
    from evloom.plans import load
    df = load()[0]["dataset_fingerprint"](spark, "/root/testdata/sf0.001", rows_per_task=200)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = df._jdf.queryExecution().toString()
    assert "raw_value" not in "".join(x for x in plan.splitlines() if "RepartitionByExpression" in x) and f", {-(-lines // 200)}" in plan
    assert [tuple(r) for r in df.collect()] == [(lines, "true", "true")]


def test_verification_moves_each_page_once(spark):
    from evloom.plans import load
    df = load()[0]["verified_measurements"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # pages are grouped by both keys of the check, so that the check finds them where they are
    assert re.search(r"hashpartitioning\(document_hash#\d+L?, page#\d+L?, ", plan) and not re.search(r"hashpartitioning\(document_hash#\d+, \d+\)", plan)
    assert "#" not in df.first()["measurement_id"]


def test_one_citation_each_gives_the_same_without_a_second_move(spark):
    """Evidence as one struct: same verdicts as a list of one, null evidence and columns named like evidence included."""
    from evloom.operators import verification as ver
    cite = "struct<document_hash:string,page:bigint,source_type:string,locator:string,excerpt:string,bounding_box:array<double>>"
    measured = "value double, time_value double, lower_bound double, upper_bound double, uncertainty double, ci_lower double, ci_upper double, unit string, time_unit string, measurement_method string, " \
               "statistic string, concentration_basis string, uncertainty_type string, n_independent bigint, n_technical bigint, raw_value string, qualifier string, origin string, status string"
    sign = {"value": 17.0, "unit": "um", "n_technical": 6, "raw_value": "17 um", "qualifier": "exact", "origin": "reported", "status": "candidate", "uncertainty_type": "none"}
    numbers = tuple(sign.get(x.split()[0]) for x in measured.split(", "))
    stated = "mean of 17 um over n = 6 particles"
    told = [("a", "d", ("d", 1, "text", "p", stated, None)), ("b", "d", ("d", 1, "text", "p", stated + " more", None)), ("c", "x", ("d", 1, "text", "p", stated, [1.0, 1.0, 2.0, 2.0])), ("d", "d", ("d", 9, "text", "p", stated, None)),
            ("e", "d", ("d", 1, "table", "t-9", stated, [1.0, 1.0, 900.0, 2.0])), ("f", "d", ("d", 1, "figure", "p", None, None)), ("g", "d", None), ("h", None, (None, None, None, None, None, None))]
    rows = spark.createDataFrame([(i, h, "own", e, *numbers) for i, h, e in told], f"measurement_id string, expected_hash string, excerpt string, evidence {cite}, {measured}")
    pages = spark.createDataFrame([("d", 1, f"Results: {stated}.", [("t-1", [])], 600.0, 800.0, "ocr")], "document_hash string, page bigint, text string, tables array<struct<id:string,rows:array<array<string>>>>, width double, height double, text_status string")
    one = ver.verify_measurements(rows, pages)
    listed = ver.verify_measurements(rows.withColumn("evidence", F.when(F.col("evidence").isNotNull(), F.array("evidence"))), pages)
    told_of = lambda df: {r["measurement_id"]: (r["status"], r["validation_notes"], r["n_technical"], r["excerpt"]) for r in df.collect()}
    got = told_of(one)
    assert got == told_of(listed) and len(got) == 8 and one.columns == listed.columns
    assert got["a"][0] == "uncertain" and "no source evidence" in got["g"][1] and "evidence cites another source" in got["c"][1]
    assert "collect_list" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_verified_measurements_deals_rows_once(spark):
    """Both sides of the check read the same dealt rows, and a row meets its page in one shuffle."""
    from evloom.plans import load
    df = load()[0]["verified_measurements"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # a filter on one side only would keep the two from being one shuffle
    assert plan.count("RepartitionByExpression") == 2 and "isnotnull(l_linenumber" not in plan and "collect_list" not in plan


def test_neighbours_of_small_groups_move_once(spark):
    rows = [(k, i) for k, n in (("a", 3), (None, 2), ("b", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id int").repartition(3)
    want = sorted([(k, i, i + 1 if (k, i + 1) in rows else None) for k, i in rows], key=repr)
    small = neighbours(df, ["k"], [F.col("id").asc()], {"id": "next"})
    mixed = neighbours(df, ["k"], [F.col("id").asc()], {"id": "next"}, block=10)
    assert sorted(small.collect(), key=repr) == sorted(mixed.collect(), key=repr) == want
    # neither dealt out by range nor written, which large groups need
    assert "__seq" not in small._jdf.queryExecution().optimizedPlan().toString() and "__seq" in mixed._jdf.queryExecution().optimizedPlan().toString()


def test_contrasts_tell_the_first_reason_and_move_numbers_of_usable_arms_only(spark):
    from evloom.operators import synthesis as syn
    cols = ("measurement_id string, experiment_id string, status string, qualifier string, origin string, statistic string, uncertainty_type string, uncertainty double, n_independent int, value double, unit string, "
            "outcome string, measurement_method string, concentration_basis string, time_value double, time_unit string, source_active boolean, evidence_count int")
    sound = ["accepted", "exact", "reported", "mean", "SD", 500.0, 3, 2000.0, "nm", "size", "m", None, 7.0, "day", True, 1]
    arm = lambda name, e, **other: (name, e, *[other.get(k.split()[0], v) for k, v in zip(cols.split(", ")[2:], sound)])
    m = spark.createDataFrame([arm("a", "e1"), arm("b", "e2", value=1000.0), arm("gone", "none"), arm("cand", "e1", status="candidate"), arm("off", "e1", source_active=False), arm("late", "e1", time_value=8.0),
                               arm("kg", "e1", unit="kg"), arm("open", "e3"), arm("other", "e4"), arm("far", "e5"), arm("twin", "e1"), arm("both", "e3", time_value=8.0)], cols)
    e = spark.createDataFrame([("e1", "f"), ("e2", "f"), ("e3", "f"), ("e4", "f"), ("e5", "g")], "experiment_id string, study_family string")
    d = spark.createDataFrame([("e1", "d", "c", "true"), ("e2", "d", "c", "true"), ("e3", "d", None, "true"), ("e4", "d", "x", "true"), ("e5", "d", "c", "true")],
                              "experiment_id string, outcome_definition string, comparator string, arms_independent string")
    spec = {"outcome": "size", "measurement_method": "m", "concentration_basis": None, "time_point": "7 day", "outcome_definition": "d", "comparator": "c", "unit": "um"}
    told = {("a", "b"): None, ("gone", "b"): "treatment: no retained measurement", ("cand", "nobody"): "control: no retained measurement", ("cand", "off"): "treatment: not accepted", ("a", "off"): "control: source not active",
            ("late", "b"): "treatment: differs from the registered specification", ("kg", "b"): "treatment: unit cannot be converted", ("open", "b"): "treatment: definition missing or ambiguous",
            ("both", "b"): "treatment: definition missing or ambiguous", ("other", "b"): "treatment: differs from the registered specification", ("a", "far"): "arms belong to different study families",
            ("a", "twin"): "arms are not distinct", ("a", "a"): "arms are not distinct", ("b", "a"): "supplied numbers disagree with the evidence"}
    p = spark.createDataFrame([(f"{t}/{c}", t, c, 2.0, None, 3) for t, c in told], "contrast_id string, treatment_measurement_id string, control_measurement_id string, treatment_mean double, treatment_sd double, control_n int")
    got = {(r["treatment_measurement_id"], r["control_measurement_id"]): r for r in syn.derive_contrasts(p, m, e, d, spec).collect()}
    assert {k: r["reason"] for k, r in got.items()} == told
    assert tuple(got["a", "b"])[4:] == ("f", 2.0, 0.5, 3, 1.0, 0.5, 3) and tuple(got["b", "a"])[4:] == (None,) * 7
    arms = {r["measurement_id"]: r for r in syn._arms(m, e, d, spec).collect()}
    assert {k for k, r in arms.items() if r["numbers"] is not None} == {"a", "b", "far", "twin"} and arms["cand"]["experiment_id"] is None
