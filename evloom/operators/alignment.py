"""Comparison of extracted experiments with a manual reference table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import text, units
from evloom.functions.text import canonical_doi
from evloom.session import cut, written

# Fields that decide whether an experiment and a reference row describe the same sample.
CONDITIONS = ["Emulsion_Type", "Oil_Type", "Oil_Content_vol_percent", "Oil_Content_wt_percent",
              "Emulsification_Method", "Type_of_Nanocellulose", "Type_of_Nanoparticle", "Modification",
              "Concentration_wt_percent", "Electrolyte_Concentration_mM", "pH", "Temperature"]
# Unit in which each numerical reference field is printed.
FIELD_UNITS = {"Droplet_Size_um": "um", "Particle_L_nm": "nm", "Particle_w_nm": "nm", "Electrolyte_Concentration_mM": "mmol/liter",
               "Zeta_Potential_mV": "mV", "Surface_Energy_mJ_m2": "mJ/meter**2", "Contact_Angle_deg": "degree", "Stability_Days": "day",
               "Surface_Charge_Density_mmol_g": "mmol/g", "Oil_Content_vol_percent": "%", "Oil_Content_wt_percent": "%",
               "Concentration_wt_percent": "%", "Aspect_Ratio": "dimensionless", "Crystallinity_Index": "dimensionless"}
# Bases accepted for percentage fields.
FIELD_BASIS = {"Concentration_wt_percent": ["mass", "w/w"], "Oil_Content_wt_percent": ["mass", "w/w"], "Oil_Content_vol_percent": ["volume", "v/v"]}
TOLERANCE = 0.02


def reference_fields(rows: DataFrame, fields: list[str], row_id: str = "reference_row_id") -> DataFrame:
    """Melt reference rows to (row_id, doi, field, reference); absent values produce no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("reference")) for f in fields]))
    return (rows.select(F.col(row_id).alias("row_id"), canonical_doi(F.col("doi")).alias("doi"), pairs.alias("x"))
            .select("row_id", "doi", "x.field", "x.reference").where("reference is not null"))


def reference_violations(rows: DataFrame) -> DataFrame:
    """Reference rows without a valid DOI or not of manual origin."""
    c = F.col
    reason = F.when(canonical_doi(c("doi")).isNull(), "no valid DOI").when(
        F.coalesce(c("origin"), F.lit("manual_original")) != "manual_original", "not an original manual value")
    return rows.withColumn("reason", reason).where("reason is not null").select("reference_row_id", "reason")


def candidate_fields(attributes: DataFrame, measurements: DataFrame) -> DataFrame:
    """(experiment_id, field, raw, value, unit, qualifier, basis, ambiguous), one row per named field.

    A name that occurs twice is ambiguous, whatever the values; it is never resolved by order.
    ``attributes``: experiment_id, name, text, value, unit, basis, status. ``measurements`` carry raw_value,
    outcome, normalized pair, concentration_basis, qualifier, status, origin.
    """
    c = F.col
    cell = text.parse_cell(c("text"))
    a = attributes.where(c("status") != "rejected").select(
        "experiment_id", c("name").alias("field"), c("text").alias("raw"),
        F.when((cell["qualifier"] == "exact") & c("value").isNotNull(), c("value")).otherwise(cell["value"]).alias("value"),
        "unit", cell["qualifier"].alias("qualifier"), "basis")
    m = measurements.where((c("status") == "accepted") & (c("origin") != "curve_sample")).select(
        "experiment_id", c("outcome").alias("field"), c("raw_value").alias("raw"),
        F.coalesce("normalized_value", "value", text.parse_cell(c("raw_value"))["value"]).alias("value"),
        F.when(c("normalized_value").isNotNull(), c("normalized_unit")).otherwise(c("unit")).alias("unit"),
        "qualifier", c("concentration_basis").alias("basis"))
    first = lambda x: F.when(F.count("*") == 1, F.first(x)).alias(x)
    return a.unionByName(m).groupBy("experiment_id", "field").agg(
        first("raw"), first("value"), first("unit"),
        F.when(F.count("*") == 1, F.first("qualifier")).otherwise("missing").alias("qualifier"), first("basis"),
        (F.count("*") > 1).alias("ambiguous"))


def with_agreement(pairs: DataFrame) -> DataFrame:
    """Add agreement, absolute_error and reason to rows that hold a candidate field and a reference text."""
    c = F.col
    goal = text.parse_cell(c("reference"))
    j = units.attach_conversion(pairs.withColumn("__goal_value", goal["value"]).withColumn("__goal_qualifier", goal["qualifier"]),
                                c("field"), c("unit"), FIELD_UNITS, aliases=False)
    has_target = c("field").isin(*FIELD_UNITS)
    has_unit = F.coalesce(c("unit"), F.lit("")) != ""
    numeric = c("value").isNotNull() & c("__goal_value").isNotNull()
    basis_bad = F.lit(False)
    for field, allowed in FIELD_BASIS.items():
        basis_bad = basis_bad | ((c("field") == field) & ~F.coalesce(c("basis").isin(*allowed), F.lit(False)))
    actual = F.when(has_target & has_unit, units.converted(c("value"))).otherwise(c("value"))
    j = j.withColumn("__error", F.abs(actual - c("__goal_value"))).withColumn("__scale", F.greatest(F.abs(actual), F.abs("__goal_value")))
    same_text = text.casefold(text.strip(F.coalesce(c("raw"), F.lit("None")))) == text.casefold(text.strip(c("reference")))
    close = c("__error") <= F.greatest(TOLERANCE * c("__scale"), F.lit(1e-8))
    reason = (F.when(c("qualifier").isNull(), "missing_candidate").when(c("ambiguous"), "ambiguous_candidate_field")
              .when(c("qualifier") != c("__goal_qualifier"), "qualifier_mismatch")
              .when(numeric & basis_bad, "concentration_basis_unverified")
              .when(numeric & has_target & ~has_unit, "candidate_unit_missing")
              .when(numeric & has_target & c("__unit").isNull(), "unit_mismatch")
              .when(numeric & close, "within_tolerance").when(numeric, "numerical_disagreement").otherwise("literal_text_comparison"))
    j = j.withColumn("reason", reason)
    agree = F.when(c("reason") == "within_tolerance", True).when(c("reason") == "literal_text_comparison", same_text).otherwise(F.lit(False))
    keep = pairs.columns
    return j.select(*keep, agree.alias("agreement"),
                    F.when(c("reason").isin("within_tolerance", "numerical_disagreement"), c("__error")).alias("absolute_error"), "reason")


def in_available(rows: DataFrame, available: DataFrame) -> DataFrame:
    """Rows whose DOI has a local source; the rest neither count as unmatched nor enter a denominator."""
    have = available.select(canonical_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()
    return rows.join(have, "doi", "left_semi")


@dataclass
class Matches:
    """Of condition signatures: how many reference rows each may be (and the smallest), and how many experiments each row may be."""

    partners: DataFrame
    rivals: DataFrame


_BITS = {f: 1 << n for n, f in enumerate(CONDITIONS)}
#: Numbers within the tolerance lie in the same or in neighbouring steps of this size on a logarithmic scale.
_STEP = 1.005 * -math.log(1 - TOLERANCE)
#: Below this size numbers share one step: there the absolute tolerance can exceed the relative one.
_TINY = 1e-6
_LEAST = math.floor(math.log(_TINY) / _STEP)
#: So many numerical fields narrow a key by their step; the others only by being numbers.
_STEPPED = 3


def _bit(field: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _BITS.items() for x in pair])[field]


def _mask(fields: Column, counts=None) -> Column:
    """The condition fields of an array as bits; ``counts`` says which of them to take."""
    taken = F.filter(fields, counts) if counts else fields
    return F.aggregate(taken, F.lit(0), lambda m, f: m.bitwiseOR(_bit(f["field"])))


def _step(value: Column) -> Column:
    return F.when(F.abs(value) < _TINY, F.lit(_LEAST)).otherwise(F.greatest(F.floor(F.log(F.abs(value)) / _STEP).cast("int"), F.lit(_LEAST)))


def _named(step: Column, sign: Column) -> Column:
    return F.when(step <= _LEAST, F.lit("n")).otherwise(F.concat(F.lit("n"), sign, step.cast("string")))


def _alternatives(value: Column) -> Column:
    """Keys of all numbers that may agree with ``value``; none for a null."""
    at, sign = _step(value), F.when(value < 0, "-").otherwise("+")
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _named(at + d, sign))
    both = F.when(at == _LEAST, F.array(_named(at + 1, F.lit("+")), _named(at + 1, F.lit("-")))).otherwise(F.array().cast("array<string>"))
    return F.when(value.isNotNull(), F.array_distinct(F.concat(around, both))).otherwise(F.array().cast("array<string>"))


def _folded(literal: Column) -> Column:
    return F.concat(F.lit("t"), text.casefold(text.strip(literal)))


def _is_stepped(field: Column) -> Column:
    """Among the first numerical fields of the class; ``numbers`` and ``shared`` are columns of the class."""
    before = F.col("numbers").bitwiseAND(F.col("shared")).bitwiseAND(_bit(field) - 1)
    return F.bit_count(before) < _STEPPED


def _keys(fields: Column, of) -> Column:
    """All joined keys of an array of fields, given the alternatives of each field."""
    one = F.array(F.lit(""))
    return F.aggregate(fields, one, lambda keys, f: F.flatten(F.transform(keys, lambda k: F.transform(of(f), lambda x: F.concat(k, F.lit("\n"), x)))))


def _candidate_key(f: Column) -> Column:
    number = F.when(_is_stepped(f["field"]), _alternatives(f["actual"])).otherwise(F.array(F.lit("n")))
    return F.when(F.col("numbers").bitwiseAND(_bit(f["field"])) != 0, number).otherwise(F.array(f["folded"]))


def _reference_key(f: Column) -> Column:
    sign = F.when(f["goal"] < 0, "-").otherwise("+")
    number = F.when(_is_stepped(f["field"]), _named(_step(f["goal"]), sign)).otherwise(F.lit("n"))
    return F.array(F.when(f["goal"].isNotNull(), number).otherwise(f["folded"]))


def condition_meetings(e: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of the two sides has to be compared, and which signatures stand behind each part.

    A reference signature has a class: the fields it states and which of them are numbers. For each class
    of its DOI an experiment signature is reduced to the fields both state; equal reductions are one. Two
    reductions meet only if every shared field has the same literal or neighbouring numbers, through one
    key over all of them, so that a value common to a whole DOI makes no pairs by itself.

    ``e``: doi, esig, fields, experiments. ``r``: doi, rsig, rfields, rows. Returns (meetings with both
    reductions, esig to reduction, rsig to reduction).
    """
    c = F.col
    e = e.withColumn("emask", _mask(c("fields")))
    r = r.withColumn("stated", _mask(c("rfields"))).withColumn("numbers", _mask(c("rfields"), lambda f: f["goal"].isNotNull()))
    classes = r.select("doi", "stated", "numbers").distinct()
    both = c("emask").bitwiseAND(c("stated"))
    shared_by = e.select("doi", "emask").distinct().join(classes, "doi").withColumn("shared", both).where(F.bit_count("shared") >= 2)
    keys = ["doi", "stated", "numbers", "shared"]

    def reduced(side: DataFrame, fields: str) -> DataFrame:
        kept = F.filter(c(fields), lambda f: c("shared").bitwiseAND(_bit(f["field"])) != 0)
        return side.withColumn("kept", kept).withColumn("part", F.sha2(F.to_json(F.struct(*keys, "kept")), 256))

    left = cut(reduced(e.join(shared_by, ["doi", "emask"]), "fields").select(*keys, "esig", "experiments", "kept", "part"))
    right = cut(reduced(r.join(shared_by.select(*keys).distinct(), ["doi", "stated", "numbers"]), "rfields").select(*keys, "rsig", "rows", "kept", "part"))
    ours = left.groupBy(*keys, "part").agg(F.first("kept").alias("fields"), F.sum("experiments").alias("experiments"))
    theirs = right.groupBy(*keys, "part").agg(F.first("kept").alias("rfields"), F.sum("rows").alias("rows"), F.min("rsig").alias("rsig"))
    ours = ours.withColumn("key", F.explode(_keys(c("fields"), _candidate_key))).withColumnRenamed("part", "epart")
    theirs = theirs.withColumn("key", F.element_at(_keys(c("rfields"), _reference_key), 1)).withColumnRenamed("part", "rpart")
    return ours.join(theirs, [*keys, "key"]).drop("key"), left.select("esig", c("part").alias("epart")), right.select("rsig", c("part").alias("rpart"))


def _agreeing(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs without a shared field that disagrees; ``pairs``: keys, fields, rfields and what else to keep."""
    c = F.col
    shared = F.filter(c("fields"), lambda f: F.exists("rfields", lambda g: g["field"] == f["field"]))
    rest = [x for x in pairs.columns if x not in ("fields", "rfields", *keys)]
    opened = pairs.select(*keys, *rest, "rfields", F.explode_outer(shared).alias("f"))
    ref_of = F.filter(c("rfields"), lambda g: g["field"] == c("f.field"))
    flat = opened.select(*keys, *rest, "f.*", F.try_element_at(ref_of, F.lit(1))["reference"].alias("reference")).drop("actual", "folded")
    return with_agreement(flat).groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in rest], F.sum(F.when(c("field").isNotNull() & ~c("agreement"), 1).otherwise(0)).alias("against")).where("against = 0")


def _with_actual(e: DataFrame) -> DataFrame:
    """Signatures whose fields also hold the number in the unit of the reference, and the folded literal."""
    c = F.col
    opened = e.select("doi", "esig", "experiments", F.explode_outer("fields").alias("f")).select("doi", "esig", "experiments", "f.*")
    j = units.attach_conversion(opened, c("field"), c("unit"), FIELD_UNITS, aliases=False)
    convertible = c("field").isin(*FIELD_UNITS) & (F.coalesce(c("unit"), F.lit("")) != "")
    told = F.struct("field", "raw", "value", "unit", "qualifier", "basis", "ambiguous", F.when(convertible, units.converted(c("value"))).otherwise(c("value")).alias("actual"),
                    _folded(F.coalesce(c("raw"), F.lit("None"))).alias("folded"))
    return cut(j.groupBy("doi", "esig").agg(F.first("experiments").alias("experiments"), F.array_sort(F.collect_list(F.when(c("field").isNotNull(), told))).alias("fields")))


def possible_matches(fields: DataFrame, experiments: DataFrame, reference: DataFrame, rows: DataFrame) -> tuple[Matches, DataFrame, DataFrame]:
    """Which condition signatures agree, with the owners of each signature.

    Experiments of one DOI that state the same conditions are compared once, and so are reference rows.
    A DOI with one reference row asks for no shared field; otherwise two signatures must share at least
    two fields, all in agreement, and meet through an index of conditions.
    """
    c = F.col
    relevant = fields.where(c("field").isin(*CONDITIONS)).withColumn("__v", F.struct("field", "raw", "value", "unit", "qualifier", "basis", "ambiguous"))
    packed = relevant.groupBy("experiment_id").agg(F.array_sort(F.collect_list("__v")).alias("fields"))
    none = F.array().cast(packed.schema["fields"].dataType)
    # only sources with reference rows are compared at all; an experiment of any other has no signature and stays unmatched
    named = rows.select("doi").distinct().withColumn("__named", F.lit(True))
    everyone = written(experiments.select("experiment_id", "doi").join(named, "doi", "left"), "compared")
    # signatures are read twice: once collapsed for the comparison, once to find their owners
    exps = written(everyone.where("__named").drop("__named").join(packed, "experiment_id", "left").withColumn("fields", F.coalesce("fields", none))
                   .withColumn("esig", F.sha2(F.to_json(F.struct("doi", "fields")), 256)), "signatures")
    packed_rows = reference.where(c("field").isin(*CONDITIONS)).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("field", "reference"))).alias("rfields"))
    empty = F.array().cast(packed_rows.schema["rfields"].dataType)
    refs = cut(rows.select("row_id", "doi").join(packed_rows, "row_id", "left").withColumn("rfields", F.coalesce("rfields", empty))
            .withColumn("rsig", F.sha2(F.to_json(F.struct("doi", "rfields")), 256)))
    e = _with_actual(exps.groupBy("doi", "esig").agg(F.first("fields").alias("fields"), F.count("*").alias("experiments")))
    r = refs.groupBy("doi", "rsig").agg(F.first("rfields").alias("rfields"), F.count("*").alias("rows"))
    r = cut(r.withColumn("rfields", F.transform("rfields", lambda g: F.struct(
        g["field"].alias("field"), g["reference"].alias("reference"), text.parse_cell(g["reference"])["value"].alias("goal"), _folded(g["reference"]).alias("folded")))))
    per_doi = refs.groupBy("doi").agg((F.count("*") == 1).alias("alone"))
    r = r.join(per_doi, "doi")
    alone = _agreeing(e.join(r.where("alone").drop("alone"), "doi").drop("doi"), ["esig", "rsig"])
    met, e_parts, r_parts = condition_meetings(e, r.where("not alone").drop("alone"))
    agreed = cut(_agreeing(met.select("epart", "rpart", "fields", "rfields", "experiments", "rows", "rsig"), ["epart", "rpart"]))
    partners = e_parts.join(agreed.groupBy("epart").agg(F.sum("rows").alias("rows"), F.min("rsig").alias("rsig")), "epart").select("esig", "rows", "rsig")
    rivals = r_parts.join(agreed.groupBy("rpart").agg(F.sum("experiments").alias("experiments")), "rpart").select("rsig", "experiments")
    found = Matches(partners.unionByName(alone.select("esig", "rows", "rsig")).groupBy("esig").agg(F.sum("rows").alias("partners"), F.min("rsig").alias("rsig")),
                    rivals.unionByName(alone.select("rsig", "experiments")).groupBy("rsig").agg(F.sum("experiments").alias("rivals")))
    others = everyone.where("__named is null").select("experiment_id", "doi", F.lit(None).cast("string").alias("esig"))
    return found, exps.select("experiment_id", "doi", "esig").unionByName(others), refs.select("row_id", "doi", "rsig")


def align(matches: Matches, exps: DataFrame, refs: DataFrame) -> DataFrame:
    """(experiment_id, doi, outcome, row_id): matched only if each side has exactly one partner."""
    c = F.col
    single = refs.groupBy("rsig").agg(F.min("row_id").alias("row_id"))
    j = exps.join(matches.partners, "esig", "left").join(matches.rivals, "rsig", "left").join(single, "rsig", "left")
    matched = (c("partners") == 1) & (c("rivals") == 1)
    return j.select("experiment_id", "doi", F.when(matched, "matched").when(c("partners") >= 1, "ambiguous").otherwise("unmatched").alias("outcome"),
                    F.when(matched, c("row_id")).alias("row_id"), F.coalesce("partners", F.lit(0)).alias("candidate_rows"))


def field_comparisons(aligned: DataFrame, fields: DataFrame, reference: DataFrame) -> DataFrame:
    """Every non-missing reference field of every matched row against the candidate field."""
    matched = aligned.where("outcome = 'matched'").select("experiment_id", "row_id")
    wanted = matched.join(reference.drop("doi"), "row_id")
    return with_agreement(wanted.join(fields, ["experiment_id", "field"], "left"))


def potential_additions(aligned: DataFrame, fields: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidate fields of matched experiments that the reference row leaves empty."""
    matched = aligned.where("outcome = 'matched'").select("experiment_id", "row_id")
    return (fields.where("raw is not null").join(matched, "experiment_id")
            .join(reference.select("row_id", "field"), ["row_id", "field"], "left_anti"))


def agreement_summary(comparisons: DataFrame, reference: DataFrame, available: DataFrame) -> DataFrame:
    """exact, compared, proportion, recovery and mean absolute error in one row.

    Recovery is measured against the non-missing fields of reference rows whose DOI is available.
    """
    c = F.col
    s = comparisons.agg(F.coalesce(F.sum(c("agreement").cast("bigint")), F.lit(0)).alias("exact_matches"), F.count("*").alias("compared_fields"),
                        F.avg("absolute_error").alias("numerical_mae"))
    d = in_available(reference, available).agg(F.count("*").alias("manual_nonmissing_fields"))
    one = s.join(d)  # two one-row aggregates
    return one.withColumn("proportion", F.try_divide("exact_matches", "compared_fields")).withColumn(
        "recovery_agreement", F.try_divide("exact_matches", "manual_nonmissing_fields"))


def error_by_field(comparisons: DataFrame) -> DataFrame:
    return (comparisons.where("absolute_error is not null").groupBy("field").agg(
        F.count("*").alias("n"), F.avg("absolute_error").alias("mean_absolute_error"), F.max("absolute_error").alias("max_absolute_error")).orderBy("field"))


def scope(rows: DataFrame, reference: DataFrame, available: DataFrame) -> DataFrame:
    """Reference rows and DOIs, and how many of them have a local source."""
    have = available.select(canonical_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct().withColumn("__have", F.lit(1))
    r = rows.select("row_id", "doi").join(have, "doi", "left")
    n = reference.groupBy("row_id").agg(F.count("*").alias("n"))
    r = r.join(n, "row_id", "left")
    return r.agg(F.count("*").alias("reference_rows"), F.countDistinct("doi").alias("reference_dois"),
                 F.sum(F.coalesce("n", F.lit(0))).alias("nonmissing_fields"), F.count("__have").alias("available_rows"),
                 F.countDistinct(F.when(F.col("__have") == 1, F.col("doi"))).alias("available_dois"))


def missing_sources(rows: DataFrame, available: DataFrame) -> DataFrame:
    have = available.select(canonical_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()
    return rows.select("doi").distinct().join(have, "doi", "left_anti").orderBy("doi")
