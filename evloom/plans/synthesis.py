"""Synthesis queries: effective status, comparable groups, effects and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.operators import synthesis as syn
from evloom.plans.fixtures import table, view
from evloom.plans.registry import query, sql_stable, stable


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two evidence rows for every first line, one for the others."""
    m = view(spark, sf, "fx_measurements")
    second = F.when(F.col("page") == 1, F.array("document_hash", "second_document")).otherwise(F.array("document_hash"))
    return m.select("measurement_id", F.explode(second).alias("document_hash"))


def current(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements with effective status, study family and normalized values."""
    m = syn.effective_status(view(spark, sf, "fx_measurements"), evidence_rows(spark, sf), view(spark, sf, "fx_experiments"),
                             view(spark, sf, "fx_documents"), carry=["study_family", "sample_label", "doi"])
    return syn.with_normalized(m.withColumn("status", F.col("effective_status")))


DEAD = """dead AS (
  SELECT m.measurement_id FROM fx_measurements m JOIN fx_documents d ON d.document_hash = m.document_hash
    WHERE d.status IN ('retracted','quarantined','stale','superseded','corrected','excluded')
  UNION SELECT m.measurement_id FROM fx_measurements m JOIN fx_documents d ON d.document_hash = m.second_document
    WHERE m.page = 1 AND d.status IN ('retracted','quarantined','stale','superseded','corrected','excluded')
  UNION SELECT m.measurement_id FROM fx_measurements m JOIN fx_experiments e ON e.experiment_id = m.experiment_id
    WHERE e.source_status IN ('retracted','corrected'))"""
NORM = """norm AS (
  SELECT m.*, e.study_family, e.sample_label, e.doi,
    CASE WHEN d.measurement_id IS NOT NULL THEN 'stale' ELSE m.status END AS eff,
    CASE m.unit WHEN 'nm' THEN m.value / 1000 WHEN 'hour' THEN m.value * 3600 / 86400 ELSE m.value END AS nvalue,
    CASE m.unit WHEN 'nm' THEN 'micrometer' WHEN 'um' THEN 'micrometer' WHEN 'mV' THEN 'millivolt' ELSE 'day' END AS nunit
  FROM fx_measurements m JOIN fx_experiments e ON e.experiment_id = m.experiment_id
  LEFT JOIN dead d ON d.measurement_id = m.measurement_id)"""
USABLE = f"""WITH {DEAD}, {NORM}, usable AS (
  SELECT * FROM norm WHERE eff = 'accepted' AND qualifier = 'exact' AND origin <> 'curve_sample')"""


@query("effective_status", f"""WITH {DEAD}
SELECT m.experiment_id, m.status, CASE WHEN d.measurement_id IS NOT NULL THEN 'stale' ELSE m.status END AS effective_status,
  CAST(count(*) AS BIGINT) AS n
FROM fx_measurements m LEFT JOIN dead d ON d.measurement_id = m.measurement_id GROUP BY 1, 2, 3""")
def effective_status(spark, sf):
    m = syn.effective_status(view(spark, sf, "fx_measurements"), evidence_rows(spark, sf),
                             view(spark, sf, "fx_experiments"), view(spark, sf, "fx_documents"))
    return m.groupBy("experiment_id", "status", "effective_status").agg(F.count("*").alias("n"))


@query("descriptive_groups", f"""{USABLE}
SELECT outcome, nunit AS unit, measurement_method, statistic, time_value, time_unit, concentration_basis,
  CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT study_family) AS BIGINT) AS study_families,
  {sql_stable('min(nvalue)')} AS value_min, {sql_stable('max(nvalue)')} AS value_max, {sql_stable('avg(nvalue)')} AS mean,
  {sql_stable('median(nvalue)')} AS median
FROM usable GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def descriptive_groups(spark, sf):
    g = syn.descriptive(current(spark, sf))
    return g.select(*syn.COMPARABLE_KEY, "n", "study_families", *[stable(F.col(c)).alias(c) for c in (
        "value_min", "value_max", "mean", "median")])


@query("descriptive_excluded", f"""WITH {DEAD}, {NORM}
SELECT experiment_id, 'not an accepted exact observation' AS reason, CAST(count(*) AS BIGINT) AS n FROM norm
WHERE NOT (eff = 'accepted' AND qualifier = 'exact' AND origin <> 'curve_sample') GROUP BY 1""")
def descriptive_excluded(spark, sf):
    return syn.excluded(current(spark, sf)).groupBy("experiment_id", "reason").agg(F.count("*").alias("n"))


@query("normalized_measurements", """SELECT measurement_id, outcome, unit, raw_value,
  round(CASE unit WHEN 'nm' THEN value / 1000 WHEN 'hour' THEN value / 24 ELSE value END, 6) AS normalized_value,
  CASE unit WHEN 'nm' THEN 'micrometer' WHEN 'um' THEN 'micrometer' WHEN 'mV' THEN 'millivolt' ELSE 'day' END AS normalized_unit,
  'converted, original value retained' AS normalization_note
FROM fx_measurements""")
def normalized_measurements(spark, sf):
    m = syn.with_normalized(view(spark, sf, "fx_measurements"))
    return m.select("measurement_id", "outcome", "unit", "raw_value", F.round("normalized_value", 6).alias("normalized_value"),
                    "normalized_unit", "normalization_note")


@query("comparable_groups", f"""{USABLE}
SELECT outcome, nunit AS unit, measurement_method, statistic, time_value, time_unit, concentration_basis,
  CAST(count(*) AS BIGINT) AS n, {sql_stable('sum(nvalue)', 4)} AS value_sum, CAST(count(DISTINCT coalesce(study_family, experiment_id)) AS BIGINT) AS studies
FROM usable WHERE measurement_method IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def comparable_groups(spark, sf):
    return syn.comparable_groups(current(spark, sf)).withColumn("value_sum", stable(F.col("value_sum"), 4))


@query("comparable_groups_with_candidates", f"""WITH {DEAD}, {NORM}
SELECT outcome, nunit AS unit, measurement_method, statistic, time_value, time_unit, concentration_basis,
  CAST(count(*) AS BIGINT) AS n, {sql_stable('sum(nvalue)', 4)} AS value_sum, CAST(count(DISTINCT coalesce(study_family, experiment_id)) AS BIGINT) AS studies
FROM norm WHERE measurement_method IS NOT NULL AND eff IN ('accepted', 'candidate') AND qualifier = 'exact' AND origin <> 'curve_sample'
GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def comparable_with_candidates(spark, sf):
    return syn.comparable_groups(current(spark, sf), True).withColumn("value_sum", stable(F.col("value_sum"), 4))


@query("group_histogram", f"""{USABLE}
SELECT outcome, nunit AS unit, measurement_method, statistic, time_value, time_unit, concentration_basis,
  CAST(floor(nvalue / 5.0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n
FROM usable WHERE measurement_method IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def group_histogram(spark, sf):
    return syn.histogram(current(spark, sf), 5.0)


# unit texts of the query below by number, with the factor to the goal of their outcome and the resulting name; written out by hand
COMPOUND = [("mg/mL", "Density", 1.0, "milligram / milliliter"), ("m s^-1", "Speed", 1.0, "meter / second"), ("kg·m/s²", "Force", 1.0, "kilogram * meter / second ** 2"),
            ("J/cm²", "Surface_Energy_mJ_m2", 1e7, "millijoule / meter ** 2"), ("µmol/mg", "Surface_Charge_Density_mmol_g", 1.0, "millimole / gram"),
            ("mol/m**3", "Electrolyte_Concentration_mM", 1.0, "millimole / liter"), ("N/m", "Surface_Energy_mJ_m2", 1e3, "millijoule / meter ** 2"),
            ("mg/mL", "Temperature", None, None), ("furlong/week", "Speed", None, None), ("J/(mol K)", "Heat", None, None), ("1/s", "Rate", 1.0, "1 / second")]


@query("compound_units", "SELECT l_partkey % " + str(len(COMPOUND)) + " AS k, CAST(count(*) AS BIGINT) AS n, " + sql_stable("max(l_quantity * f)") + " AS largest, max(name) AS normalized_unit, max(CASE WHEN name IS NULL THEN 'unit unsupported or incompatible, normalization withheld' ELSE 'converted, original value retained' END) AS note FROM lineitem JOIN (VALUES "
       + ", ".join(f"({n}, {f!r}, '{name}')" if name else f"({n}, NULL, NULL)" for n, (_, _, f, name) in enumerate(COMPOUND)) + f") v(i, f, name) ON v.i = l_partkey % {len(COMPOUND)} GROUP BY 1")
def compound_units(spark, sf):
    """Quantities in compound units, converted where the outcome has a unit of its own, withheld with a reason where that fails."""
    c = F.col
    k = c("l_partkey") % len(COMPOUND)
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]) for row in COMPOUND]), (k + 1).cast("int"))
    m = table(spark, sf, "lineitem").select(k.alias("k"), c("l_quantity").cast("double").alias("value"), pick(0).alias("unit"), pick(1).alias("outcome"), F.lit(None).cast("string").alias("concentration_basis"), F.lit("accepted").alias("status"))
    return syn.with_normalized(m).groupBy("k").agg(F.count("*").alias("n"), stable(F.max("normalized_value")).alias("largest"), F.max("normalized_unit").alias("normalized_unit"), F.max("normalization_note").alias("note"))
