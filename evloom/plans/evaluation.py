"""Evaluation queries: reference alignment, adjudication, effects, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.functions import text
from evloom.functions.stats import Z975
from evloom.operators import adjudication as adj
from evloom.operators import alignment as al
from evloom.operators import inference
from evloom.operators import pooling
from evloom.operators import synthesis as syn
from evloom.plans.fixtures import view
from evloom.plans.registry import query, sql_stable, stable
from evloom.session import cut, scratch_path, written
from evloom.sources import reference

FIELDS = ["Oil_Type", "Emulsion_Type", "Droplet_Size_um"]


def available(spark, sf):
    """Documents at hand, with their DOIs as they are printed."""
    return view(spark, sf, "fx_documents").where("status <> 'stale'").select(F.upper("doi").alias("doi"))


def aligned(spark, sf):
    c = F.col
    rows = view(spark, sf, "fx_reference_rows").withColumnsRenamed({"oil_type": "Oil_Type", "emulsion_type": "Emulsion_Type", "droplet_um": "Droplet_Size_um"})
    reference = al.reference_fields(rows, FIELDS)
    ids = rows.select(c("reference_row_id").alias("row_id"), text.canonical_doi(c("doi")).alias("doi"))
    # read by the conditions and by the comparison: derived once
    e = written(view(spark, sf, "fx_experiments").select("experiment_id", "doi", "oil_type", "emulsion_type", "droplet", "part"), "experiments")
    null = F.lit(None).cast("string")

    def attribute(name, value, unit, status):
        return F.struct(F.lit(name).alias("name"), value.alias("text"), unit.alias("unit"), status.alias("status"))

    accepted = F.lit("accepted")
    # an experiment whose DOI has no reference row matches none, so its conditions are never looked at
    attrs = e.join(ids.select("doi").distinct(), "doi", "left_semi").select("experiment_id", F.explode(F.array(
        attribute("Oil_Type", F.upper("oil_type"), null, accepted), attribute("Emulsion_Type", c("emulsion_type"), null, accepted),
        attribute("Emulsion_Type", F.lit("twice"), null, F.when(c("part") % 13 == 0, "uncertain").otherwise("rejected")),
        attribute("Droplet_Size_um", (c("droplet") * 1000).cast("string"), F.when(c("part") % 7 == 0, "mV").otherwise("nm"),
                  F.when(c("part") % 3 == 0, "rejected").otherwise("accepted")))).alias("x")).select(
        "experiment_id", "x.*", F.lit(None).cast("double").alias("value"), null.alias("basis"))
    none = syn.with_normalized(view(spark, sf, "fx_measurements").where("status = 'unused'"))
    fields = written(al.candidate_fields(attrs, none), "fields")
    matches, exps, refs = al.possible_matches(fields, al.in_available(e.select("experiment_id", "doi"), available(spark, sf)), reference, ids)
    return al.align(matches, exps, refs), fields, reference, ids


ALIGN = """WITH ref AS (SELECT reference_row_id AS row_id, doi, oil_type, emulsion_type, droplet_um FROM fx_reference_rows),
per AS (SELECT doi, count(*) AS nrows FROM ref GROUP BY 1), have AS (SELECT DISTINCT doi FROM fx_documents WHERE status <> 'stale'),
ex AS (SELECT * FROM fx_experiments WHERE doi IN (SELECT doi FROM have)),
pair AS (SELECT e.experiment_id, r.row_id FROM ex e JOIN ref r ON r.doi = e.doi JOIN per p ON p.doi = e.doi
  WHERE lower(e.oil_type) = lower(r.oil_type) AND e.part % 13 <> 0 AND lower(e.emulsion_type) = lower(r.emulsion_type)),
ne AS (SELECT experiment_id, count(*) AS n, min(row_id) AS row_id FROM pair GROUP BY 1), nr AS (SELECT row_id, count(*) AS n FROM pair GROUP BY 1),
aligned AS (SELECT e.experiment_id, e.part, e.droplet, CASE WHEN ne.n = 1 AND nr.n = 1 THEN 'matched' WHEN ne.n >= 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome,
  CASE WHEN ne.n = 1 AND nr.n = 1 THEN ne.row_id END AS row_id, CAST(coalesce(ne.n, 0) AS BIGINT) AS candidate_rows
  FROM ex e LEFT JOIN ne ON ne.experiment_id = e.experiment_id LEFT JOIN nr ON nr.row_id = ne.row_id),
cmp AS (
  SELECT a.experiment_id, a.row_id, 'Oil_Type' AS field, true AS agreement, CAST(NULL AS DOUBLE) AS err, 'literal_text_comparison' AS reason FROM aligned a WHERE outcome = 'matched'
  UNION ALL SELECT a.experiment_id, a.row_id, 'Emulsion_Type', true, NULL, 'literal_text_comparison' FROM aligned a WHERE outcome = 'matched'
  UNION ALL SELECT a.experiment_id, a.row_id, 'Droplet_Size_um',
    a.part % 3 <> 0 AND r.droplet_um NOT LIKE '>%' AND a.part % 7 <> 0 AND abs(a.droplet - CAST(r.droplet_um AS DOUBLE)) <= greatest(0.02 * greatest(a.droplet, CAST(r.droplet_um AS DOUBLE)), 1e-8),
    CASE WHEN a.part % 3 <> 0 AND r.droplet_um NOT LIKE '>%' AND a.part % 7 <> 0 THEN abs(a.droplet - CAST(r.droplet_um AS DOUBLE)) END,
    CASE WHEN a.part % 3 = 0 THEN 'missing_candidate' WHEN r.droplet_um LIKE '>%' THEN 'qualifier_mismatch' WHEN a.part % 7 = 0 THEN 'unit_mismatch'
         WHEN abs(a.droplet - CAST(r.droplet_um AS DOUBLE)) <= greatest(0.02 * greatest(a.droplet, CAST(r.droplet_um AS DOUBLE)), 1e-8) THEN 'within_tolerance' ELSE 'numerical_disagreement' END
  FROM aligned a JOIN (SELECT row_id, droplet_um, CASE WHEN droplet_um LIKE '>%' THEN NULL ELSE droplet_um END AS d FROM ref) r ON r.row_id = a.row_id WHERE outcome = 'matched' AND r.droplet_um IS NOT NULL)"""
ALIGN = ALIGN.replace("CAST(r.droplet_um AS DOUBLE)", "CAST(replace(r.droplet_um, '>', '') AS DOUBLE)")


@query("reference_alignment", ALIGN + " SELECT experiment_id, outcome, CAST(row_id AS DOUBLE) AS row_id, candidate_rows FROM aligned")
def reference_alignment(spark, sf):
    return aligned(spark, sf)[0].select("experiment_id", "outcome", F.col("row_id").cast("double").alias("row_id"), F.col("candidate_rows").cast("bigint").alias("candidate_rows"))


@query("alignment_counts", ALIGN + " SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM aligned GROUP BY 1")
def alignment_counts(spark, sf):
    return aligned(spark, sf)[0].groupBy("outcome").agg(F.count("*").alias("n"))


@query("field_comparisons", ALIGN + f" SELECT experiment_id, row_id, field, CAST(agreement AS STRING) AS agreement, {sql_stable('err')} AS absolute_error, reason FROM cmp")
def field_comparisons(spark, sf):
    a, fields, reference, _ = aligned(spark, sf)
    return al.field_comparisons(a, fields, reference).select("experiment_id", "row_id", "field", F.col("agreement").cast("string").alias("agreement"),
                                                             stable(F.col("absolute_error")).alias("absolute_error"), "reason")


@query("agreement_summary", ALIGN + f""", tot AS (SELECT CAST(coalesce(sum(2 + CASE WHEN droplet_um IS NULL THEN 0 ELSE 1 END), 0) AS BIGINT) AS d FROM ref WHERE doi IN (SELECT doi FROM have)),
agg AS (SELECT CAST(coalesce(sum(CASE WHEN agreement THEN 1 ELSE 0 END), 0) AS BIGINT) AS exact_matches, CAST(count(*) AS BIGINT) AS compared_fields, avg(err) AS mae FROM cmp)
SELECT exact_matches, compared_fields, {sql_stable('mae')} AS numerical_mae, d AS manual_nonmissing_fields, {sql_stable('exact_matches / nullif(compared_fields, 0)')} AS proportion,
  {sql_stable('exact_matches / nullif(d, 0)')} AS recovery_agreement FROM agg, tot""")
def agreement_summary(spark, sf):
    a, fields, reference, _ = aligned(spark, sf)
    s = al.agreement_summary(al.field_comparisons(a, fields, reference), reference, available(spark, sf))
    return s.select("exact_matches", "compared_fields", "manual_nonmissing_fields", *[stable(F.col(x)).alias(x) for x in ("numerical_mae", "proportion", "recovery_agreement")])


@query("error_by_field", ALIGN + f""" SELECT field, CAST(count(*) AS BIGINT) AS n, {sql_stable('avg(err)')} AS mean_absolute_error, {sql_stable('max(err)')} AS max_absolute_error
FROM cmp WHERE err IS NOT NULL GROUP BY 1""")
def error_by_field(spark, sf):
    a, fields, reference, _ = aligned(spark, sf)
    e = al.error_by_field(al.field_comparisons(a, fields, reference))
    return e.select("field", "n", *[stable(F.col(x)).alias(x) for x in ("mean_absolute_error", "max_absolute_error")])


@query("potential_additions", ALIGN + """ SELECT a.experiment_id, a.row_id, 'Droplet_Size_um' AS field, CAST(a.droplet * 1000 AS STRING) AS raw FROM aligned a JOIN ref r ON r.row_id = a.row_id
WHERE a.outcome = 'matched' AND r.droplet_um IS NULL AND a.part % 3 <> 0""")
def potential_additions(spark, sf):
    a, fields, reference, _ = aligned(spark, sf)
    return al.potential_additions(a, fields, reference).select("experiment_id", "row_id", "field", "raw")


@query("reference_scope", """WITH have AS (SELECT DISTINCT doi FROM fx_documents WHERE status <> 'stale')
SELECT CAST(count(*) AS BIGINT) AS reference_rows, CAST(count(DISTINCT r.doi) AS BIGINT) AS reference_dois, CAST(sum(2 + CASE WHEN droplet_um IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS nonmissing_fields,
  CAST(count(h.doi) AS BIGINT) AS available_rows, CAST(count(DISTINCT h.doi) AS BIGINT) AS available_dois FROM fx_reference_rows r LEFT JOIN have h ON h.doi = r.doi""")
def reference_scope(spark, sf):
    rows = view(spark, sf, "fx_reference_rows").withColumnsRenamed({"oil_type": "Oil_Type", "emulsion_type": "Emulsion_Type", "droplet_um": "Droplet_Size_um"})
    ids = rows.select(F.col("reference_row_id").alias("row_id"), "doi")
    return al.scope(ids, al.reference_fields(rows, FIELDS), view(spark, sf, "fx_documents").where("status <> 'stale'"))


@query("missing_sources", """SELECT DISTINCT doi FROM fx_reference_rows WHERE doi NOT IN (SELECT doi FROM fx_documents WHERE status <> 'stale')""")
def missing_sources(spark, sf):
    return al.missing_sources(view(spark, sf, "fx_reference_rows"), view(spark, sf, "fx_documents").where("status <> 'stale'").withColumn("doi", F.upper("doi")))


@query("available_reference_dois", """SELECT doi FROM fx_reference_rows INTERSECT SELECT doi FROM fx_documents WHERE status <> 'stale'""")
def available_reference_dois(spark, sf):
    return view(spark, sf, "fx_reference_rows").select("doi").intersect(view(spark, sf, "fx_documents").where("status <> 'stale'").select("doi"))


@query("reference_violations", """SELECT p_partkey AS reference_row_id, CASE WHEN p_partkey % 7 = 0 THEN 'no valid DOI' ELSE 'not an original manual value' END AS reason
FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 9 = 0""")
def reference_violations(spark, sf):
    p = view(spark, sf, "fx_reference_rows")
    k = F.col("reference_row_id")
    return al.reference_violations(p.withColumn("doi", F.when(k % 7 == 0, F.lit("not a DOI")).otherwise(F.col("doi"))).withColumn(
        "origin", F.when(k % 9 == 0, "imputed")))


@query("landed_reference", """WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS reference_row_id,
  CASE WHEN p_partkey % 13 = 0 THEN '{"DOI": "10.1234/s' || p_partkey || '", "Oil_Type": '
       ELSE '{"DOI": "' || CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE 'https://doi.org/10.1234/S' || p_partkey END || '", "Oil_Type": "' || p_type || '", "Droplet_Size_um": '
         || CASE WHEN p_partkey % 11 = 0 THEN '[' || p_size || ']' WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END || '}' END AS raw FROM part),
r AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'no JSON object' WHEN p_partkey % 11 = 0 THEN 'nested field' WHEN p_partkey % 7 = 0 THEN 'no valid DOI' END AS reason FROM t)
SELECT CAST(reference_row_id AS BIGINT) AS reference_row_id, sha256(raw) AS row_hash, reason, CASE WHEN reason IS NULL THEN lower('10.1234/S' || p_partkey) END AS doi,
  CASE WHEN reason IS NULL THEN p_type END AS oil_type, CASE WHEN reason IS NULL AND p_partkey % 5 <> 0 THEN CAST(p_size AS STRING) END AS droplet
FROM r JOIN part USING (p_partkey)""")
def landed_reference(spark, sf):
    """Reference rows of all parts land as JSON lines, some of them broken, nested or without a DOI, and are read with reasons."""
    c = F.col
    k = c("p_partkey")
    doi = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("https://doi.org/10.1234/S"), k))
    size = F.when(k % 11 == 0, F.concat(F.lit("["), "p_size", F.lit("]"))).when(k % 5 == 0, "null").otherwise(c("p_size").cast("string"))
    whole = F.concat(F.lit('{"DOI": "'), doi, F.lit('", "Oil_Type": "'), "p_type", F.lit('", "Droplet_Size_um": '), size, F.lit("}"))
    line = F.when(k % 13 == 0, F.concat(F.lit('{"DOI": "10.1234/s'), k, F.lit('", "Oil_Type": '))).otherwise(whole)
    path = scratch_path(spark, "reference")
    view(spark, sf, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select(line.alias("value")).write.text(path)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return reference.read_reference_rows(spark, path).select("reference_row_id", "row_hash", "reason", "doi", field("Oil_Type").alias("oil_type"),
                                                             field("Droplet_Size_um").alias("droplet"))


@query("family_partition", """SELECT s_name AS study_family, CASE WHEN CAST(CAST('0x' || substr(sha256('evloom-split:' || s_name), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < 0.2
  THEN 'holdout' ELSE 'development' END AS part FROM supplier""")
def family_partition(spark, sf):
    s = view(spark, sf, "supplier")
    return s.select(F.col("s_name").alias("study_family"), text.family_split(F.col("s_name"), "evloom-split").alias("part")).distinct()


@query("printed_cells", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 5 WHEN 0 THEN 'lt' WHEN 1 THEN 'ge' WHEN 2 THEN 'exact' WHEN 3 THEN 'le' ELSE 'exact' END AS qualifier,
  CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE l_quantity END AS value FROM lineitem""")
def printed_cells(spark, sf):
    l = view(spark, sf, "lineitem")
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("bigint").cast("string")
    cell = F.when(k == 0, F.concat(F.lit(" <"), q)).when(k == 1, F.concat(F.lit(">= "), q)).when(k == 2, F.concat(q, F.lit(".0e0 "))).when(
        k == 3, F.concat(F.lit("≤"), q)).otherwise(F.concat(q, F.lit(" um")))
    p = text.parse_cell(cell)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p["qualifier"].alias("qualifier"), p["value"].alias("value"))


def _w(s, t):
    z = Z975
    c = f"(({s}) / ({t}) + {z * z} / (2 * ({t}))) / (1 + {z * z} / ({t}))"
    h = f"{z} * sqrt(({s}) / ({t}) * (1 - ({s}) / ({t})) / ({t}) + {z * z} / (4 * ({t}) * ({t}))) / (1 + {z * z} / ({t}))"
    return f"{sql_stable(f'greatest(0.0, {c} - {h})')} AS lower, {sql_stable(f'least(1.0, {c} + {h})')} AS upper"


@query("adjudication_metrics", f"""WITH d AS (SELECT *, reviewer IS NOT NULL AS complete FROM fx_decisions),
m AS (SELECT 'accepted_field_precision' AS metric, sum(CASE WHEN accepted AND correct THEN 1 ELSE 0 END) AS s, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS t FROM d WHERE complete
 UNION ALL SELECT 'recoverable_field_recall', sum(CASE WHEN recoverable AND accepted AND correct THEN 1 ELSE 0 END), sum(CASE WHEN recoverable THEN 1 ELSE 0 END) FROM d WHERE complete
 UNION ALL SELECT 'abstention_rate', sum(CASE WHEN abstained THEN 1 ELSE 0 END), count(*) FROM d WHERE complete
 UNION ALL SELECT CASE WHEN source_type IN ('text', 'table') THEN 'text_table' ELSE source_type END, sum(CASE WHEN accepted AND correct THEN 1 ELSE 0 END), count(*) FROM d WHERE complete AND recoverable GROUP BY 1)
SELECT metric, CAST(s AS BIGINT) AS successes, CAST(t AS BIGINT) AS trials, {sql_stable('s / t')} AS estimate, {_w('s', 't')},
  CASE metric WHEN 'accepted_field_precision' THEN CASE WHEN s / t >= 0.98 THEN 'true' ELSE 'false' END WHEN 'text_table' THEN CASE WHEN s / t >= 0.95 THEN 'true' ELSE 'false' END
    WHEN 'figure' THEN CASE WHEN s / t >= 0.9 THEN 'true' ELSE 'false' END END AS target_met FROM m""")
def adjudication_metrics(spark, sf):
    m = adj.metrics(view(spark, sf, "fx_decisions"))
    return m.select("metric", "successes", "trials", *[stable(F.col(x)).alias(x) for x in ("estimate", "lower", "upper")], F.col("target_met").cast("string").alias("target_met"))


@query("adjudication_counts", """SELECT CAST(count(*) AS BIGINT) AS decisions, CAST(sum(CASE WHEN reviewer IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS adjudicated,
  CAST(sum(CASE WHEN reviewer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN reviewer IS NOT NULL AND accepted AND correct AND additional_to_manual THEN 1 ELSE 0 END) AS BIGINT) AS verified_additions,
  'partial_adjudication' AS status FROM fx_decisions""")
def adjudication_counts(spark, sf):
    return adj.counts(view(spark, sf, "fx_decisions"))


@query("decision_violations", """SELECT source AS study_family, 'key is repeated' AS reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT d.source, d.lang, count(*) AS c FROM documents d GROUP BY 1, 2 HAVING count(*) > 1) x GROUP BY 1""")
def decision_violations(spark, sf):
    d = view(spark, sf, "documents").select(F.col("source").alias("study_family"), F.lit("same").alias("experiment_id"), F.col("lang").alias("field"), F.lit("r").alias("reviewer"),
                                            F.lit("p. 1").alias("source_locator"), F.lit(True).alias("correct"), F.lit(True).alias("recoverable"), F.lit(True).alias("accepted"), F.lit("text").alias("source_type"))
    return adj.decision_violations(d).groupBy("study_family", "reason").agg(F.count("*").alias("n"))


@query("family_bootstrap", f"""WITH d AS (SELECT * FROM fx_decisions WHERE reviewer IS NOT NULL),
fam AS (SELECT study_family, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS acc, sum(CASE WHEN accepted AND correct THEN 1 ELSE 0 END) AS acc_ok,
  sum(CASE WHEN recoverable THEN 1 ELSE 0 END) AS rec, sum(CASE WHEN recoverable AND accepted AND correct THEN 1 ELSE 0 END) AS rec_ok FROM d GROUP BY 1),
draw AS (SELECT r.range AS rep, fam.*, CAST(CAST('0x' || substr(md5('2026:' || r.range || ':' || study_family), 1, 12) AS BIGINT) AS DOUBLE) / CAST(281474976710656 AS DOUBLE) AS u FROM range(1000) r, fam),
wt AS (SELECT *, {' + '.join(f"CAST(u >= CAST('{x!r}' AS DOUBLE) AS BIGINT)" for x in adj.poisson_steps())} AS m FROM draw),
q AS (SELECT rep, sum(m * acc_ok) / sum(m * acc) AS p, sum(m * rec_ok) / sum(m * rec) AS r FROM wt GROUP BY 1 HAVING sum(m * acc) > 0 AND sum(m * rec) > 0)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM fam) AS families, {sql_stable('quantile_cont(p, 0.025)')} AS precision_lower, {sql_stable('quantile_cont(p, 0.975)')} AS precision_upper,
  {sql_stable('quantile_cont(r, 0.025)')} AS recall_lower, {sql_stable('quantile_cont(r, 0.975)')} AS recall_upper FROM q""")
def family_bootstrap(spark, sf):
    b = adj.family_bootstrap(view(spark, sf, "fx_decisions"))
    return b.select("families", *[stable(F.col(x)).alias(x) for x in ("precision_lower", "precision_upper", "recall_lower", "recall_upper")])


def effects(spark, sf, measure="MD"):
    return syn.with_effects(view(spark, sf, "fx_contrast_pairs"), measure)


EFFECTS = """SELECT contrast_id, {cols}, CASE WHEN n_t < 2 OR n_c < 2 THEN 'n must be at least 2' {extra} END AS effect_reason FROM fx_contrast_pairs"""


@query("mean_differences", EFFECTS.format(extra="", cols=f"""CASE WHEN n_t >= 2 AND n_c >= 2 THEN {sql_stable('mean_t - mean_c')} END AS yi,
  CASE WHEN n_t >= 2 AND n_c >= 2 THEN {sql_stable('sd_t * sd_t / n_t + sd_c * sd_c / n_c')} END AS vi"""))
def mean_differences(spark, sf):
    return effects(spark, sf).select("contrast_id", stable(F.col("yi")).alias("yi"), stable(F.col("vi")).alias("vi"), "effect_reason")


@query("log_response_ratios", EFFECTS.format(extra="", cols=f"""CASE WHEN n_t >= 2 AND n_c >= 2 THEN {sql_stable('ln(mean_t) - ln(mean_c)')} END AS yi,
  CASE WHEN n_t >= 2 AND n_c >= 2 THEN {sql_stable('(sd_t / mean_t) * (sd_t / mean_t) / n_t + (sd_c / mean_c) * (sd_c / mean_c) / n_c')} END AS vi"""))
def log_response_ratios(spark, sf):
    return effects(spark, sf, "ROM").select("contrast_id", stable(F.col("yi")).alias("yi"), stable(F.col("vi")).alias("vi"), "effect_reason")


@query("pooling_eligibility", """WITH e AS (SELECT analysis_id, study_family, count(*) AS m FROM fx_contrast_pairs WHERE n_t >= 2 AND n_c >= 2 GROUP BY 1, 2)
SELECT analysis_id, CAST(sum(m) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS families, CASE WHEN max(m) > 1 THEN 'true' ELSE 'false' END AS dependent,
  CASE WHEN max(m) > 1 THEN 'dependent effects require a sampling covariance' END AS limitation, CASE WHEN count(*) < 5 THEN 'few study families: interpret intervals cautiously' END AS caution FROM e GROUP BY 1""")
def pooling_eligibility(spark, sf):
    return syn.eligibility(effects(spark, sf).where("effect_reason is null")).withColumn("dependent", F.col("dependent").cast("string"))


REML = """WITH RECURSIVE e AS (SELECT analysis_id, contrast_id AS study_family, mean_t - mean_c AS yi, sd_t * sd_t / n_t + sd_c * sd_c / n_c AS vi FROM fx_contrast_pairs WHERE n_t >= 2 AND n_c >= 2),
st AS (SELECT analysis_id, 0 AS step, greatest(0.0, var_samp(yi) - avg(vi)) AS tau2 FROM e GROUP BY 1
  UNION ALL SELECT analysis_id, step + 1, greatest(0.0, tau2 + (s2yy - 2 * sy / s1 * s2y + (sy / s1) * (sy / s1) * s2 - (s1 - s2 / s1)) / (s2 - 2 * s3 / s1 + (s2 / s1) * (s2 / s1))) FROM (
    SELECT st.analysis_id, max(st.step) AS step, max(st.tau2) AS tau2, sum(1 / (vi + tau2)) AS s1, sum(1 / ((vi + tau2) * (vi + tau2))) AS s2, sum(1 / ((vi + tau2) * (vi + tau2) * (vi + tau2))) AS s3,
      sum(yi / (vi + tau2)) AS sy, sum(yi / ((vi + tau2) * (vi + tau2))) AS s2y, sum(yi * yi / ((vi + tau2) * (vi + tau2))) AS s2yy
    FROM st JOIN e ON e.analysis_id = st.analysis_id WHERE st.step < 25 GROUP BY st.analysis_id) x),
t AS (SELECT analysis_id, tau2 FROM st WHERE step = 25),
s AS (SELECT e.analysis_id, max(tau2) AS tau2, count(*) AS k, sum(1 / (vi + tau2)) AS s1, sum(yi / (vi + tau2)) AS sy, sum(yi * yi / (vi + tau2)) AS syy,
  sum(1 / vi) AS z1, sum(1 / (vi * vi)) AS z2, sum(yi / vi) AS zy, sum(yi * yi / vi) AS zyy FROM e JOIN t ON t.analysis_id = e.analysis_id GROUP BY 1)"""


@query("pooled_estimates", REML + f""" SELECT analysis_id, CAST(k AS BIGINT) AS k, {sql_stable('sy / s1')} AS estimate, {sql_stable('tau2', 4)} AS tau_squared,
  {sql_stable('sqrt(1 / s1) * sqrt(greatest(1.0, (syy - sy * sy / s1) / (k - 1)))')} AS se, {sql_stable('100 * tau2 / (tau2 + (k - 1) / (z1 - z2 / z1))', 4)} AS i_squared,
  {sql_stable('zyy - zy * zy / z1', 3)} AS q FROM s""")
def pooled_estimates(spark, sf):
    e = effects(spark, sf).where("effect_reason is null").withColumn("study_family", F.col("contrast_id"))
    p = pooling.reml(e.select("analysis_id", "study_family", "yi", "vi"), tolerance=1e-9)
    return p.select("analysis_id", "k", stable(F.col("estimate")).alias("estimate"), stable(F.col("tau_squared"), 4).alias("tau_squared"), stable(F.col("se")).alias("se"),
                    stable(F.col("i_squared"), 4).alias("i_squared"), stable(F.col("q"), 3).alias("q"))


@query("pooled_intervals")
def pooled_intervals(spark, sf):
    """Log response ratios pooled with intervals, p-values and back-transformed ratios."""
    e = effects(spark, sf, "ROM").where("effect_reason is null").withColumn("study_family", F.col("contrast_id"))
    return pooling.with_intervals(pooling.reml(e.select("analysis_id", "study_family", "yi", "vi"), tolerance=1e-9), "ROM")


def dependent(spark, sf):
    """Effects of families with several members, and a within-family covariance at correlation 0.5."""
    c = F.col
    # where an id repeats, the least row stays, whichever task reads it
    e = effects(spark, sf).where("effect_reason is null").groupBy("contrast_id").agg(F.min(F.struct("analysis_id", "study_family", "yi", "vi")).alias("x")).select(
        "x.analysis_id", "contrast_id", "x.study_family", "x.yi", "x.vi")
    e = written(e, "effects")
    i, j = e.alias("i"), e.alias("j")
    v = i.join(j, (c("i.analysis_id") == c("j.analysis_id")) & (c("i.study_family") == c("j.study_family"))).select(
        c("i.analysis_id").alias("analysis_id"), c("i.contrast_id").alias("id_i"), c("j.contrast_id").alias("id_j"),
        F.when(c("i.contrast_id") == c("j.contrast_id"), c("i.vi")).otherwise(0.5 * F.sqrt(c("i.vi") * c("j.vi"))).alias("cov"))
    return e, written(v, "covariance")


@query("clustered_estimates")
def clustered_estimates(spark, sf):
    e, v = dependent(spark, sf)
    return pooling.cluster_robust(e, v)


@query("covariance_violations", """WITH e AS (SELECT DISTINCT contrast_id, analysis_id FROM fx_contrast_pairs WHERE n_t >= 2 AND n_c >= 2)
SELECT analysis_id, 'diagonal differs from the sampling variance' AS reason FROM e WHERE analysis_id IN ('analysis-3', 'analysis-7') GROUP BY 1""")
def covariance_violations(spark, sf):
    e, v = dependent(spark, sf)
    wrong = F.when(F.col("analysis_id").isin("analysis-3", "analysis-7") & (F.col("id_i") == F.col("id_j")), F.col("cov") * 2).otherwise(F.col("cov"))
    return pooling.covariance_violations(e, v.withColumn("cov", wrong))


SPEC = {"outcome_definition": "size", "measurement_method": "microscopy", "comparator": "none", "time_point": "day", "unit": "um"}


def contrasts(spark, sf):
    """Contrast pairs with protocol fields; two analyses keep a single family, one of them a wrong unit, others one effect per family."""
    c = F.col
    p = view(spark, sf, "fx_contrast_pairs")
    n = F.substring_index("analysis_id", "-", -1).cast("int")
    fields = {k: F.lit(v) for k, v in SPEC.items()} | {"unit": F.when(n == 3, "mm").otherwise("um")}
    return p.withColumns(fields).withColumns({
        "study_family": F.when(n == 5, "only").when(n % 2 == 0, c("contrast_id")).otherwise(c("study_family")), "concentration_basis": F.lit(None).cast("string"),
        "paired": F.lit(False), "arms_independent": F.lit(True), "qualifier_t": F.lit("exact"), "qualifier_c": F.lit("exact"), "position": F.lit(1)}), n


@query("inferential_status", """WITH p AS (SELECT *, CAST(split_part(analysis_id, '-', -1) AS INTEGER) AS n FROM fx_contrast_pairs),
e AS (SELECT analysis_id, CASE WHEN n = 5 THEN 'only' WHEN n % 2 = 0 THEN contrast_id ELSE study_family END AS family FROM p WHERE n_t >= 2 AND n_c >= 2 AND n <> 3),
f AS (SELECT analysis_id, family, count(*) AS m FROM e GROUP BY 1, 2), g AS (SELECT analysis_id, sum(m) AS k, count(*) AS families, max(m) AS largest FROM f GROUP BY 1)
SELECT a.analysis_id, CASE WHEN g.k IS NULL OR families < 2 OR largest > 1 THEN 'ineligible' ELSE 'completed' END AS status,
  CASE WHEN g.k IS NULL OR families < 2 THEN 'at least two eligible study families are required' WHEN largest > 1 THEN 'dependent effects require a sampling covariance' END AS limitation,
  CAST(g.k AS BIGINT) AS k, CAST(NOT (g.k IS NULL OR families < 2 OR largest > 1) AS STRING) AS has_estimate FROM (SELECT DISTINCT analysis_id FROM p) a LEFT JOIN g ON g.analysis_id = a.analysis_id""")
def inferential_status(spark, sf):
    rows, _ = contrasts(spark, sf)
    out, _ = inference.inferential(rows, SPEC)
    return out.select("analysis_id", "status", "limitation", "k", F.col("estimate").isNotNull().cast("string").alias("has_estimate"))


@query("inferential_excluded", """SELECT analysis_id, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT analysis_id, unnest(list_filter([CASE WHEN split_part(analysis_id, '-', -1) = '3' THEN 'incompatible unit' END,
  CASE WHEN n_t < 2 OR n_c < 2 THEN 'n must be at least 2' END], lambda x: x IS NOT NULL)) AS reason FROM fx_contrast_pairs) x GROUP BY 1, 2""")
def inferential_excluded(spark, sf):
    rows, _ = contrasts(spark, sf)
    _, left = inference.inferential(rows, SPEC)
    return left.select("analysis_id", F.explode("reasons").alias("reason")).groupBy("analysis_id", "reason").agg(F.count("*").alias("n"))


@query("loaded_decisions", """SELECT coalesce(reviewer, 'none') AS reviewer, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM fx_decisions GROUP BY 1""")
def loaded_decisions(spark, sf):
    """Decisions written as JSON lines and read back."""
    from evloom.session import scratch_path
    from evloom.sources import files
    path = scratch_path(spark, "decisions")
    view(spark, sf, "fx_decisions").write.json(path)
    d = files.read_decisions(spark, path)
    return d.groupBy(F.coalesce("reviewer", F.lit("none")).alias("reviewer")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("correct"))
