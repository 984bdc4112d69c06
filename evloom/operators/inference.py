"""Treatment contrasts to pooled effects: specification, exclusion, eligibility, covariance, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.operators import pooling
from evloom.operators import synthesis as syn
from evloom.session import written


def inferential(contrasts: DataFrame, spec: dict, covariance: DataFrame | None = None, justification: str | None = None,
                tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(results, excluded): one row per analysis with status and limitation, and the contrasts left out with reasons.

    Estimates stand only in rows that climb every rung: the protocol names all compatibility fields,
    two families are eligible, dependent effects have a usable and justified covariance and three
    families, and the estimate settles. ``covariance``: analysis_id, id_i, id_j, cov.
    """
    c = F.col
    analyses = contrasts.select("analysis_id").distinct()
    missing = [f for f in syn.COMPATIBILITY if not spec.get(f)]
    if missing:
        refused = analyses.select("analysis_id", F.lit("ineligible").alias("status"), F.lit("protocol lacks " + ", ".join(missing)).alias("limitation"))
        nothing = contrasts.limit(0).select("analysis_id", "contrast_id", F.array().cast("array<string>").alias("reasons"))
        return refused, nothing
    judged = written(syn.contrast_reasons(contrasts, spec), "contrasts")
    excluded = judged.where(F.size("reasons") > 0).select("analysis_id", "contrast_id", "reasons")
    effects = judged.where(F.size("reasons") == 0).select("analysis_id", "contrast_id", "study_family", "yi", "vi")
    supplied = None
    if covariance is not None:
        bad = pooling.refused_covariance(effects.join(covariance.select("analysis_id").distinct(), "analysis_id", "left_semi"),
                                         covariance.join(effects.select("analysis_id").distinct(), "analysis_id", "left_semi"))
        supplied = covariance.select("analysis_id").distinct().join(bad, "analysis_id", "left").select(
            "analysis_id", c("reason").isNull().alias("valid"), F.lit(justification).alias("justification"), "reason")
    steps = syn.eligibility(effects, None if supplied is None else supplied.drop("reason"))
    ladder = analyses.join(steps, "analysis_id", "left")
    if supplied is not None:
        ladder = ladder.join(supplied.select("analysis_id", "reason"), "analysis_id", "left").withColumn(
            "limitation", F.when(c("limitation") == "covariance is not valid", F.concat_ws(": ", "limitation", "reason")).otherwise(c("limitation"))).drop("reason")
    none = F.when(c("k").isNull(), "at least two eligible study families are required").otherwise(c("limitation"))
    ladder = written(ladder.withColumn("limitation", none), "ladder")

    def eligible(dependent: bool) -> DataFrame:
        names = ladder.where(c("limitation").isNull() & (c("dependent") == dependent)).select("analysis_id")
        return effects.join(names, "analysis_id", "left_semi")

    plain = pooling.with_intervals(pooling.reml(eligible(False), tolerance), spec.get("effect_measure", "MD")).drop("k", "study_families")
    pooled = plain.withColumn("status", F.lit("completed"))
    if covariance is not None:
        allowed = covariance.join(eligible(True).select("analysis_id").distinct(), "analysis_id", "left_semi")
        clustered = pooling.cluster_robust(eligible(True), allowed, tolerance).drop("k", "study_families").withColumnRenamed("limitation", "__late")
        pooled = pooled.unionByName(clustered, allowMissingColumns=True)
    else:
        pooled = pooled.withColumn("__late", F.lit(None).cast("string"))
    out = ladder.join(pooled, "analysis_id", "left")
    status = F.when(c("limitation").isNotNull(), "ineligible").otherwise(F.coalesce("status", F.lit("engine_failed")))
    late = F.coalesce("limitation", "__late", F.when(c("status").isNull(), "the estimate did not settle"))
    return out.withColumn("limitation", late).withColumn("status", status).drop("__late"), excluded
