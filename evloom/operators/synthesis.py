"""Effective status, comparable groups, contrasts and sampling effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import text, units
from evloom.functions.status import READER_INACTIVE
from evloom.operators.primitives import exact_median, null_safe
from evloom.session import cut, written

# What makes two observations comparable, and two contrasts poolable.
COMPARABLE_KEY = ["outcome", "unit", "measurement_method", "statistic", "time_value", "time_unit", "concentration_basis"]
COMPATIBILITY = ["outcome_definition", "measurement_method", "comparator", "time_point", "unit"]


def effective_status(measurements: DataFrame, evidence: DataFrame, experiments: DataFrame, documents: DataFrame,
                     inactive: list[str] = READER_INACTIVE, carry: list[str] | None = None) -> DataFrame:
    """Stored status, or ``stale`` if the experiment's source or any cited document is inactive.

    Only the ids of measurements that cite an inactive document travel, and the experiments are
    joined once; ``carry`` names further experiment columns to bring along in that join.
    """
    c = F.col
    dead_documents = documents.where(c("status").isin(*inactive)).select("document_hash")
    dead = evidence.join(dead_documents, "document_hash", "left_semi").select("measurement_id").distinct().withColumn("__dead", F.lit(True))
    facts = experiments.select("experiment_id", c("source_status").alias("__source"), *(carry or []))
    stale = c("__dead").isNotNull() | F.coalesce(c("__source").isin(*inactive), F.lit(False))
    return (measurements.join(dead, "measurement_id", "left").join(facts, "experiment_id", "left")
            .withColumn("effective_status", F.when(stale, "stale").otherwise(c("status"))).drop("__dead", "__source"))


def with_normalized(measurements: DataFrame) -> DataFrame:
    """Add normalized_value, normalized_unit and the reason; a contradicted basis turns uncertain.

    A percentage of something is never converted without a stated basis. The original pair stays.
    """
    c = F.col
    problem = units.basis_problem(c("outcome"), c("value"), c("unit"), c("concentration_basis"))
    joined = units.attach_conversion(measurements.withColumn("__problem", problem), c("outcome"), c("unit"), units.OUTCOME_TARGETS)
    usable = c("__problem").isNull() & c("__unit").isNotNull() & c("value").isNotNull()
    note = (F.when(c("value").isNull() | (F.coalesce(c("unit"), F.lit("")) == ""), F.lit(None).cast("string"))
            .when(c("__problem") == "none stated", "basis unavailable, conversion withheld")
            .when(c("__problem") == "contradicted", "printed unit disagrees with basis")
            .when(c("__unit").isNull(), "unit unsupported or incompatible, normalization withheld")
            .otherwise("converted, original value retained"))
    status = F.when(c("__problem").eqNullSafe("contradicted"), "uncertain").otherwise(c("status"))
    return joined.select(
        *[status.alias("status") if x == "status" else c(x) for x in measurements.columns],
        F.when(usable, units.converted(c("value"))).alias("normalized_value"),
        F.when(usable, c("__unit")).alias("normalized_unit"), note.alias("normalization_note"))


def _observed(measurements: DataFrame) -> DataFrame:
    """Value and unit as they enter a summary: the normalized pair where there is one."""
    unit = F.when(F.col("normalized_value").isNotNull(), F.col("normalized_unit")).otherwise(F.col("unit"))
    return (measurements.withColumn("value", F.coalesce("normalized_value", "value")).withColumn("unit", unit))


def exclusion_reason() -> Column:
    """Why a measurement stays out of numerical summaries; null when it enters."""
    numeric = F.col("status").eqNullSafe("accepted") & F.col("qualifier").eqNullSafe("exact") & \
        ~F.col("origin").eqNullSafe("curve_sample")
    return F.when(~numeric, "not an accepted exact observation").when(~text.finite(F.col("value")), "no finite observed value")


def excluded(measurements: DataFrame) -> DataFrame:
    return (_observed(measurements).withColumn("reason", exclusion_reason()).where("reason is not null")
            .select("experiment_id", "measurement_id", "reason"))


def descriptive(measurements: DataFrame, family: str = "study_family", median: bool = True) -> DataFrame:
    """One row per comparable group: n, families, min, max, mean and exact median.

    Nulls in the key form groups of their own. The distinct family count aggregates by
    (key, family) first, so a group that owns a third of the rows is spread over its families.
    """
    usable = _observed(measurements).where(exclusion_reason().isNull())
    # one pre-aggregation feeds everything below, so the input is scanned and shuffled once
    counted = cut(usable.groupBy(*COMPARABLE_KEY, "value", family).agg(F.count("*").alias("__n")))
    out = counted.groupBy(*COMPARABLE_KEY).agg(
        F.sum("__n").alias("n"), F.countDistinct(family).alias("study_families"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        (F.sum(F.col("value") * F.col("__n")) / F.sum("__n")).alias("mean"))
    if not median:
        return out
    return null_safe(out, exact_median(counted, COMPARABLE_KEY, "value", weight="__n"), COMPARABLE_KEY)


def comparable_rows(measurements: DataFrame, include_candidates: bool = False) -> DataFrame:
    """Rows that may be compared: method, statistic and unit stated, exact, finite, not a curve sample.

    The group key is a hash column; values stay one per row, so no group is ever collected.
    """
    statuses = ["accepted", "candidate"] if include_candidates else ["accepted"]
    paired = F.col("normalized_value").isNotNull() & (F.coalesce(F.col("normalized_unit"), F.lit("")) != "")
    shown = (measurements.withColumn("__v", F.when(paired, F.col("normalized_value")).otherwise(F.col("value")))
             .withColumn("__u", F.when(paired, F.col("normalized_unit")).otherwise(F.col("unit")))
             .drop("value", "unit").withColumnsRenamed({"__v": "value", "__u": "unit"}))
    stated = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("unit", "measurement_method", "statistic")]
    keep = F.col("status").isin(*statuses) & F.col("qualifier").eqNullSafe("exact") & \
        ~F.col("origin").eqNullSafe("curve_sample") & text.finite(F.col("value"))
    for s in stated:
        keep = keep & s
    return shown.where(keep).withColumn("group_key", text.fingerprint(*[F.col(k) for k in COMPARABLE_KEY]))


def comparable_groups(measurements: DataFrame, include_candidates: bool = False) -> DataFrame:
    """Size and unique studies of each comparable group, in outcome and method order."""
    rows = comparable_rows(measurements, include_candidates)
    return (rows.groupBy(*COMPARABLE_KEY).agg(
        F.count("*").alias("n"), F.sum("value").alias("value_sum"),
        F.countDistinct(F.coalesce("study_family", "experiment_id")).alias("studies"))
        .orderBy("outcome", "measurement_method"))


def histogram(measurements: DataFrame, width: float, include_candidates: bool = False) -> DataFrame:
    """Counts per comparable group and value bin of the given width."""
    rows = comparable_rows(measurements, include_candidates)
    return (rows.withColumn("bin", F.floor(F.col("value") / F.lit(width)).cast("bigint"))
            .groupBy(*COMPARABLE_KEY, "bin").agg(F.count("*").alias("n")))


def arm_reason() -> Column:
    """First reason why a measurement cannot be an arm of a contrast; null when it can."""
    c = F.col
    return (F.when(~c("status").eqNullSafe("accepted"), "not accepted")
            .when(~c("qualifier").eqNullSafe("exact"), "not exact")
            .when(c("origin").eqNullSafe("curve_sample"), "curve sample")
            .when(~F.coalesce(c("statistic").isin("mean", "arithmetic_mean"), F.lit(False)), "not a mean")
            .when(~c("uncertainty_type").eqNullSafe("SD") | c("uncertainty").isNull() | (c("uncertainty") < 0), "no standard deviation")
            .when(c("n_independent").isNull() | (c("n_independent") < 2), "fewer than two independent replicates")
            .when(c("value").isNull(), "no value")
            .when(F.coalesce(c("evidence_count"), F.lit(0)) == 0, "no evidence"))


def experiment_definitions(attributes: DataFrame) -> DataFrame:
    """Per experiment, the definitions a contrast needs, each with the reason it is unusable.

    ``attributes`` has experiment_id, name, text, status, evidence_count and foreign_evidence (how
    many of its evidence rows cite another source than the experiment's own).
    """
    c = F.col
    names = ["outcome_definition", "comparator", "arms_independent"]
    # only a name that occurs once counts, so each row is judged before rows meet, and one aggregate suffices
    ok = (c("status") == "accepted") & (c("evidence_count") > 0) & (c("foreign_evidence") == 0)
    stated = attributes.where(c("name").isin(*names)).select("experiment_id", "name", F.when(ok, c("text")).alias("text"))
    single = stated.groupBy("experiment_id").agg(*[F.when(F.count_if(c("name") == n) == 1, F.min(F.when(c("name") == n, c("text")))).alias(n) for n in names])
    return single.where(F.coalesce(*names).isNotNull())


def _arms(measurements: DataFrame, experiments: DataFrame, definitions: DataFrame, spec: dict) -> DataFrame:
    """Per measurement, the reason why it is no arm of the specified contrast, empty if it is one.

    Experiment, family and numbers (mean, SD, n) are told of usable arms only. What a measurement says by
    itself is settled before it moves to its experiment, so that few columns travel, and the numbers are
    one array, so that both sides of a contrast read the same columns and share one shuffle.
    """
    c = F.col
    target = spec["unit"]
    same = lambda name, value: c(name).eqNullSafe(F.lit(value))
    own = F.coalesce(arm_reason(), F.when(c("source_active") == F.lit(False), "source not active"))
    fits = (same("outcome", spec.get("outcome")) & same("measurement_method", spec.get("measurement_method"))
            & same("concentration_basis", spec.get("concentration_basis"))
            & text.time_point(c("time_value"), c("time_unit")).eqNullSafe(F.lit(spec.get("time_point"))))
    numbers = F.array(units.convert(c("value"), c("unit"), target), units.convert_spread(c("value"), c("uncertainty"), c("unit"), target),
                      c("n_independent").cast("bigint").cast("double"))
    told = (measurements.withColumn("__own", own).withColumn("__fits", c("__own").isNull() & fits)
            .select("measurement_id", "experiment_id", "__own", "__fits", F.when(c("__fits"), numbers).alias("__numbers")))
    named = ["outcome_definition", "comparator"]
    unstated = c("outcome_definition").isNull() | c("comparator").isNull() | c("arms_independent").isNull()
    agreed = definitions.select("experiment_id", F.when(~unstated, same("arms_independent", "true") & same(named[0], spec.get(named[0])) & same(named[1], spec.get(named[1]))).alias("__agreed"))
    facts = told.join(experiments.select("experiment_id", "study_family"), "experiment_id").join(agreed, "experiment_id", "left")
    reason = F.coalesce(
        c("__own"), F.when(c("__agreed").isNull(), "definition missing or ambiguous"),
        F.when(~c("__fits") | ~c("__agreed"), "differs from the registered specification"),
        F.when(c("__numbers")[0].isNull(), "unit cannot be converted"), F.lit(""))
    arm = facts.select("measurement_id", reason.alias("reason"), "experiment_id", "study_family", c("__numbers").alias("numbers"))
    usable = c("reason") == ""
    return arm.select("measurement_id", "reason", *[F.when(usable, c(x)).alias(x) for x in ("experiment_id", "study_family", "numbers")])


def derive_contrasts(proposals: DataFrame, measurements: DataFrame, experiments: DataFrame, definitions: DataFrame,
                     spec: dict, strict: bool = False, rel: float = 1e-8, absolute: float = 1e-10) -> DataFrame:
    """Resolve proposed treatment / control pairs from stored evidence, never from proposed numbers.

    Two equi-joins per arm, no group is collected. Each output row has either both arms or the first
    reason it was refused. ``proposals`` may carry supplied numbers (treatment_mean, treatment_sd,
    treatment_n, control_…); they are only checked. ``strict`` fails the job on any refusal.
    """
    c = F.col
    arm = written(_arms(measurements, experiments, definitions, spec), "arms")  # both sides look arms up

    def side(name: str) -> DataFrame:
        return arm.select(*[F.col(x).alias(f"{name}_{x}" if x == "measurement_id" else f"__{name}_{x}") for x in arm.columns])

    def disagrees(name: str) -> Column:
        out = F.lit(False)
        for i, k in enumerate(("mean", "sd", "n")):
            given = f"{name}_{k}"
            if given in proposals.columns:
                out = out | (c(given).isNotNull() & ~text.close(c(given).cast("double"), c(f"__{name}_numbers")[i], rel, absolute))
        return out

    # after the first look-up only what the second one and the reasons ask for goes on
    supplied = [f"control_{k}" for k in ("mean", "sd", "n") if f"control_{k}" in proposals.columns]
    treated = proposals.join(side("treatment"), "treatment_measurement_id", "left").select(
        "contrast_id", "treatment_measurement_id", "control_measurement_id", *supplied, *[f"__treatment_{x}" for x in arm.columns if x != "measurement_id"],
        disagrees("treatment").alias("__off"), (c("treatment_measurement_id") == c("control_measurement_id")).alias("__alone"))
    joined = treated.join(side("control"), "control_measurement_id", "left")
    reason = F.coalesce(
        F.when(c("__treatment_reason").isNull(), "treatment: no retained measurement"),
        F.when(c("__control_reason").isNull(), "control: no retained measurement"),
        *[F.when(c(f"__{name}_reason") != "", F.concat(F.lit(f"{name}: "), c(f"__{name}_reason"))) for name in ("treatment", "control")],
        F.when(c("__off") | disagrees("control"), "supplied numbers disagree with the evidence"),
        F.when((c("__treatment_experiment_id") == c("__control_experiment_id")) | c("__alone"), "arms are not distinct"),
        F.when(c("__treatment_study_family") != c("__control_study_family"), "arms belong to different study families"))
    ok = c("reason").isNull()
    number = lambda name, i: c(f"__{name}_numbers")[i].cast("bigint") if i == 2 else c(f"__{name}_numbers")[i]
    out = joined.withColumn("reason", reason).select(
        "contrast_id", "treatment_measurement_id", "control_measurement_id", "reason",
        F.when(ok, c("__treatment_study_family")).alias("study_family"),
        *[F.when(ok, number(a, i)).alias(f"{s}_{p}") for a, p in (("treatment", "t"), ("control", "c"))
          for i, s in enumerate(("mean", "sd", "n"))])
    if strict:
        bad = out.where("reason is not null").select("contrast_id", "reason").take(1)
        if bad:
            raise ValueError(f"contrast {bad[0][0]}: {bad[0][1]}")
    return out


def effect_reason(mean: Column, sd: Column, n: Column) -> Column:
    return (F.when(mean.isNull() | sd.isNull() | n.isNull(), "mean, SD and n must be reported")
            .when(n < 2, "n must be at least 2")
            .when(~text.finite(mean) | ~text.finite(sd) | (sd < 0), "finite mean and nonnegative SD required"))


def with_effects(contrasts: DataFrame, measure: str = "MD") -> DataFrame:
    """Add yi, vi and effect_reason. A zero variance excludes the contrast; it is never repaired."""
    c = F.col
    t, s = (c("mean_t"), c("sd_t"), c("n_t")), (c("mean_c"), c("sd_c"), c("n_c"))
    if measure == "MD":
        yi = t[0] - s[0]
        vi = F.try_divide(t[1] * t[1], t[2]) + F.try_divide(s[1] * s[1], s[2])
        domain = F.lit(None).cast("string")
    elif measure == "ROM":
        positive = (t[0] > 0) & (s[0] > 0)
        yi = F.when(positive, F.ln(t[0]) - F.ln(s[0]))
        vi = F.when(positive, F.try_divide(F.pow(t[1] / t[0], 2), t[2]) + F.try_divide(F.pow(s[1] / s[0], 2), s[2]))
        domain = F.when(~positive, "log response ratios require positive means")
    else:
        raise ValueError("measure must be MD or ROM")
    # told without the reasons, which always end in one: a filter on usable rows, moved below these columns, is a few comparisons
    usable = F.coalesce((t[2] >= 2) & (s[2] >= 2) & (t[1] >= 0) & (s[1] >= 0) & (vi > 0) & (vi < float("inf")) & (F.abs(yi) < float("inf")), F.lit(False))
    reason = F.coalesce(effect_reason(*t), effect_reason(*s), domain, F.lit("a positive sampling variance is required"))
    ok = c("effect_reason").isNull()
    return contrasts.withColumn("effect_reason", F.when(~usable, reason)).withColumns({"yi": F.when(ok, yi), "vi": F.when(ok, vi)})


def contrast_reasons(contrasts: DataFrame, spec: dict, position: str = "position") -> DataFrame:
    """All reasons against each contrast as an array; an empty array admits it.

    A repeated id keeps its first row. The first position per id is an aggregate joined back, not a
    window, so an id repeated millions of times is not sorted in one task.
    """
    c = F.col
    first = contrasts.groupBy("analysis_id", "contrast_id").agg(F.min(position).alias("__first"))
    marked = null_safe(contrasts, first, ["analysis_id", "contrast_id"])
    repeat = c("contrast_id").isNull() | (c("contrast_id") == "") | (c(position) > c("__first")) | \
        c("study_family").isNull() | (c("study_family") == "")
    reasons = [F.when(repeat, "unique contrast id and study family are required")]
    for field in COMPATIBILITY:
        reasons.append(F.when(~c(field).eqNullSafe(F.lit(spec[field])), f"incompatible {field}"))
    reasons.append(F.when(~c("concentration_basis").eqNullSafe(F.lit(spec.get("concentration_basis"))), "incompatible concentration_basis"))
    reasons.append(F.when(F.coalesce(c("paired"), F.lit(False)) | ~c("arms_independent").eqNullSafe(F.lit(True)), "arms are not independent"))
    reasons.append(F.when(~c("qualifier_t").eqNullSafe("exact") | ~c("qualifier_c").eqNullSafe("exact"), "censored arm"))
    return (with_effects(marked, spec.get("effect_measure", "MD"))
            .withColumn("reasons", F.array_compact(F.array(*reasons, c("effect_reason")))).drop("__first", "effect_reason"))


def eligibility(effects: DataFrame, supplied_covariance: DataFrame | None = None) -> DataFrame:
    """The eligibility ladder of each analysis over its admitted effects.

    ``supplied_covariance`` has analysis_id, valid (boolean) and justification. Output: k, families,
    dependent, and the first unmet rung as ``limitation`` (null when pooling may start).
    """
    per_family = effects.groupBy("analysis_id", "study_family").agg(F.count("*").alias("m"))
    sizes = per_family.groupBy("analysis_id").agg(
        F.sum("m").cast("bigint").alias("k"), F.count("*").alias("families"), F.max("m").alias("largest"))
    if supplied_covariance is None:
        sizes = sizes.withColumn("valid", F.lit(None).cast("boolean")).withColumn("justification", F.lit(None).cast("string"))
    else:
        sizes = sizes.join(supplied_covariance, "analysis_id", "left")
    c = F.col
    given = c("valid").isNotNull()
    dependent = (c("largest") > 1) | given
    limitation = (F.when((c("k") < 2) | (c("families") < 2), "at least two eligible study families are required")
                  .when(dependent & ~given, "dependent effects require a sampling covariance")
                  .when(dependent & ~c("valid"), "covariance is not valid")
                  .when(dependent & (c("families") < 3), "cluster-robust inference requires three families")
                  .when(dependent & (F.coalesce(c("justification"), F.lit("")) == ""), "covariance needs a justification"))
    return sizes.select("analysis_id", "k", "families", dependent.alias("dependent"), limitation.alias("limitation"),
                        F.when(c("families") < 5, "few study families: interpret intervals cautiously").alias("caution"))
