"""Metrics from reviewer decisions: precision, recall, strata and a family bootstrap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.functions.stats import wilson

SOURCE_TYPES = ["text", "table", "figure", "microscopy"]
TARGETS = {"accepted_field_precision": 0.98, "text_table": 0.95, "figure": 0.90}


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Keys that are null, repeated, or carry an unknown source type on a complete row."""
    key = ["study_family", "experiment_id", "field"]
    null_key = decisions.where(" or ".join(f"{k} is null" for k in key)).select(*key, F.lit("key is null").alias("reason"))
    repeated = decisions.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("key is repeated").alias("reason"))
    wrong = split(decisions).where("complete").where(~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False))).select(
        *key, F.lit("unknown source type").alias("reason"))
    return null_key.unionByName(repeated).unionByName(wrong)


def split(decisions: DataFrame) -> DataFrame:
    """Add ``complete``: a reviewer, a locator and all three flags are present."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flags = F.col("correct").isNotNull() & F.col("recoverable").isNotNull() & F.col("accepted").isNotNull()
    return decisions.withColumn("complete", filled("reviewer") & filled("source_locator") & flags)


def metrics(decisions: DataFrame) -> DataFrame:
    """Long table (metric, successes, trials, estimate, lower, upper, target_met)."""
    c = F.col
    d = split(decisions)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")
    ok, acc, rec, cor = c("complete"), c("accepted"), c("recoverable"), c("correct")
    stratum = F.when(c("source_type").isin("text", "table"), "text_table").otherwise(c("source_type"))
    overall = d.agg(n(ok & acc & cor).alias("s1"), n(ok & acc).alias("t1"), n(ok & rec & acc & cor).alias("s2"), n(ok & rec).alias("t2"),
                    n(ok & F.coalesce(c("abstained"), F.lit(False))).alias("s3"), n(ok).alias("t3"))
    rows = overall.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(f"s{i}").alias("successes"), c(f"t{i}").alias("trials"))
                                              for i, m in ((1, "accepted_field_precision"), (2, "recoverable_field_recall"), (3, "abstention_rate"))])).alias("r")).select("r.*")
    strata = d.where(ok & rec).groupBy(stratum.alias("metric")).agg(n(acc & cor).alias("successes"), F.count("*").alias("trials"))
    both = rows.unionByName(strata)
    p, low, high = wilson(c("successes"), c("trials"))
    target = F.lit(None).cast("double")
    for name, value in TARGETS.items():
        target = F.when(c("metric") == name, value).otherwise(target)
    return both.select("metric", "successes", "trials", p.alias("estimate"), low.alias("lower"), high.alias("upper"), (p >= target).alias("target_met"))


def counts(decisions: DataFrame) -> DataFrame:
    c = F.col
    d = split(decisions)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    out = d.agg(F.count("*").alias("decisions"), n(c("complete")).alias("adjudicated"), n(~c("complete")).alias("pending"),
                n(c("complete") & c("accepted") & c("correct") & F.coalesce(c("additional_to_manual"), F.lit(False))).alias("verified_additions"))
    return out.withColumn("status", F.when(c("decisions") == 0, "not_run").when(c("pending") == 0, "completed").otherwise("partial_adjudication"))


def poisson_steps() -> list[float]:
    """Where a uniform draw of 48 bits passes from one weight of mean one to the next."""
    steps, term = [], math.exp(-1)
    while not steps or steps[-1] < 1 - 2.0 ** -48:
        steps.append((steps[-1] if steps else 0.0) + term)
        term /= len(steps)
    return steps


def family_bootstrap(decisions: DataFrame, seed: str = "2026", replicates: int = 1000) -> DataFrame:
    """Percentile intervals of precision and recall from resampled study families.

    Every family enters a replicate with a Poisson weight drawn by a hash of (seed, replicate, family), so
    replicates need no common draw: a task keeps one row of four sums per replicate and these rows, of
    whatever number of families, are all that is shuffled. The result does not depend on partitions. One
    row; null bounds when there are fewer than two families.
    """
    c = F.col
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    d = split(decisions).where("complete")
    family = d.groupBy("study_family").agg(
        n(c("accepted")).alias("acc"), n(c("accepted") & c("correct")).alias("acc_ok"), n(c("recoverable")).alias("rec"),
        n(c("recoverable") & c("accepted") & c("correct")).alias("rec_ok"))
    every = F.sequence(F.lit(0), F.lit(replicates - 1))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), c("rep").cast("string"), F.coalesce("study_family", F.lit("")))), 1, 12), 16, 10).cast("bigint") / 2.0 ** 48
    weight = reduce(lambda m, bound: m + (c("u") >= bound).cast("bigint"), poisson_steps(), F.lit(0).cast("bigint"))
    weighted = (family.withColumn("rep", F.explode(every)).withColumn("u", drawn).withColumn("m", weight))
    sums = weighted.groupBy("rep").agg(*[F.sum(c("m") * c(x)).alias(x) for x in ("acc", "acc_ok", "rec", "rec_ok")], F.count("*").alias("families"))
    ratio = sums.select("families", F.try_divide(c("acc_ok"), c("acc")).alias("p"), F.try_divide(c("rec_ok"), c("rec")).alias("r"))
    q = lambda col, at: F.when(F.max("families") >= 2, F.percentile(col, F.lit(at)))
    return ratio.agg(F.coalesce(F.max("families"), F.lit(0)).cast("bigint").alias("families"), q("p", 0.025).alias("precision_lower"),
                     q("p", 0.975).alias("precision_upper"), q("r", 0.025).alias("recall_lower"), q("r", 0.975).alias("recall_upper"))
