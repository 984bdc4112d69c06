"""Random-effects pooling of many analyses at once.

Every iteration advances all analyses with one aggregate, so an analysis with any number of effects
is summed by partial aggregation and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evloom.functions import stats
from evloom.session import cut, written


def _settle(state: DataFrame) -> tuple[DataFrame, float]:
    """Write one iteration's state (one row per analysis) and report the largest change in it."""
    seen = Observation()
    done = written(state.observe(seen, F.max("delta").alias("d")), "state")
    return done, seen.get["d"] or 0.0


def reml_tau2(effects: DataFrame, tolerance: float = 1e-5, max_rounds: int = 100) -> DataFrame:
    """(analysis_id, tau2, centre, settled): Fisher scoring for the between-study variance.

    ``effects``: analysis_id, yi, vi. A settled analysis is frozen while others go on; one that does
    not settle is marked and does not stop the others.
    """
    c = F.col
    state = effects.groupBy("analysis_id").agg(F.avg("yi").alias("centre"), F.greatest(
        F.lit(0.0), F.coalesce(F.var_samp("yi"), F.lit(0.0)) - F.avg("vi")).alias("tau2")).withColumn("delta", F.lit(float("inf")))
    state, change = _settle(state)
    for _ in range(max_rounds):
        if change <= tolerance:
            break
        moving = state.where(c("delta") > tolerance)
        w, y = 1 / (c("vi") + c("tau2")), c("yi") - c("centre")
        sums = effects.join(moving, "analysis_id").groupBy("analysis_id").agg(
            F.first("centre").alias("centre"), F.first("tau2").alias("tau2"), F.sum(w).alias("s1"), F.sum(w * w).alias("s2"),
            F.sum(w * w * w).alias("s3"), F.sum(w * y).alias("sy"), F.sum(w * w * y).alias("s2y"), F.sum(w * w * y * y).alias("s2yy"))
        mu = c("sy") / c("s1")
        score = c("s2yy") - 2 * mu * c("s2y") + mu * mu * c("s2") - (c("s1") - c("s2") / c("s1"))
        info = c("s2") - 2 * c("s3") / c("s1") + F.pow(c("s2") / c("s1"), 2)
        stepped = sums.withColumn("new", F.greatest(F.lit(0.0), c("tau2") + F.coalesce(F.try_divide(score, info), F.lit(0.0))))
        state, change = _settle(stepped.select(
            "analysis_id", "centre", c("new").alias("tau2"), F.abs(c("new") - c("tau2")).alias("delta")).unionByName(
                state.where(c("delta") <= tolerance)))
    return state.select("analysis_id", "tau2", "centre", (c("delta") <= tolerance).alias("settled"))


def reml(effects: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Estimate, safeguarded Knapp-Hartung standard error and heterogeneity of each analysis; nothing where REML did not settle."""
    c = F.col
    effects = cut(effects.select("analysis_id", "study_family", "yi", "vi"))  # read once per iteration
    tau = reml_tau2(effects, tolerance).where("settled").drop("settled")
    w, w0, y = 1 / (c("vi") + c("tau2")), 1 / c("vi"), c("yi") - c("centre")
    s = effects.join(tau, "analysis_id").groupBy("analysis_id").agg(
        F.first("tau2").alias("tau_squared"), F.first("centre").alias("centre"), F.count("*").alias("k"),
        F.countDistinct("study_family").alias("study_families"),
        F.sum(w).alias("s1"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"),
        F.sum(w0).alias("z1"), F.sum(w0 * w0).alias("z2"), F.sum(w0 * y).alias("zy"), F.sum(w0 * y * y).alias("zyy"))
    mu, mu0, df = c("sy") / c("s1"), c("zy") / c("z1"), c("k") - 1
    spread = (c("syy") - c("sy") * mu) / df
    typical = F.try_divide(df, c("z1") - c("z2") / c("z1"))
    return s.select(
        "analysis_id", "k", "study_families", (mu + c("centre")).alias("estimate"), "tau_squared",
        (F.sqrt(1 / c("s1")) * F.sqrt(F.greatest(F.lit(1.0), spread))).alias("se"),
        (100 * F.try_divide(c("tau_squared"), c("tau_squared") + typical)).alias("i_squared"),
        F.greatest(F.lit(0.0), c("zyy") - c("zy") * mu0).alias("q"))


def with_intervals(pooled: DataFrame, measure: str = "MD") -> DataFrame:
    """Confidence and prediction limits, p-values; response ratios for the log measure."""
    c = F.col
    df = c("k") - 1
    t = pooled.withColumn("__t", stats.t_critical(df))
    out = t.select(
        *pooled.columns, (c("estimate") - c("__t") * c("se")).alias("ci_lower"), (c("estimate") + c("__t") * c("se")).alias("ci_upper"),
        stats.t_p_value(c("estimate") / c("se"), df).alias("p_value"), stats.chi2_p_value(c("q"), df).alias("q_p_value"),
        (c("estimate") - c("__t") * F.sqrt(c("tau_squared") + c("se") * c("se"))).alias("prediction_lower"),
        (c("estimate") + c("__t") * F.sqrt(c("tau_squared") + c("se") * c("se"))).alias("prediction_upper"))
    if measure == "ROM":
        for name, source in (("response_ratio", "estimate"), ("response_ratio_lower", "ci_lower"), ("response_ratio_upper", "ci_upper")):
            out = out.withColumn(name, F.exp(c(source)))
    return out


# ---- dependent effects: sampling covariance within families, cluster-robust inference --------------------


def covariance_violations(effects: DataFrame, covariance: DataFrame) -> DataFrame:
    """(analysis_id, reason) rows of a long covariance table that cannot be used as it stands.

    ``covariance``: analysis_id, id_i, id_j, cov; ``effects``: analysis_id, contrast_id, study_family, vi.
    Positive definiteness is decided per family in :func:`family_spectra`.
    """
    c = F.col
    e = effects.select("analysis_id", "contrast_id", "study_family", "vi")
    tol = lambda a, b, rel: F.abs(a - b) <= 1e-12 + rel * F.abs(b)
    infinite = c("cov").isNull() | F.isnan("cov") | (F.abs("cov") == float("inf"))
    diagonal = F.coalesce(c("id_i") == c("id_j"), F.lit(False))
    # the variance entry of an effect is its own mirror: one sum by effect settles it, where neither is repeated
    rows = e.select("analysis_id", "contrast_id", F.lit(1).alias("effect"), F.lit(0).alias("entry"), c("study_family").isNotNull().alias("known"), "vi",
                    F.lit(None).cast("double").alias("cov")).unionByName(
        covariance.where(diagonal).select("analysis_id", c("id_i").alias("contrast_id"), F.lit(0).alias("effect"), F.lit(1).alias("entry"),
                                          F.lit(False).alias("known"), F.lit(None).cast("double").alias("vi"), "cov"))
    own = rows.groupBy("analysis_id", "contrast_id").agg(F.sum("effect").alias("effects"), F.sum("entry").alias("entries"), F.max("known").alias("known"),
                                                         F.max("vi").alias("vi"), F.max("cov").alias("cov"))
    nowhere, repeated = c("analysis_id").isNull(), ((c("entries") > 1) & (c("effects") > 0)) | ((c("effects") > 1) & (c("entries") > 0))
    entry = (F.when(nowhere | (c("effects") == 0) | ~c("known") & ~repeated, "entry names no retained effect")
             .when(~repeated & infinite, "entry is not finite")
             .when(~repeated & ~tol(c("cov"), c("vi"), 1e-6), "diagonal differs from the sampling variance"))
    missing = F.when((c("effects") > 0) & (nowhere | (c("entries") == 0)), "an effect has no variance entry")
    settled = own.select("analysis_id", F.when(repeated, c("contrast_id")).alias("again"),
                         F.explode(F.array(F.when(c("entries") > 0, entry), missing)).alias("reason")).where("again is not null or reason is not null")
    settled = written(settled.distinct(), "variances")
    again = covariance.where(diagonal).join(settled.select("analysis_id", c("again").alias("id_i")).distinct(), ["analysis_id", "id_i"], "left_semi")
    left = covariance.where(~diagonal).unionByName(again.select(*covariance.columns))
    one = e.withColumnsRenamed({"contrast_id": "id_i", "study_family": "fi", "vi": "vi_i"})
    two = e.select("analysis_id", c("contrast_id").alias("id_j"), c("study_family").alias("fj"))
    placed = left.join(one, ["analysis_id", "id_i"], "left").join(two, ["analysis_id", "id_j"], "left")
    mirror = left.select("analysis_id", c("id_j").alias("id_i"), c("id_i").alias("id_j"), c("cov").alias("mirror"))
    pair = placed.join(mirror, ["analysis_id", "id_i", "id_j"], "left")
    reason = (F.when(c("fi").isNull() | c("fj").isNull(), "entry names no retained effect")
              .when(infinite, "entry is not finite")
              .when(c("mirror").isNull() | ~tol(c("cov"), c("mirror"), 1e-8), "not symmetric")
              .when((c("id_i") == c("id_j")) & ~tol(c("cov"), c("vi_i"), 1e-6), "diagonal differs from the sampling variance")
              .when((c("fi") != c("fj")) & (F.abs("cov") > 1e-12), "covariance between families"))
    bad = pair.select("analysis_id", reason.alias("reason")).unionByName(settled.select("analysis_id", "reason"))
    return bad.where("reason is not null").distinct()


def _family_matrices(effects: DataFrame, covariance: DataFrame) -> DataFrame:
    """One row per family: its effects and the within-family covariance entries as short arrays.

    A family's covariance is dense, so a family is the unit that must fit one task; analyses are not.
    """
    c = F.col
    y = effects.groupBy("analysis_id", "study_family").agg(F.array_sort(F.collect_list(F.struct(c("contrast_id").alias("i"), c("yi").alias("v")))).alias("y"))
    owner = effects.select("analysis_id", "study_family", c("contrast_id").alias("id_i"))
    other = effects.select("analysis_id", c("study_family").alias("__f"), c("contrast_id").alias("id_j"))
    v = (covariance.join(owner, ["analysis_id", "id_i"]).join(other, ["analysis_id", "id_j"]).where("study_family = __f")
         .groupBy("analysis_id", "study_family").agg(F.collect_list(F.struct(c("id_i").alias("i"), c("id_j").alias("j"), c("cov").alias("v"))).alias("cov")))
    return y.join(v, ["analysis_id", "study_family"])


def _matrices(y, cov) -> tuple[np.ndarray, np.ndarray]:
    at = {e["i"]: n for n, e in enumerate(y)}
    m = np.zeros((len(at), len(at)))
    for e in cov:
        m[at[e["i"]], at[e["j"]]] = e["v"]
    return np.array([e["v"] for e in y], dtype=float), (m + m.T) / 2


def _by_size(ys, covs) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Families of one batch by their number of effects: positions, effects (families x m) and covariances (families x m x m)."""
    sizes: dict[int, list[int]] = {}
    for n, y in enumerate(ys):
        sizes.setdefault(len(y), []).append(n)
    for at in sizes.values():
        found = [_matrices(ys.iloc[n], covs.iloc[n]) for n in at]
        yield at, np.stack([y for y, _ in found]), np.stack([v for _, v in found])


def family_spectra(families: DataFrame) -> DataFrame:
    """Eigenvalues of each family's covariance with the projections of 1 and of y.

    The dense work happens once, for all families of a size in a batch together; all later iterations are sums over
    these rows. Families of one effect need no matrix and stay out of Python.
    (analysis_id, study_family, lam, a, b, alone).
    """
    schema = "analysis_id string, study_family string, lam double, a double, b double"

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, y, v in _by_size(batch["y"], batch["cov"]):
                lam, q = np.linalg.eigh(v)
                named = {x: np.repeat(batch[x].to_numpy()[at], y.shape[1]) for x in ("analysis_id", "study_family")}
                yield pd.DataFrame(named | {"lam": lam.ravel(), "a": q.sum(axis=1).ravel(), "b": np.einsum("fij,fi->fj", q, y).ravel()})

    one = families.where(F.size("y") == 1).select(
        "analysis_id", "study_family", F.col("cov")[0]["v"].alias("lam"), F.lit(1.0).alias("a"), F.col("y")[0]["v"].alias("b"), F.lit(True).alias("alone"))
    return one.unionByName(families.where(F.size("y") > 1).mapInPandas(spectra, schema).withColumn("alone", F.lit(False)))


def not_positive_definite(spectra: DataFrame) -> DataFrame:
    """Families whose covariance has an eigenvalue at or below zero."""
    return spectra.groupBy("analysis_id", "study_family").agg(F.min("lam").alias("smallest")).where("smallest <= 0")


def _checked(effects: DataFrame, covariance: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refused analyses as in :func:`refused_covariance`, and families and spectra of the others; families meet their covariance once."""
    named = written(covariance_violations(effects, covariance), "violations")
    families = written(_family_matrices(effects.join(named, "analysis_id", "left_anti"), covariance), "families")
    spectra = written(family_spectra(families), "spectra")
    singular = not_positive_definite(spectra).select("analysis_id", F.lit("covariance is not positive definite").alias("reason"))
    refused = written(named.unionByName(singular).groupBy("analysis_id").agg(F.min("reason").alias("reason")), "refused")
    return refused, families.join(refused, "analysis_id", "left_anti"), spectra.join(refused, "analysis_id", "left_anti")


def refused_covariance(effects: DataFrame, covariance: DataFrame) -> DataFrame:
    """(analysis_id, reason) of analyses whose covariance is incomplete, inconsistent or not positive definite."""
    return _checked(effects, covariance)[0]


def _family_sums(alone: DataFrame, spectra: DataFrame, state: DataFrame) -> DataFrame:
    """Per-family scalars of the marginal precision matrix at the current variances.

    ``alone`` (analysis_id, lam, b) holds the families of one effect, whose sums are their only row; ``spectra`` the others.
    """
    c = F.col
    w = 1 / (c("lam") + c("s2"))
    many = spectra.join(state, "analysis_id").groupBy("analysis_id", "study_family").agg(
        F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"),
        F.sum(c("a") * c("a") * w).alias("aw"), F.sum(c("a") * c("b") * w).alias("bw"),
        F.sum(c("a") * c("a") * w * w).alias("aw2"), F.sum(c("a") * c("a") * w * w * w).alias("aw3"),
        F.sum(c("a") * c("b") * w * w).alias("abw2"), F.sum(c("b") * c("b") * w * w).alias("bw2")).drop("study_family")
    one = alone.join(state, "analysis_id").select(
        "analysis_id", "s1", "s2", w.alias("w1"), (w * w).alias("w2"), w.alias("aw"), (c("b") * w).alias("bw"), (w * w).alias("aw2"),
        (w * w * w).alias("aw3"), (c("b") * w * w).alias("abw2"), (c("b") * c("b") * w * w).alias("bw2"))
    per = many.unionByName(one)
    g = 1 + c("s1") * c("aw")
    k = c("s1") / g
    return per.select(
        "analysis_id", "s1", "s2", (c("aw") / g).alias("p"), (c("bw") / g).alias("r"), (c("aw2") / (g * g)).alias("q"),
        (c("aw3") / (g * g) - k * F.pow(c("aw2") / g, 2)).alias("m3"),
        (c("w2") - 2 * k * c("aw3") + k * k * c("aw2") * c("aw2")).alias("t22"), (c("w1") - k * c("aw2")).alias("t2"),
        # the residual quadratic form of the second variance as a polynomial in the mean
        (c("bw2") - 2 * k * c("bw") * c("abw2") + k * k * c("bw") * c("bw") * c("aw2")).alias("z0"),
        (-2 * c("abw2") + 2 * k * (c("bw") * c("aw2") + c("aw") * c("abw2")) - 2 * k * k * c("aw") * c("bw") * c("aw2")).alias("z1"),
        (c("aw2") - 2 * k * c("aw") * c("aw2") + k * k * c("aw") * c("aw") * c("aw2")).alias("z2"))


def cluster_variances(spectra: DataFrame, tolerance: float = 1e-7, max_rounds: int = 200) -> DataFrame:
    """(analysis_id, s1, s2, mu, total): REML variances between families and between effects.

    Projected Fisher scoring, all analyses at once; a variance at zero whose score is negative stays
    there. An analysis that does not settle gives no row. The spectra of larger families are laid out by family once, so an iteration shuffles only sums per analysis.
    """
    c = F.col
    alone = written(spectra.where("alone").select("analysis_id", "lam", "b"), "alone")
    larger = cut(spectra.where("not alone").drop("alone").repartition("analysis_id", "study_family"))
    start = spectra.groupBy("analysis_id").agg((F.avg("lam") / 4).alias("s1")).select(
        "analysis_id", "s1", c("s1").alias("s2"), F.lit(float("inf")).alias("delta"))
    state, change = _settle(start)
    for _ in range(max_rounds):
        if change <= tolerance:
            break
        moving = state.where(c("delta") > tolerance)
        agg = _family_sums(alone, larger, moving).groupBy("analysis_id").agg(
            F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.sum("p").alias("n1"), F.sum("r").alias("pull"),
            F.sum(c("p") * c("p")).alias("p2"), F.sum("q").alias("q1"), F.sum("m3").alias("m3"), F.sum("t22").alias("t22"), F.sum("t2").alias("trw"),
            F.sum(F.pow(c("p"), 3)).alias("p3"), F.sum(c("p") * c("q")).alias("pq"),
            F.sum(c("r") * c("r")).alias("rr"), F.sum(c("r") * c("p")).alias("rp"),
            F.sum("z0").alias("z0"), F.sum("z1").alias("z1"), F.sum("z2").alias("z2"))
        n, mu = c("n1"), c("pull") / c("n1")
        u1 = c("rr") - 2 * mu * c("rp") + mu * mu * c("p2") - (n - c("p2") / n)
        u2 = c("z0") + mu * c("z1") + mu * mu * c("z2") - (c("trw") - c("q1") / n)
        i11 = c("p2") - 2 * c("p3") / n + F.pow(c("p2") / n, 2)
        i12 = c("q1") - 2 * c("pq") / n + c("p2") * c("q1") / (n * n)
        i22 = c("t22") - 2 * c("m3") / n + F.pow(c("q1") / n, 2)
        a = agg.select("analysis_id", "s1", "s2", u1.alias("u1"), u2.alias("u2"), i11.alias("i11"), i12.alias("i12"), i22.alias("i22"))
        det = c("i11") * c("i22") - c("i12") * c("i12")
        hold1, hold2 = (c("s1") <= 0) & (c("u1") <= 0), (c("s2") <= 0) & (c("u2") <= 0)
        both1 = F.try_divide(c("i22") * c("u1") - c("i12") * c("u2"), det)
        both2 = F.try_divide(c("i11") * c("u2") - c("i12") * c("u1"), det)
        solo1, solo2 = F.try_divide(c("u1"), c("i11")), F.try_divide(c("u2"), c("i22"))
        d1 = F.when(hold1, 0.0).when(hold2 | (det <= 0), solo1).otherwise(both1)
        d2 = F.when(hold2, 0.0).when(hold1 | (det <= 0), solo2).otherwise(both2)
        a = a.withColumn("d1", F.coalesce(d1, F.lit(0.0))).withColumn("d2", F.coalesce(d2, F.lit(0.0)))
        n1, n2 = F.greatest(F.lit(0.0), c("s1") + c("d1")), F.greatest(F.lit(0.0), c("s2") + c("d2"))
        state, change = _settle(a.select("analysis_id", n1.alias("s1"), n2.alias("s2"), F.greatest(
            F.abs(n1 - c("s1")), F.abs(n2 - c("s2"))).alias("delta")).unionByName(state.where(c("delta") <= tolerance)))
    fam = _family_sums(alone, larger, state.where(c("delta") <= tolerance))
    return fam.groupBy("analysis_id").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"),
                                          (F.sum("r") / F.sum("p")).alias("mu"), F.sum("p").alias("total"))


def cluster_robust(effects: DataFrame, covariance: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Multilevel REML estimate with CR2 standard error and Satterthwaite degrees of freedom.

    An analysis whose covariance cannot be used gets a row with status ``ineligible`` and the first
    reason as ``limitation``; no family is left out silently. Families are the clusters. The bias-reduction matrix of a family depends on that family and one
    scalar of the analysis, so each family contributes a handful of numbers that are summed.
    """
    checked, families, spectra = _checked(effects, covariance)
    sound = effects.join(checked, "analysis_id", "left_anti")
    fitted = written(cluster_variances(spectra, tolerance), "fitted")
    rows = families.join(fitted, "analysis_id").select("analysis_id", "y", "cov", "s1", "s2", "mu", "total")
    schema = "analysis_id string, score double, own double, h double, n long"

    def adjust(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, y, v in _by_size(batch["y"], batch["cov"]):
                s1, s2, mu, total = (batch[x].to_numpy()[at][:, None, None] for x in ("s1", "s2", "mu", "total"))
                m = y.shape[1]
                theta = v + s1 + s2 * np.eye(m)
                lower = np.linalg.cholesky(theta)
                upper = lower.transpose(0, 2, 1)
                lam, q = np.linalg.eigh(upper @ (theta - 1 / total) @ lower)
                least = 1e-12 * np.maximum(lam.max(axis=1, keepdims=True), 1e-300)
                root = np.where(lam > least, 1 / np.sqrt(np.maximum(lam, 1e-300)), 0.0)
                g = (lower @ ((q * root[:, None, :]) @ q.transpose(0, 2, 1)) @ upper @ np.linalg.solve(theta, np.ones((len(at), m, 1))))[..., 0] / total[..., 0]
                own = np.einsum("fi,fij,fj->f", g, theta, g) - g.sum(axis=1) ** 2 / total[:, 0, 0]
                yield pd.DataFrame({"analysis_id": batch["analysis_id"].to_numpy()[at], "score": (g * (y - mu[..., 0])).sum(axis=1), "own": own, "h": g.sum(axis=1), "n": m})

    c = F.col
    # the same for a family of one effect, without matrices
    theta = c("cov")[0]["v"] + c("s1") + c("s2")
    lam = theta * (theta - 1 / c("total"))
    g = F.when(lam > 0, 1 / (F.sqrt(lam) * c("total"))).otherwise(0.0)
    single = rows.where(F.size("y") == 1).withColumn("h", g).select(
        "analysis_id", (c("h") * (c("y")[0]["v"] - c("mu"))).alias("score"), (c("h") * c("h") * (theta - 1 / c("total"))).alias("own"), "h", F.lit(1).cast("bigint").alias("n"))
    parts = single.unionByName(rows.where(F.size("y") > 1).mapInPandas(adjust, schema))
    s = parts.groupBy("analysis_id").agg(
        F.sum(c("score") * c("score")).alias("var"), F.sum("own").alias("own"), F.sum(c("own") * c("own")).alias("own2"),
        F.sum(c("h") * c("h")).alias("h2"), F.sum(F.pow(c("h"), 4)).alias("h4"), F.sum("n").alias("k"), F.count("*").alias("study_families"))
    out = s.join(fitted, "analysis_id")
    df = c("own") * c("own") / (c("own2") + (c("h2") * c("h2") - c("h4")) / (c("total") * c("total")))
    out = out.select("analysis_id", "k", "study_families", c("mu").alias("estimate"), F.sqrt("var").alias("se"), df.alias("robust_df"),
                     c("s1").alias("family_variance"), c("s2").alias("effect_variance"))
    usable = c("robust_df") >= 4 - 1e-9  # sums of equal families fall short of a whole number by rounding
    t = stats.t_critical(c("robust_df"))
    done = out.withColumn("__t", t).select(
        *out.columns, F.when(usable, c("estimate") - c("__t") * c("se")).alias("ci_lower"),
        F.when(usable, c("estimate") + c("__t") * c("se")).alias("ci_upper"),
        F.when(usable, stats.t_p_value(c("estimate") / c("se"), c("robust_df"))).alias("p_value"),
        F.when(usable, "completed").otherwise("inference_unavailable").alias("status"),
        F.when(~usable, "robust degrees of freedom are below 4").alias("limitation"))
    unsettled = (sound.select("analysis_id").distinct().join(fitted, "analysis_id", "left_anti")
                 .select("analysis_id", F.lit("engine_failed").alias("status"), F.lit("variance components did not settle").alias("limitation")))
    refused = checked.select("analysis_id", F.lit("ineligible").alias("status"), c("reason").alias("limitation"))
    return done.unionByName(refused.unionByName(unsettled), allowMissingColumns=True)
