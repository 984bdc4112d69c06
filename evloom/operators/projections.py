"""Row-level views: exports, searches, decisions and state, one select each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import text
from evloom.functions.status import WORKFLOW_BLOCKED

CSV_COLUMNS = ["doi", "sample_label", "study_family", "measurement_id", "outcome", "raw_value", "value", "unit", "qualifier",
               "normalized_value", "normalized_unit", "measurement_method", "statistic", "time_value", "time_unit", "concentration_basis",
               "uncertainty_type", "uncertainty", "ci_lower", "ci_upper", "n_independent", "n_technical", "origin", "status", "evidence"]
SUMMARY_COLUMNS = ["doi", "sample_label", "outcome", "raw_value", "unit", "qualifier", "status"]
# Licences whose text may be kept.
LICENSE = r"^(?:CC[- ]?BY(?:[- ](?:NC|ND|SA)){0,3}|CC0|TDM|PD|PUBLIC[- ]DOMAIN)(?:[- ]?\d+(?:\.\d+)?)?\z"


def measurement_rows(measurements: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Flat rows: attribute texts as columns (the last of a repeated name wins), measurement fields first.

    ``attributes``: experiment_id, pos, name, text. A name that is also a measurement field loses.
    """
    wanted = [n for n in names if n not in measurements.columns]
    c = F.col
    wide = attributes.where(c("name").isin(*wanted)).groupBy("experiment_id").agg(
        *[F.max_by("text", F.when(c("name") == n, c("pos"))).alias(n) for n in wanted])
    out = measurements.join(wide, "experiment_id", "left")
    if "validation_notes" in measurements.columns:
        out = out.withColumn("validation_notes", F.array_join("validation_notes", "; "))
    return out


def fixed_csv(rows: DataFrame) -> DataFrame:
    types = dict(rows.dtypes)
    has = lambda x: text.spreadsheet_safe(F.col(x)) if types[x] == "string" else F.col(x).cast("string")
    return rows.select(*[F.coalesce(has(x) if x in types else F.lit(None).cast("string"), F.lit("")).alias(x) for x in CSV_COLUMNS])


def summary_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in SUMMARY_COLUMNS])


def current_state(measurements: DataFrame, experiments: DataFrame, documents: DataFrame) -> DataFrame:
    """Measurements as the service shows them: stale when source or document is not usable."""
    c = F.col
    facts = experiments.select("experiment_id", "source_status", "document_hash").join(
        documents.select("document_hash", c("status").alias("__doc")), "document_hash", "left").drop("document_hash")
    blocked = (c("source_status") != "active") | F.coalesce(c("__doc").isin("quarantined", "stale"), F.lit(False))
    note = F.concat(F.lit("source status "), c("source_status"), F.lit(": excluded until reassessed"))
    j = measurements.join(facts, "experiment_id")
    return j.withColumn("note", F.when(blocked, note)).withColumn("status", F.when(blocked, "stale").otherwise(c("status"))).drop("__doc")


def conditions(measurements: DataFrame) -> DataFrame:
    """(condition_id, experiment_id, measurement_id), one row per member."""
    return measurements.select(F.concat("experiment_id", F.lit(":condition")).alias("condition_id"), "experiment_id", "measurement_id")


def search_evidence(rows: DataFrame, query: str, status: str = "all", outcome: str = "all", origin: str = "all") -> DataFrame:
    c = F.col
    hay = text.search_text(*[c(x) for x in ("outcome", "raw_value", "unit", "measurement_method", "sample_label", "doi")], arrays=[c("excerpts")])
    out = rows.where(F.contains(hay, F.lit(query.lower())))
    for name, value in (("status", status), ("outcome", outcome), ("origin", origin)):
        if value != "all":
            out = out.where(c(name) == value)
    return out


def search_publications(publications: DataFrame, query: str, pending_only: bool = True) -> DataFrame:
    c = F.col
    hay = text.search_text(c("title"), c("doi"), c("source"), arrays=[c("authors")] if "authors" in publications.columns else None)
    out = publications.where(F.contains(hay, F.lit(query.lower())))
    return out.where("state = 'pending_extraction'") if pending_only else out


def sort_evidence(rows: DataFrame, by: str, reverse: bool = False) -> list[Column]:
    """Sort key of the evidence table: nulls last, and first when reversed."""
    return [F.col(by).desc_nulls_first() if reverse else F.col(by).asc_nulls_last(), F.col("measurement_id").asc()]


def page(rows: DataFrame, number: int, order: list[Column], size: int = 30) -> DataFrame:
    """One page of a sorted table; a number past the end shows the last page."""
    last = max(0, -(-rows.count() // size) - 1)
    return rows.orderBy(*order).offset(min(max(number, 0), last) * size).limit(size)


def page_after(rows: DataFrame, by: str, last: tuple | None, size: int = 30) -> DataFrame:
    """The next page in ascending order of (``by``, measurement_id), nulls last, after the last row seen.

    ``last`` is (value, measurement_id) of that row. Nothing is counted or skipped over, so a late page
    costs what the first one costs.
    """
    c = F.col
    if last is not None:
        value, ident = last
        same = c(by).eqNullSafe(F.lit(value)) & (c("measurement_id") > ident)
        later = c(by).isNull() | (c(by) > value) if value is not None else F.lit(False)
        rows = rows.where(same | (later & ~c(by).eqNullSafe(F.lit(value))))
    return rows.orderBy(*sort_evidence(rows, by)).limit(size)


def extractable(documents: DataFrame, requested: DataFrame) -> DataFrame:
    return documents.join(requested, "document_hash", "left_semi").where(~F.col("status").isin("quarantined", "extracted", "excluded"))


def apply_reviews(measurements: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human decisions over current measurements, each with the reason it was refused.

    ``reviews``: measurement_id, decision. Acceptance needs evidence and an experimental observation, and an active source.
    """
    c = F.col
    j = measurements.join(reviews, "measurement_id", "left")
    refused = (F.when(c("decision").isNull(), F.lit(None).cast("string"))
               .when((c("source_status") != "active") | c("document_status").isin("quarantined", "stale"), "source needs reassessment")
               .when((c("decision") == "accepted") & ((c("evidence_count") == 0) | (c("origin") == "curve_sample")), "acceptance needs evidence"))
    j = j.withColumn("refused", refused)
    return j.withColumn("status", F.when(c("decision").isNotNull() & c("refused").isNull(), c("decision")).otherwise(c("status")))


def choose_version(locations: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Version of each publication to read: the requested, the published, or the only one.

    ``locations``: publication_id, version. Without a unique choice the row asks for a selection.
    """
    c = F.col
    per = locations.groupBy("publication_id").agg(F.countDistinct(F.coalesce("version", F.lit(""))).alias("n"), F.min("version").alias("only"),
                                                  F.max(F.coalesce(c("version") == "publishedVersion", F.lit(False))).alias("published"))
    if requested is None:
        wanted = per.withColumn("requested", F.lit(None).cast("string"))
    else:
        wanted = per.join(requested, "publication_id", "left")
    pick = F.when(c("requested").isNotNull(), c("requested")).when(c("published"), "publishedVersion").when(c("n") == 1, c("only"))
    state = F.when(c("requested").isNotNull() | c("published") | (c("n") == 1), "chosen").otherwise("selection required")
    return wanted.select("publication_id", pick.alias("version"), state.alias("state"))


def choose_distributed(versions: DataFrame, previous: DataFrame) -> DataFrame:
    """Distributed version of each record: the earlier one while it is listed, else the only non-manuscript.

    ``versions``: pmcid, version, manuscript. ``previous``: pmcid, previous.
    """
    c = F.col
    per = versions.groupBy("pmcid").agg(
        F.count("*").alias("n"), F.sum((~c("manuscript")).cast("int")).alias("published"), F.min("version").alias("only"),
        F.min(F.when(~c("manuscript"), c("version"))).alias("only_published"))
    listed = versions.join(previous, (versions["pmcid"] == previous["pmcid"]) & (c("version") == c("previous")), "left_semi").select("pmcid", F.lit(True).alias("listed"))
    j = per.join(previous, "pmcid", "left").join(listed.distinct(), "pmcid", "left")
    pick = (F.when(c("listed"), c("previous")).when(c("previous").isNotNull(), F.lit(None)).when(c("published") == 1, c("only_published"))
            .when((c("published") == 0) & (c("n") == 1), c("only")))
    j = j.withColumn("chosen", pick)
    state = F.when(c("chosen").isNotNull(), "chosen").when(c("previous").isNotNull(), "source_unavailable").otherwise("version_selection_required")
    return j.select("pmcid", c("chosen").alias("version"), state.alias("state"))


def license_ok(code: Column) -> Column:
    return F.coalesce(F.upper(code).rlike(LICENSE), F.lit(False))


def kept_kinds(locations: DataFrame) -> DataFrame:
    """Licensed files; a text-mining licence keeps only XML and plain text."""
    tdm = F.upper("license") == "TDM"
    return locations.where(license_ok(F.col("license")) & (~tdm | F.col("kind").isin("xml", "text")))


def access_route(publications: DataFrame, conversions: DataFrame) -> DataFrame:
    """How a publication's full text may be reached, and the PMCID found on the way."""
    c = F.col
    own = F.when(c("pmcid") != "", c("pmcid"))
    tail = F.element_at(F.split("source_id", ":"), -1)
    from_id = F.when(F.startswith("source_id", F.lit("PMC")), F.when(tail.rlike(r"^\d+$"), F.concat(F.lit("PMC"), tail)).otherwise(tail))
    j = publications.join(conversions.select(c("requested_id").alias("lookup"), c("pmcid").alias("__converted")), "lookup", "left")
    found = F.coalesce(own, from_id, c("__converted"))
    active = c("status") == "active"
    route = (F.when(~active, "needs review").when(found.isNotNull(), "pmc").when(c("doi").isNotNull(), "doi").otherwise("no identifier"))
    return j.withColumn("route", route).withColumn("pmcid", F.when(active, found)).drop("__converted")


def screened_doi(screening: DataFrame, documents: DataFrame) -> DataFrame:
    """A proposed DOI stands only if the source prints it; else the document's own DOI is kept.

    ``screening``: document_hash, proposed_doi. ``documents``: document_hash, text, doi.
    """
    c = F.col
    body = text.canonical_text(c("text"))
    j = screening.join(documents.select("document_hash", "doi", body.alias("__body")), "document_hash")
    printed = (c("proposed_doi") == c("doi")) | F.contains("__body", text.canonical_text(c("proposed_doi")))
    kept = F.when(F.coalesce(printed, F.lit(False)), c("proposed_doi"))
    return j.select("document_hash", F.coalesce(kept, c("doi")).alias("doi"), (c("proposed_doi").isNotNull() & kept.isNull()).alias("withheld"))


def local_publications(documents: DataFrame, blocked: list[str] = WORKFLOW_BLOCKED) -> DataFrame:
    """Publications for documents that name none."""
    c = F.col
    state = F.when(c("status") == "completed", "extracted").when(c("status") == "screened_excluded", "screened_excluded").otherwise("needs_review")
    return documents.where("publication_id is null").select(
        F.concat(F.lit("local-"), "document_hash").alias("publication_id"), F.lit("local").alias("source"), c("document_hash").alias("source_id"),
        "doi", state.alias("state"), F.when(c("status").isin(*blocked), c("status")).otherwise("active").alias("status"))


def usage_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Whole micro-dollars per call, rounded up. ``prices``: model, input_price, output_price per million tokens.

    A cost is never guessed: a call of an unpriced model or with a negative count keeps a ``reason`` and no cost.
    """
    c = F.col
    reason = F.when(c("input_price").isNull() | c("output_price").isNull(), "unknown model price").when(
        (c("input_tokens") < 0) | (c("output_tokens") < 0), "negative token count")
    cost = c("input_price").cast("decimal(12,6)") * c("input_tokens").cast("decimal(18,0)") + c("output_price").cast("decimal(12,6)") * c("output_tokens").cast("decimal(18,0)")
    priced = calls.join(prices, "model", "left").withColumn("reason", reason)
    return priced.withColumn("microusd", F.when(c("reason").isNull(), F.ceil(cost).cast("bigint"))).drop("input_price", "output_price")


def run_status(jobs: DataFrame) -> DataFrame:
    """Per document: whether all jobs ended, whether some gave up, and the last completion. ``jobs``: document_hash, status, completed_on."""
    c = F.col
    ended, gave_up = c("status").isin("completed", "abstained", "failed"), c("status").isin("abstained", "failed")
    per = jobs.groupBy("document_hash").agg(F.bool_and(ended).alias("complete"), F.bool_or(gave_up).alias("limited"), F.max("completed_on").alias("last_extraction"))
    status = F.when(~c("complete"), "running").when(c("limited"), "completed_with_abstentions").otherwise("completed")
    return per.withColumn("run_status", status)


def newest_runs(jobs: DataFrame, size: int | None = None) -> DataFrame:
    ordered = jobs.orderBy(F.col("completed_on").desc_nulls_last(), "job_id")
    return ordered if size is None else ordered.limit(size)


def extraction_summary(measurements: DataFrame, documents: DataFrame) -> DataFrame:
    """Experiments and measurements per document, and how many may be used: accepted, from a completed document."""
    c = F.col
    state = documents.select("document_hash", (c("status") == "completed").alias("__live"))
    usable = c("__live") & (c("status") == "accepted")
    return measurements.join(state, "document_hash", "left").groupBy("document_hash").agg(
        F.countDistinct("experiment_id").alias("experiments"), F.count("*").alias("measurements"), F.count_if(F.coalesce(usable, F.lit(False))).alias("eligible"))


def micro_dollars(amount: Column) -> Column:
    return F.ceil(amount.cast("decimal(24,9)") * F.lit(1000000)).cast("bigint")


def progress_percent(completed: Column, total: Column) -> Column:
    share = completed / F.when(total > 0, total) * 100
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))
