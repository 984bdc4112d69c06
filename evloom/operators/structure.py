"""Rollups over documents, families, batches and whole datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import text
from evloom.operators.primitives import group_ordinals, null_safe
from evloom.session import written


def family_members(measurements: DataFrame, experiments: DataFrame, documents: DataFrame) -> DataFrame:
    """(study_family, kind, member): the publications, documents and experiments of each family.

    A long table, so that a family with a third of all experiments is many rows and not one.
    """
    c = F.col
    e = experiments.select("study_family", F.explode(F.array(
        F.struct(F.lit("experiment").alias("kind"), c("experiment_id").alias("member")), F.struct(F.lit("doi").alias("kind"), c("doi").alias("member")))).alias("x")).select(
        "study_family", "x.*")
    cited = measurements.select("experiment_id", "document_hash").distinct().join(experiments.select("experiment_id", "study_family"), "experiment_id")
    d = cited.select("study_family", "document_hash").distinct()
    docs = d.select("study_family", F.lit("document").alias("kind"), c("document_hash").alias("member"))
    pubs = d.join(documents.select("document_hash", F.coalesce("publication_id", F.concat(F.lit("local-"), "document_hash")).alias("member")), "document_hash").select(
        "study_family", F.lit("publication").alias("kind"), "member")
    return e.unionByName(docs).unionByName(pubs).where("member is not null").distinct()


def coverage(units: DataFrame, measurements: DataFrame, done: DataFrame) -> DataFrame:
    """Per document: units, tables, figures, processed units and supported measurements."""
    c = F.col
    n = measurements.groupBy("document_hash", "page").agg(F.count("*").alias("supported"))
    j = units.join(n, ["document_hash", "page"], "left").join(done.withColumn("__done", F.lit(True)), ["document_hash", "page"], "left")
    return j.groupBy("document_hash").agg(
        F.count("*").alias("units"), F.sum("tables").alias("tables"), F.sum("figures").alias("figures"),
        F.count("__done").alias("processed"), F.sum(F.coalesce("supported", F.lit(0))).alias("measurements"),
        F.when(F.bool_and(c("__done").isNotNull()), "processed").otherwise("pending").alias("status"))


def excluded_coverage(units: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Every unit of an ineligible document, marked screened out with the document's reason."""
    return units.join(eligibility.where("not eligible").select("document_hash", "reason"), "document_hash").select(
        "document_hash", "page", "tables", "figures", F.lit("screened_ineligible").alias("text_status"), "reason")


def inventory_totals(units: DataFrame) -> DataFrame:
    """Structural totals per document and overall (document_hash null)."""
    return units.rollup("document_hash").agg(
        F.count("*").alias("pages"), F.sum((text.strip(F.col("text")) != "").cast("bigint")).alias("text_pages"),
        F.sum("tables").alias("table_candidates"), F.sum("figures").alias("figure_candidates"))


def region_links(regions: DataFrame, evidence: DataFrame, table_id: str = r"page-\d+-table-\d+") -> DataFrame:
    """Measurements linked to each table (named in a locator) or figure (equal id) of the same page.

    The ids that a locator names are taken out of it, so both sides meet on (document_hash, page,
    region_id) and no page is paired row by row. A locator names an id also where more digits follow it.
    """
    c = F.col
    long = F.explode(F.array_distinct(F.regexp_extract_all("locator", F.lit(table_id), 0))).alias("__id")
    digits = F.char_length(F.regexp_extract("__id", r"(\d+)$", 1))
    cut_off = F.explode(F.sequence(F.lit(0), digits - 1)).alias("__less")
    tables = (evidence.select("document_hash", "page", "measurement_id", long).select("*", cut_off)
              .select("document_hash", "page", "measurement_id", F.substr("__id", F.lit(1), F.char_length("__id") - c("__less")).alias("region_id"), F.lit("table").alias("kind")))
    figures = evidence.where("figure_id is not null").select("document_hash", "page", "measurement_id", c("figure_id").alias("region_id"), F.lit("figure").alias("kind"))
    named = tables.unionByName(figures).withColumnRenamed("kind", "__kind")
    own = regions.withColumn("__kind", F.when(c("kind") == "table", "table").otherwise("figure"))
    return own.join(named, ["document_hash", "page", "region_id", "__kind"], "left").groupBy("document_hash", "page", "region_id", "kind").agg(
        F.countDistinct("measurement_id").alias("supported_measurements"))


def merge_attributes(attributes: DataFrame) -> DataFrame:
    """One attribute per experiment and (name, text, value, unit, basis), first appearance first.

    Status rises to accepted unless the first one was rejected. Evidence stays in its own table.
    """
    c = F.col
    key = ["experiment_id", "name", "text", "value", "unit", "basis"]
    g = attributes.groupBy(*key).agg(F.min("pos").alias("pos"), F.min_by("status", "pos").alias("first_status"),
                                     F.max((c("status") == "accepted").cast("int")).alias("any"))
    return g.select(*key, "pos", F.when((c("any") == 1) & (c("first_status") != "rejected"), "accepted").otherwise(c("first_status")).alias("status"))


def merge_measurements(measurements: DataFrame, identity: list[str]) -> DataFrame:
    """First appearance of each measurement by its stable content id."""
    c = F.col
    keyed = measurements.withColumn("measurement_key", text.fingerprint(*[c(x) for x in identity]))
    row = F.struct("pos", *[x for x in measurements.columns if x != "pos"])
    return keyed.groupBy("measurement_key").agg(F.min_by(row, "pos").alias("m")).select("measurement_key", "m.*")


def first_seen(notes: DataFrame) -> DataFrame:
    """Distinct notes in first-seen order (sorted only by the consumer)."""
    return notes.groupBy("note").agg(F.min("pos").alias("pos"))


def dataset_fingerprint(rows: DataFrame, exclude: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """One SHA-256 over a table's content, independent of row order and partitions.

    Row hashes are summed per bucket in 32-bit pieces, so a bucket is two numbers per piece and not a
    list of its rows; the root hashes the fixed set of buckets.
    """
    c = F.col
    cols = sorted(x for x in rows.columns if x not in (exclude or []))
    digest = rows.select(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h"))
    # a 64-bit sum of 32-bit pieces holds two thousand million rows of a bucket
    pieces = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    bucket = digest.withColumn("b", F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(buckets)))
    sums = bucket.groupBy("b").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)])
    line = F.sha2(F.concat_ws("|", c("b").cast("string"), c("n").cast("string"), *[c(f"s{i}").cast("string") for i in range(8)]), 256)
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def bundle_signature(assets: DataFrame) -> DataFrame:
    """Signature of a document's primary hash, asset hashes and access metadata.

    ``assets``: document_hash, path, sha256, access. A document's assets are bounded by its files.
    """
    packed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return assets.groupBy("document_hash").agg(F.sha2(F.concat_ws("#", F.first("document_hash"), F.to_json(packed), F.max("access")), 256).alias("signature"))


def changed_bundles(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracked bundles that are gone or whose signature differs."""
    c = F.col
    j = tracked.select("document_hash", c("signature").alias("before")).join(current, "document_hash", "left")
    return j.where(~c("before").eqNullSafe(c("signature"))).select(
        "document_hash", F.when(c("signature").isNull(), "source_unavailable").otherwise("source_changed").alias("change"))


def bounds_violations(rows: DataFrame, key: list[str], limit: int, label: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit).withColumn("violation", F.lit(label))


def contract_violations(measurements: DataFrame, experiments: DataFrame, numbers: list[str]) -> DataFrame:
    """(id, violation) of a snapshot that must not be published.

    Experiment ids of both tables meet in one aggregate, which tells repeated and missing ones; measurement ids are looked
    for among equal hashes. Whole ids travel again only for what is found, rarely any.
    """
    c = F.col
    ids = experiments.select("experiment_id", F.lit(1).alias("e")).unionByName(measurements.select("experiment_id", F.lit(0).alias("e")))
    odd = written(ids.groupBy("experiment_id").agg(F.sum("e").alias("n")).where("n <> 1"), "odd_experiments")
    hashed = measurements.withColumn("__h", F.xxhash64("measurement_id"))
    suspects = written(hashed.groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h"), "suspects")
    repeated = hashed.join(suspects, "__h", "left_semi").groupBy("measurement_id").agg(F.count("*").alias("n")).where("n > 1")
    orphans = measurements.join(odd.where("n = 0"), "experiment_id", "left_semi").unionByName(measurements.where("experiment_id is null"))
    found = lambda df, name, violation: df.select(c(name).cast("string").alias("id"), F.lit(violation).alias("violation"))
    wild: Column = F.lit(False)
    for x in numbers:
        wild = wild | (c(x).isNotNull() & ~text.finite(c(x)))
    return reduce(DataFrame.unionByName, [
        found(odd.where("n > 1"), "experiment_id", "experiment id repeats"),
        found(repeated, "measurement_id", "measurement id repeats"),
        found(orphans, "measurement_id", "parent experiment is missing"),
        found(measurements.where((c("qualifier") == "missing") & c("value").isNotNull()), "measurement_id", "missing observation has a value"),
        found(measurements.where(wild), "measurement_id", "number is not finite")])


def condition_records(experiments: DataFrame, attributes: DataFrame, unit: str = "document_hash", position: str = "position") -> DataFrame:
    """What tells apart experiments of a unit that state no condition: their ordinal, from 0, among all of the unit.

    Experiments with conditions are identified by these and get none. Adds ``condition_record``.
    """
    c = F.col
    stated = attributes.select("experiment_id").distinct().withColumn("__stated", F.lit(True))
    numbered = group_ordinals(experiments, [unit], [c(position).asc(), c("experiment_id").asc()], "__k")
    return (numbered.join(stated, "experiment_id", "left").withColumn("condition_record", F.when(c("__stated").isNull(), c("__k") - 1))
            .drop("__stated", "__k", "__k_at"))


def document_violations(documents: DataFrame) -> DataFrame:
    """(id, violation) of documents without a text id, filename, SHA-256 or status."""
    c = F.col
    needed = {"document_id": "document id is missing", "filename": "filename is missing", "sha256": "hash is missing", "status": "status is missing"}
    found = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c(x), F.lit(""))) == "", message) for x, message in needed.items()],
                                    F.when(~F.lower(c("sha256")).rlike("^[0-9a-f]{64}$"), "hash is not a SHA-256")))
    return documents.select(F.coalesce("document_id", F.lit("")).alias("id"), F.explode(found).alias("violation"))


def snapshot_violations(tables: dict[str, DataFrame], numbers: list[str]) -> DataFrame:
    """All that forbids publishing documents, experiments and measurements together."""
    c = F.col
    m = tables["measurements"]
    nameless = m.where(F.trim(F.coalesce(c("measurement_id").cast("string"), F.lit(""))) == "").select(F.lit("").alias("id"), F.lit("measurement id is missing").alias("violation"))
    return (contract_violations(m, tables["experiments"], numbers).unionByName(nameless).unionByName(document_violations(tables["documents"])))


def tied_by_label(rows: DataFrame, document: str = "document_hash", label: str = "sample_label") -> DataFrame:
    """Add ``experiment_key``, the same for all rows of a document whose stripped labels agree; null for a blank label."""
    stripped = text.strip(F.col(label))
    return rows.withColumn("experiment_key", F.when(stripped != "", text.fingerprint(F.col(document), stripped)))


def merge_conditions(attributes: DataFrame) -> DataFrame:
    """Attributes of tied experiments: equal ones once, the first value of a name kept, others marked as conflicts.

    ``attributes``: experiment_key, pos, name, text, value, unit, basis, status. Nothing is dropped: a
    differing value stays as its own row with ``conflict`` true. Rows without a key take no part.
    """
    c = F.col
    merged = merge_attributes(attributes.where("experiment_key is not null").withColumnRenamed("experiment_key", "experiment_id"))
    first = merged.groupBy("experiment_id", "name").agg(F.min("pos").alias("__first"))
    return (null_safe(merged, first, ["experiment_id", "name"]).withColumn("conflict", c("pos") > c("__first")).drop("__first")
            .withColumnRenamed("experiment_id", "experiment_key"))


def union_evidence(evidence: DataFrame, owner: list[str], payload: list[str]) -> DataFrame:
    """Every distinct piece of evidence of an owner once, at its first position.

    Pieces are compared by a digest of their whole content, nested values included, so that the union is one
    aggregate over rows and no list of an owner's evidence is ever built.
    """
    c = F.col
    keyed = evidence.withColumn("evidence_key", text.fingerprint(*[c(x) for x in payload], length=64))
    rest = F.struct("pos", *payload)
    return keyed.groupBy(*owner, "evidence_key").agg(F.min_by(rest, "pos").alias("e")).select(*owner, "evidence_key", "e.*")
