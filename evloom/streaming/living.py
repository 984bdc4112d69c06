"""Living maintenance with Structured Streaming: monotone status, idempotent upserts, cascades.

Sources are landed files. The only streaming state is a rank per DOI. All other rules keep a reduced log
per batch, written in ``foreachBatch`` and folded into a base of buckets (``store.MergeLog``): a replayed batch
rewrites its own folder, and a read touches the base and the few open batches.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.functions import status as st
from evloom.functions.dates import next_weekly_check
from evloom.functions.text import canonical_doi
from evloom.session import scratch_path
from evloom.streaming.store import MergeLog, RankedTable, cascade


def landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int = 0) -> DataFrame:
    """Stream of landed files. A changed query gets a new checkpoint, and so starts again."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def _drain(writer, checkpoint: str) -> None:
    handle = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    handle.awaitTermination()


def status_updates(stream: DataFrame) -> DataFrame:
    """Highest status per DOI: late and repeated arrivals cannot lower it, so no watermark is needed."""
    return (stream.select(canonical_doi(F.col("doi")).alias("doi"), st.priority(F.col("status")).alias("rank")).where("doi is not null")
            .groupBy("doi").agg(F.max("rank").alias("rank")))


def _log(stream: DataFrame, log: MergeLog, checkpoint: str, reduce) -> None:
    """Append ``reduce(batch)`` of every batch. No watermark and no state: late rows are as good as early ones."""
    _drain(stream.writeStream.foreachBatch(lambda batch, batch_id: log.append(reduce(batch), batch_id)), checkpoint)


def status_log(spark: SparkSession, path: str) -> MergeLog:
    return MergeLog(spark, path, ["doi"], lambda rows: rows.groupBy("doi").agg(F.max("rank").alias("rank"), F.max("batch_id").alias("batch_id")),
                    "doi string, rank int, batch_id bigint")


def run_status(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch's changed ranks."""
    log = status_log(stream.sparkSession, path)
    _drain(status_updates(stream).writeStream.outputMode("update").foreachBatch(log.append), checkpoint)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Current status per DOI: the highest rank in the change log."""
    return status_log(spark, path).rows().groupBy("doi").agg(st.from_priority(F.max("rank")).alias("status"))


def _sources() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))


def upsert_log(spark: SparkSession, path: str, key: str) -> MergeLog:
    def merge(rows: DataFrame) -> DataFrame:
        return (rows.groupBy(key).agg(F.max(F.struct("batch_id", "last")).alias("w"), F.max("rank").alias("rank"), _sources().alias("sources"))
                .select("*", "w.batch_id", "w.last"))
    return MergeLog(spark, path, [key], merge)


def run_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, payload: list[str]) -> None:
    """Change log of publications: per batch and key the last payload by ``seq``, the highest status and all sources."""
    c = F.col
    _log(stream, upsert_log(stream.sparkSession, path, key), checkpoint, lambda batch: batch.groupBy(key).agg(
        F.max(F.struct("seq", *payload)).alias("last"), F.max(st.priority(c("status"))).alias("rank"), F.collect_set("source").alias("sources")))


def read_snapshot(spark: SparkSession, path: str, key: str, payload: list[str]) -> DataFrame:
    """Current publications with accumulated sources; ``change`` says what the latest batch did: added, changed or same."""
    c = F.col
    held = upsert_log(spark, path, key)
    log = held.rows()
    earlier = c("batch_id") < F.lit(max(held.batches(-1)))  # the newest batch is never part of the base
    state = lambda when: F.max(F.when(when, F.struct("batch_id", c("last.seq").alias("seq"), *[c(f"last.{p}").alias(p) for p in payload])))
    merged = log.groupBy(key).agg(
        state(F.lit(True)).alias("now"), state(earlier).alias("old"), F.max("rank").alias("rank"), F.max(F.when(earlier, c("rank"))).alias("old_rank"),
        _sources().alias("sources"))
    differs = c("rank") > c("old_rank")
    for p in payload:
        differs = differs | ~c(f"now.{p}").eqNullSafe(c(f"old.{p}"))
    change = F.when(c("old").isNull(), "added").when(differs, "changed").otherwise("same")
    return merged.select(key, *[c(f"now.{p}").alias(p) for p in payload], "rank", "sources", change.alias("change"))


def notice_log(spark: SparkSession, path: str) -> MergeLog:
    return MergeLog(spark, path, ["kind", "value"], lambda rows: rows.groupBy("kind", "value").agg(F.max("rank").alias("rank"), F.max("batch_id").alias("batch_id")),
                    "kind string, value string, rank int, batch_id bigint")


def run_notices(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Log of the highest rank per target identifier; the target need not be known yet.

    ``stream``: direction, status and any of target_doi, target_pmid, target_pmcid.
    """
    c = F.col
    targets = {"doi": lambda: canonical_doi(c("target_doi")), "pmid": lambda: F.trim("target_pmid"), "pmcid": lambda: F.upper(F.trim("target_pmcid"))}
    known = [F.struct(F.lit(kind).alias("kind"), value().alias("value")) for kind, value in targets.items() if f"target_{kind}" in stream.columns]
    _log(stream, notice_log(stream.sparkSession, path), checkpoint, lambda batch: batch.where("direction = 'updates'").select(
        st.priority(c("status")).alias("rank"), F.explode(F.array(*known)).alias("t")).select("rank", "t.*").where("value is not null")
        .groupBy("kind", "value").agg(F.max("rank").alias("rank")))


def read_notices(spark: SparkSession, publications: DataFrame, path: str) -> DataFrame:
    """Status of every publication after all notices so far, matched by DOI, PMID or PMCID when it is read."""
    c = F.col
    log = notice_log(spark, path).rows().groupBy("kind", "value").agg(F.max("rank").alias("__raised"))
    values = {"doi": lambda: canonical_doi(c("doi")), "pmid": lambda: F.trim("pmid"), "pmcid": lambda: F.upper(F.trim("pmcid"))}
    own = [F.struct(F.lit(kind).alias("kind"), value().alias("value")) for kind, value in values.items() if kind in publications.columns]
    named = publications.select("publication_id", F.explode(F.array(*own)).alias("t")).select("publication_id", "t.*").where("value is not null")
    raised = named.join(log, ["kind", "value"]).groupBy("publication_id").agg(F.max("__raised").alias("__raised"))
    rank = F.greatest(st.priority(c("status")), F.coalesce("__raised", F.lit(0)))
    return publications.join(raised, "publication_id", "left").select("publication_id", st.from_priority(rank).alias("status"))


def query_hash(*parts: str) -> str:
    """Short name of a query and its schema; another query or schema starts from the beginning."""
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def ingest_log(spark: SparkSession, out: str, schema: str, query: str) -> MergeLog:
    """Complete pages in the base; a page that is not complete comes again, whole, in a later batch."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("page_id", "batch_id")]
        return rows.where("complete").groupBy("page_id").agg(F.max(F.struct("batch_id", *rest)).alias("p")).select("page_id", "p.*")
    return MergeLog(spark, f"{out}/query={query_hash(query, schema)}", ["page_id"], merge, f"{schema}, batch_id bigint")


def run_ingest(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, query: str = "", files_per_batch: int = 1) -> None:
    """Land the pages that arrived since the last run of the same query; ``schema`` must hold page_id and complete."""
    _log(landed(spark, path, schema, files_per_batch=files_per_batch), ingest_log(spark, out, schema, query),
         f"{checkpoint}/{query_hash(query, schema)}", lambda batch: batch)


def read_ingest(spark: SparkSession, out: str, schema: str, query: str = "") -> DataFrame:
    """Complete pages of a query; a page that arrived in part and then whole counts once."""
    log = ingest_log(spark, out, schema, query)
    return log.merge(log.rows()).drop("batch_id")


def unique_log(spark: SparkSession, path: str, keys: list[str]) -> MergeLog:
    return MergeLog(spark, path, keys, lambda rows: rows.groupBy(*keys).agg(F.min(F.struct("batch_id", "first")).alias("f")).select(*keys, "f.batch_id", "f.first"))


def run_deduplicated(stream: DataFrame, keys: list[str], path: str, checkpoint: str, time: str = "ts") -> None:
    """Log of the earliest submission per key and batch."""
    rest = [c for c in stream.columns if c not in keys]
    _log(stream, unique_log(stream.sparkSession, path, keys), checkpoint,
         lambda batch: batch.groupBy(*keys).agg(F.min(F.struct(time, *[c for c in rest if c != time])).alias("first")))


def read_deduplicated(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per key for ever: the submission of the earliest batch, and in it the earliest by time."""
    log = unique_log(spark, path, keys)
    return log.merge(log.rows()).select(*keys, "first.*")


def activity_log(spark: SparkSession, path: str) -> MergeLog:
    return MergeLog(spark, path, ["window", "source"], lambda rows: rows.groupBy("window", "source").agg(
        F.sum("records").alias("records"), F.min("complete").alias("complete"), F.max("batch_id").alias("batch_id")))


def run_check_activity(stream: DataFrame, path: str, checkpoint: str, width: str = "1 day", time: str = "ts") -> None:
    """Log of record counts per source and time window of each batch."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    _log(timed, activity_log(stream.sparkSession, path), checkpoint,
         lambda batch: batch.groupBy(F.window(time, width), "source").agg(F.count("*").alias("records"), F.min("complete").alias("complete")))


def read_check_activity(spark: SparkSession, path: str) -> DataFrame:
    """Records per source and window over all batches; open windows and late records are included."""
    log = activity_log(spark, path)
    return log.merge(log.rows()).drop("batch_id")


def cascade_tables(spark: SparkSession, path: str, buckets: int = 32) -> tuple[RankedTable, RankedTable]:
    """The documents and the measurements that a stream of status changes keeps up to date."""
    return RankedTable(spark, f"{path}/documents", "document_hash", buckets), RankedTable(spark, f"{path}/measurements", "measurement_id", buckets)


def land_cascade(documents: DataFrame, evidence: DataFrame, path: str, buckets: int = 32) -> None:
    """Documents answer to their DOI and publication id, measurements (of ``evidence``) to the documents they cite."""
    c = F.col
    own, cited = cascade_tables(documents.sparkSession, path, buckets)
    names = F.explode(F.array(F.concat(F.lit("doi:"), canonical_doi(c("doi"))), F.concat(F.lit("publication:"), c("publication_id"))))
    own.land(documents.select("document_hash", "status"), documents.select("document_hash", names.alias("name")))
    cited.land(None, evidence.select("measurement_id", c("document_hash").alias("name")))


def run_cascade(stream: DataFrame, path: str, checkpoint: str, buckets: int = 32) -> None:
    """Status changes (publication_id, doi, status) reach documents and, through these, measurements."""
    c = F.col
    names = F.explode(F.array(F.concat(F.lit("doi:"), canonical_doi(c("doi"))), F.concat(F.lit("publication:"), c("publication_id"))))
    changes = stream.where("status <> 'active'").select(names.alias("name"), st.priority(c("status")).alias("rank"))
    tables = list(cascade_tables(stream.sparkSession, path, buckets))
    _drain(changes.writeStream.foreachBatch(lambda batch, batch_id: cascade(tables, batch, batch_id)), checkpoint)


def read_documents(spark: SparkSession, path: str, rule: str = "workflow", buckets: int = 32) -> DataFrame:
    """Documents with the state that the changes so far force on them, as ``invalidate`` gives it."""
    name = st.from_priority(F.col("rank"))
    return cascade_tables(spark, path, buckets)[0].rows().select(
        "document_hash", name.alias("publication_status"), F.when(F.col("rank") > 0, document_status(name, rule)).otherwise(F.col("status")).alias("status"))


def read_stale(spark: SparkSession, path: str, buckets: int = 32) -> DataFrame:
    """Measurements that cite a document with a changed status, with the note to add."""
    return cascade_tables(spark, path, buckets)[1].rows().where("rank > 0").select(
        "measurement_id", F.concat(F.lit("publication status: "), st.from_priority(F.col("rank"))).alias("note"))


def folders(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh (table, checkpoint) folders under the shared folder."""
    root = scratch_path(spark, label)
    return f"{root}/table", f"{root}/checkpoint"


# ---- batch side of the same rules ------------------------------------------------------------------


def document_status(status: Column, rule: str = "workflow") -> Column:
    """State of a document whose publication has the given non-active status.

    The service marks corrected sources stale and quarantines the rest; the workflow quarantines
    retracted, withdrawn and doubtful ones and marks the rest stale.
    """
    if rule == "service":
        return F.when(status == "corrected", "stale").otherwise("quarantined")
    return F.when(status.isin("retracted", "withdrawn", "concern"), "quarantined").otherwise("stale")


def invalidate(publications: DataFrame, documents: DataFrame, aliases: DataFrame | None = None, rule: str = "workflow") -> DataFrame:
    """Documents with the state their publications force on them.

    A document belongs to a publication by DOI or by publication id (or an alias of it): two equi-joins
    instead of one join with an OR.
    """
    c = F.col
    flagged = publications.where("status <> 'active'").select("publication_id", canonical_doi(c("doi")).alias("doi"), st.priority(c("status")).alias("rank"))
    names = flagged.select("publication_id", "rank")
    if aliases is not None:
        names = names.unionByName(aliases.join(flagged.select("publication_id", "rank"), "publication_id").select(c("alias").alias("publication_id"), "rank"))
    docs = documents.select("document_hash", canonical_doi(c("doi")).alias("doi"), "publication_id")
    by_doi = docs.join(flagged.where("doi is not null").groupBy("doi").agg(F.max("rank").alias("rank")), "doi").select("document_hash", "rank")
    by_id = docs.join(names.groupBy("publication_id").agg(F.max("rank").alias("rank")), "publication_id").select("document_hash", "rank")
    hit = by_doi.unionByName(by_id).groupBy("document_hash").agg(F.max("rank").alias("__rank"))
    forced = document_status(st.from_priority(c("__rank")), rule)
    return (documents.join(hit, "document_hash", "left")
            .withColumn("publication_status", st.from_priority(F.coalesce("__rank", F.lit(0))))
            .withColumn("status", F.when(c("__rank").isNotNull(), forced).otherwise(c("status"))).drop("__rank"))


def stale_measurements(measurements: DataFrame, evidence: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Measurements citing an invalidated document, with the note to add once."""
    c = F.col
    bad = invalidated.where("publication_status <> 'active'").select("document_hash", st.priority(c("publication_status")).alias("rank"))
    hit = evidence.join(bad, "document_hash").groupBy("measurement_id").agg(F.max("rank").alias("__rank"))
    note = F.concat(F.lit("publication status: "), st.from_priority(c("__rank")))
    return measurements.join(hit, "measurement_id", "left").withColumn(
        "status", F.when(c("__rank").isNotNull(), "stale").otherwise(c("status"))).withColumn("note", F.when(c("__rank").isNotNull(), note)).drop("__rank")


def experiment_status(experiments: DataFrame, invalidated: DataFrame) -> DataFrame:
    c = F.col
    return experiments.join(invalidated.select("document_hash", "publication_status"), "document_hash", "left").withColumn(
        "source_status", st.higher(c("source_status"), F.coalesce("publication_status", F.lit("active")))).drop("publication_status")


def publication_states(publications: DataFrame, documents: DataFrame) -> DataFrame:
    """State of each publication from its own status and its documents."""
    c = F.col
    per = documents.select(canonical_doi(c("doi")).alias("__doi"), (c("status") == "completed").alias("ok")).where("__doi is not null").groupBy("__doi").agg(F.bool_and("ok").alias("__all"))
    j = publications.withColumn("__doi", canonical_doi(c("doi"))).join(per, "__doi", "left")
    state = (F.when(c("status") == "corrected", "stale").when(c("status") != "active", "quarantined")
             .when(c("__all"), "active").when(c("__all").isNotNull(), "pending_extraction").otherwise(c("state")))
    return j.withColumn("state", state).drop("__doi", "__all")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """added, changed and unchanged counts between two snapshots."""
    c = F.col
    j = before.select(key, c(column).alias("__b"), F.lit(True).alias("__in")).join(after.select(key, c(column).alias("__a"), F.lit(True).alias("__out")), key, "full_outer")
    kind = (F.when(c("__in").isNull(), "added").when(c("__out").isNull(), "absent").when(c("__a").eqNullSafe(c("__b")), "same").otherwise("changed"))
    return j.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def reextract(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshot after documents were extracted again: earlier rows of those documents become superseded.

    Both carry document_hash, measurement_id, status and the same payload. Rows whose id appears again
    are replaced; the others stay visible as stale with a note.
    """
    c = F.col
    touched = current.select("document_hash").distinct()
    kept = previous.join(current.select("measurement_id"), "measurement_id", "left_anti").join(
        touched.withColumn("__t", F.lit(True)), "document_hash", "left")
    old = kept.withColumn("status", F.when(c("__t"), "stale").otherwise(c("status"))).withColumn(
        "note", F.when(c("__t"), "replaced by a later extraction")).drop("__t")
    return old.unionByName(current.withColumn("note", F.lit(None).cast("string")).select(old.columns))


def check_schedule(checks: DataFrame, retry_hours: int = 1) -> DataFrame:
    """Next due time of each project: the weekly slot after a complete check, else a retry.

    ``checks``: project, source, finished_at, complete. Freshness advances only if every source completed.
    """
    c = F.col
    per = checks.groupBy("project").agg(F.bool_and("complete").alias("complete"), F.max("finished_at").alias("finished_at"))
    due = F.when(c("complete"), next_weekly_check(c("finished_at"))).otherwise(c("finished_at") + F.make_interval(hours=F.lit(retry_hours)))
    return per.select("project", "complete", F.when(c("complete"), c("finished_at")).alias("fresh_as_of"), due.alias("next_check"))


def freshness(publications: DataFrame, documents: DataFrame, measurements: DataFrame, flag: bool, unresolved: list[str]) -> DataFrame:
    """One row: is the synthesis stale, and the counts that say why."""
    p = publications.agg(F.coalesce(F.sum((F.col("state") == "pending_extraction").cast("bigint")), F.lit(0)).alias("pending"))
    d = documents.agg(F.coalesce(F.sum(F.col("status").isin(*unresolved).cast("bigint")), F.lit(0)).alias("unresolved"))
    m = measurements.agg(F.coalesce(F.sum(F.col("status").isin("candidate", "uncertain", "stale").cast("bigint")), F.lit(0)).alias("open_measurements"))
    one = p.crossJoin(d).crossJoin(m)  # three single-row aggregates
    return one.withColumn("stale", F.lit(flag) | (F.col("pending") > 0) | (F.col("unresolved") > 0) | (F.col("open_measurements") > 0))
