"""Living-state queries: cascades, freshness, schedules and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.plans.fixtures import table, view
from evloom.plans.literature import NAME, RANK
from evloom.plans.registry import query
from evloom.plans.synthesis import evidence_rows
from evloom.streaming import living as lv

FLAG = f"""WITH pub AS (SELECT 'pub-' || s_suppkey AS publication_id, '10.1234/s' || s_suppkey AS doi, CASE s_suppkey % 6 WHEN 0 THEN 'retracted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'concern' ELSE 'active' END AS status FROM supplier WHERE s_suppkey % 5 <> 0),
flagged AS (SELECT publication_id, doi, {RANK.format('status')} AS r FROM pub WHERE status <> 'active'),
hit AS (SELECT document_hash, max(r) AS r FROM (SELECT d.document_hash, f.r FROM fx_documents d JOIN flagged f ON f.doi = d.doi
  UNION ALL SELECT d.document_hash, f.r FROM fx_documents d JOIN flagged f ON f.publication_id = d.publication_id) x GROUP BY 1),
inval AS (SELECT d.document_hash, {NAME.format('coalesce(h.r, 0)')} AS publication_status,
  CASE WHEN h.r IS NULL THEN d.status WHEN h.r IN (2, 3, 4) THEN 'quarantined' ELSE 'stale' END AS status FROM fx_documents d LEFT JOIN hit h ON h.document_hash = d.document_hash)"""


def _invalidated(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0")
    k = F.col("s_suppkey")
    pub = s.select(F.concat(F.lit("pub-"), k).alias("publication_id"), F.concat(F.lit("https://doi.org/10.1234/S"), k).alias("doi"),
                   F.when(k % 6 == 0, "retracted").when(k % 6 == 1, "corrected").when(k % 6 == 2, "concern").otherwise("active").alias("status"))
    return lv.invalidate(pub, view(spark, sf, "fx_documents"))


@query("invalidated_documents", FLAG + " SELECT document_hash, publication_status, status FROM inval")
def invalidated_documents(spark, sf):
    return _invalidated(spark, sf).select("document_hash", "publication_status", "status")


@query("stale_measurements", FLAG + f""", e AS (SELECT measurement_id, document_hash FROM fx_measurements UNION ALL SELECT measurement_id, second_document FROM fx_measurements WHERE page = 1),
b AS (SELECT e.measurement_id, max({RANK.format('i.publication_status')}) AS r FROM e JOIN inval i ON i.document_hash = e.document_hash WHERE i.publication_status <> 'active' GROUP BY 1)
SELECT CASE WHEN b.r IS NULL THEN m.status ELSE 'stale' END AS status, CASE WHEN b.r IS NOT NULL THEN 'publication status: ' || {NAME.format('b.r')} END AS note, CAST(count(*) AS BIGINT) AS n
FROM fx_measurements m LEFT JOIN b ON b.measurement_id = m.measurement_id GROUP BY 1, 2""")
def stale_measurements(spark, sf):
    m = lv.stale_measurements(view(spark, sf, "fx_measurements"), evidence_rows(spark, sf), _invalidated(spark, sf))
    return m.groupBy("status", "note").agg(F.count("*").alias("n"))


@query("experiment_source_status", FLAG + f""" SELECT e.experiment_id, {NAME.format(f"greatest({RANK.format('e.source_status')}, {RANK.format('i.publication_status')})")} AS source_status
FROM fx_experiments e JOIN inval i ON i.document_hash = e.document_hash""")
def experiment_source_status(spark, sf):
    return lv.experiment_status(view(spark, sf, "fx_experiments"), _invalidated(spark, sf)).select("experiment_id", "source_status")


@query("publication_states", """WITH d AS (SELECT doi, bool_and(status = 'completed') AS ok FROM (SELECT '10.1234/c' || s_suppkey AS doi, CASE WHEN s_suppkey % 3 = 0 THEN 'uploaded' ELSE 'completed' END AS status FROM supplier) x GROUP BY 1)
SELECT p.publication_id, CASE WHEN p.status = 'corrected' THEN 'stale' WHEN p.status <> 'active' THEN 'quarantined' WHEN d.ok THEN 'active' WHEN d.ok IS NOT NULL THEN 'pending_extraction' ELSE p.state END AS state
FROM fx_publications p LEFT JOIN d ON d.doi = p.doi""")
def publication_states(spark, sf):
    k = F.col("s_suppkey")
    d = table(spark, sf, "supplier").select(F.concat(F.lit("10.1234/c"), k).alias("doi"), F.when(k % 3 == 0, "uploaded").otherwise("completed").alias("status"))
    return lv.publication_states(view(spark, sf, "fx_publications"), d).select("publication_id", "state")


@query("snapshot_changes", """SELECT change, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'absent' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change
  FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0) b FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0) a ON a.k = b.k) x GROUP BY 1""")
def snapshot_changes(spark, sf):
    cst = table(spark, sf, "customer")
    after = cst.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "moved").otherwise(F.col("c_mktsegment")))
    return lv.snapshot_changes(cst.where("c_custkey % 5 <> 0"), after, "c_custkey", "c_mktsegment")


@query("reextraction", """WITH cur AS (SELECT DISTINCT measurement_id, document_hash FROM fx_measurements WHERE page <= 3 AND status = 'accepted'), t AS (SELECT DISTINCT document_hash FROM cur)
SELECT status, note, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN t.document_hash IS NOT NULL THEN 'stale' ELSE m.status END AS status, CASE WHEN t.document_hash IS NOT NULL THEN 'replaced by a later extraction' END AS note
  FROM fx_measurements m LEFT JOIN t ON t.document_hash = m.document_hash WHERE m.measurement_id NOT IN (SELECT measurement_id FROM cur)
  UNION ALL SELECT 'accepted', NULL FROM cur) x GROUP BY 1, 2""")
def reextraction(spark, sf):
    m = view(spark, sf, "fx_measurements").select("document_hash", "measurement_id", "status", "page")
    current = m.where("page <= 3 and status = 'accepted'").groupBy("measurement_id").agg(
        F.min(F.struct("document_hash", "status", "page")).alias("x")).select("x.document_hash", "measurement_id", "x.status", "x.page")
    return lv.reextract(m, current).groupBy("status", "note").agg(F.count("*").alias("n"))


@query("check_schedule", """WITH p AS (SELECT user_id, bool_and(event_type <> 'error' OR value > 20) AS complete, max(ts) AS f FROM events GROUP BY 1),
l AS (SELECT *, timezone('Europe/Madrid', timezone('UTC', f)) AS lt FROM p), d AS (SELECT *, date_trunc('day', lt) + CAST((8 - isodow(lt)) % 7 AS INTEGER) * INTERVAL 1 DAY AS day FROM l)
SELECT user_id AS project, CAST(complete AS STRING) AS complete, strftime(CASE WHEN complete THEN timezone('UTC', timezone('Europe/Madrid', CASE WHEN day + INTERVAL 8 HOUR > lt THEN day + INTERVAL 8 HOUR ELSE day + INTERVAL 176 HOUR END)) ELSE f + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_check FROM d""")
def check_schedule(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("finished_at"),
                                          ((F.col("event_type") != "error") | (F.col("value") > 20)).alias("complete"))
    return lv.check_schedule(e).select("project", F.col("complete").cast("string").alias("complete"), F.date_format("next_check", "yyyy-MM-dd HH:mm:ss").alias("next_check"))


@query("freshness", """SELECT CAST((SELECT count(*) FROM fx_publications WHERE state = 'pending_extraction') AS BIGINT) AS pending, CAST((SELECT count(*) FROM fx_documents WHERE status IN ('uploaded', 'extracting', 'failed', 'stale', 'quarantined')) AS BIGINT) AS unresolved,
  CAST((SELECT count(*) FROM fx_measurements WHERE status IN ('candidate', 'uncertain', 'stale')) AS BIGINT) AS open_measurements, 'true' AS stale""")
def freshness(spark, sf):
    f = lv.freshness(view(spark, sf, "fx_publications"), view(spark, sf, "fx_documents"), view(spark, sf, "fx_measurements"), False,
                     ["uploaded", "extracting", "failed", "stale", "quarantined"])
    return f.withColumn("stale", F.col("stale").cast("string"))


# ---- streams ------------------------------------------------------------------------------------


def _split(spark, sf, df, label, parts=4):
    """Land a derived table as several files, the way checks would."""
    path = lv.folders(spark, label)[0]
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return path, df.schema


def _files(df, rows=20_000):
    """How many files a lot lands in: two, or more as it grows."""
    return max(2, -(-df.count() // rows))


@query("stream_status", f"""SELECT doi_plain AS doi, {NAME.format(f"max({RANK.format('status')})")} AS status FROM fx_citations WHERE doi_plain IS NOT NULL GROUP BY 1""")
def stream_status(spark, sf):
    landed, schema = _split(spark, sf, view(spark, sf, "fx_citations").select(F.col("doi_text").alias("doi"), "status"), "citations")
    out, mark = lv.folders(spark, "status")
    lv.run_status(lv.landed(spark, landed, schema, files_per_batch=1), out, mark)
    return lv.read_status(spark, out)


@query("stream_upsert", f"""SELECT doi_plain AS doi, {NAME.format(f"max({RANK.format('status')})")} AS status, CAST(count(DISTINCT title) > 0 AS STRING) AS has_title,
  array_to_string(list_sort(list_distinct(list('source-' || (input_pos % 3)))), ',') AS sources FROM fx_citations WHERE doi_plain IS NOT NULL GROUP BY 1""")
def stream_upsert(spark, sf):
    from evloom.functions import status as st
    c = view(spark, sf, "fx_citations").where("doi_plain is not null").select(
        F.col("doi_plain").alias("doi"), "title", "status", F.col("input_pos").alias("seq"), F.concat(F.lit("source-"), F.col("input_pos") % 3).alias("source"))
    landed, schema = _split(spark, sf, c, "records")
    out, mark = lv.folders(spark, "snapshot")
    lv.run_upsert(lv.landed(spark, landed, schema, files_per_batch=1), out, mark, "doi", ["title"])
    return lv.read_snapshot(spark, out, "doi", ["title"]).select(
        "doi", st.from_priority(F.col("rank")).alias("status"), F.col("title").isNotNull().cast("string").alias("has_title"), F.array_join("sources", ",").alias("sources"))


@query("upsert_changes", """SELECT change, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'added' WHEN c_custkey % 7 <> 0 AND c_custkey % 4 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 <> 0) x GROUP BY 1""")
def upsert_changes(spark, sf):
    """Two batches of customers: the second adds, changes and repeats."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.lit("active").alias("status"), F.lit("crm").alias("source"))
    first = c.where("key % 5 <> 0").withColumn("seq", F.lit(1))
    second = c.where("key % 7 <> 0").withColumn("segment", F.when((F.col("key") % 4 == 0) & (F.col("key") % 5 != 0), "moved").otherwise(F.col("segment"))).withColumn("seq", F.lit(2))
    out, mark = lv.folders(spark, "upserts")
    path = lv.folders(spark, "landed")[0]
    for part in (first, second):  # the second run resumes behind the first and reads only what is new
        part.repartition(_files(part)).write.mode("append").parquet(path)
        lv.run_upsert(lv.landed(spark, path, first.schema), out, mark, "key", ["segment"])  # all that is new is one batch
    return lv.read_snapshot(spark, out, "key", ["segment"]).groupBy("change").agg(F.count("*").alias("n"))


@query("stream_notices", f"""WITH n AS (SELECT target_doi, max({RANK.format('status')}) AS r FROM fx_notices WHERE direction = 'updates' GROUP BY 1)
SELECT b.publication_id, {NAME.format(f"greatest({RANK.format('b.status')}, coalesce(n.r, 0))")} AS status FROM fx_publications b LEFT JOIN n ON n.target_doi = b.doi""")
def stream_notices(spark, sf):
    """Every second notice names its target by a number instead of the DOI; publications are only joined when read."""
    c = F.col
    publications = view(spark, sf, "fx_publications")
    by_number = F.abs(F.xxhash64("target_doi")) % 2 == 0
    number = lambda doi: F.concat(F.lit("n"), doi)
    n = view(spark, sf, "fx_notices").select(F.when(~by_number, c("target_doi")).alias("target_doi"), F.when(by_number, number(c("target_doi"))).alias("target_pmid"), "status", "direction")
    landed, schema = _split(spark, sf, n, "notices")
    out, mark = lv.folders(spark, "raised")
    lv.run_notices(lv.landed(spark, landed, schema, files_per_batch=2), out, mark)
    return lv.read_notices(spark, publications.withColumn("pmid", number(c("doi"))), out)


def _landed_events(spark, sf, df, label, files):
    landed, schema = _split(spark, sf, df, label, files)
    return lv.landed(spark, landed, schema, files_per_batch=1)


@query("stream_deduplicated", """SELECT event_type, CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events GROUP BY 1""")
def stream_deduplicated(spark, sf, files=4):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    out, mark = lv.folders(spark, "unique")
    lv.run_deduplicated(_landed_events(spark, sf, e.unionByName(e.where("event_id % 3 = 0")), "submissions", files), ["event_id"], out, mark)
    return lv.read_deduplicated(spark, out, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_check_activity", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS source, CAST(count(*) AS BIGINT) AS records, CAST(bool_and(value > 1) AS STRING) AS complete FROM events GROUP BY 1, 2""")
def stream_check_activity(spark, sf, files=4):
    """Daily record counts per source over all landed files, open windows included."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), "ts", (F.col("value") > 1).alias("complete"))
    out, mark = lv.folders(spark, "activity")
    lv.run_check_activity(_landed_events(spark, sf, e, "checks", files), out, mark)
    return lv.read_check_activity(spark, out).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "source", "records", F.col("complete").cast("string").alias("complete"))


def _changes(spark, sf):
    """Status changes of publications, each sent twice: first one step milder, then as it is."""
    k = F.col("s_suppkey")
    final = F.when(k % 6 == 0, "retracted").when(k % 6 == 1, "corrected").when(k % 6 == 2, "concern").otherwise("active")
    s = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(
        F.concat(F.lit("pub-"), k).alias("publication_id"), F.concat(F.lit("https://doi.org/10.1234/S"), k).alias("doi"), final.alias("status"))
    return s, s.withColumn("status", F.when(F.col("status") == "retracted", "corrected").otherwise(F.col("status")))


def _cascaded(spark, sf):
    final, mild = _changes(spark, sf)
    path, mark = lv.folders(spark, "cascade")
    lv.land_cascade(view(spark, sf, "fx_documents"), evidence_rows(spark, sf), path)
    landed = lv.folders(spark, "changes")[0]
    for part in (mild, final, mild):  # the last one comes late and lowers nothing
        part.repartition(_files(part)).write.mode("append").parquet(landed)
        lv.run_cascade(lv.landed(spark, landed, final.schema), path, mark)
    return path


@query("stream_cascade", FLAG + " SELECT document_hash, publication_status, status FROM inval")
def stream_cascade(spark, sf):
    """Documents kept by a stream of status changes: the same rows as the batch form gives."""
    return lv.read_documents(spark, _cascaded(spark, sf))


@query("stream_stale", FLAG + f""", e AS (SELECT measurement_id, document_hash FROM fx_measurements UNION ALL SELECT measurement_id, second_document FROM fx_measurements WHERE page = 1)
SELECT e.measurement_id, 'publication status: ' || {NAME.format(f"max({RANK.format('i.publication_status')})")} AS note
FROM e JOIN inval i ON i.document_hash = e.document_hash WHERE i.publication_status <> 'active' GROUP BY 1""")
def stream_stale(spark, sf):
    """Measurements that the same stream made stale."""
    return lv.read_stale(spark, _cascaded(spark, sf))


@query("resumed_ingest", """SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(length(html)) AS BIGINT) AS characters, CAST(3 AS BIGINT) AS runs FROM pages WHERE page_id % 7 <> 0""")
def resumed_ingest(spark, sf):
    """Pages land in three lots with a run after each; every seventh page never completes, every fifth completes in the last lot."""
    c = F.col
    schema = "page_id bigint, html string, complete boolean"
    p = table(spark, sf, "pages").select("page_id", "html")
    lots = [p.where("page_id % 2 = 0").withColumn("complete", (c("page_id") % 7 != 0) & (c("page_id") % 5 != 0)),
            p.where("page_id % 2 = 1").withColumn("complete", (c("page_id") % 7 != 0) & (c("page_id") % 5 != 0)),
            p.where("page_id % 5 = 0").withColumn("complete", c("page_id") % 7 != 0)]
    path = lv.folders(spark, "pages")[0]
    out, mark = lv.folders(spark, "ingest")
    for lot in lots:
        n = _files(lot)
        lot.repartition(n).write.mode("append").parquet(path)
        lv.run_ingest(spark, path, schema, out, mark, "pages of a site", files_per_batch=-(-n // 2))
    got = lv.read_ingest(spark, out, schema, "pages of a site")
    return got.agg(F.count("*").alias("pages"), F.sum(F.length("html")).cast("bigint").alias("characters"), F.lit(3).cast("bigint").alias("runs"))


@query("event_log", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1""")
def event_log(spark, sf):
    """Events appended in two goes and read back as one log."""
    from evloom.sources import files
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    path = lv.folders(spark, "log")[0]
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")):
        files.append_events(part, path)
    return files.read_events(spark, path, "event_id bigint, event_type string, user_id bigint").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("user_id").cast("bigint").alias("users"))
