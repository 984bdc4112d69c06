"""Literature queries: identity, entity resolution, publication merge, notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.functions import dates, text, urls
from evloom.functions import status as st
from evloom.operators import identity as idn
from evloom.plans.fixtures import view
from evloom.plans.registry import query

RANK = """CASE {0} WHEN 'corrected' THEN 1 WHEN 'concern' THEN 2 WHEN 'withdrawn' THEN 3 WHEN 'retracted' THEN 4 ELSE 0 END"""
NAME = """CASE {0} WHEN 1 THEN 'corrected' WHEN 2 THEN 'concern' WHEN 3 THEN 'withdrawn' WHEN 4 THEN 'retracted' ELSE 'active' END"""


def citations(spark, sf):
    c = view(spark, sf, "fx_citations").withColumnRenamed("doi_text", "doi")
    return c.withColumn("related_dois", F.array_compact(F.array("related_doi"))).drop("doi_plain", "related_doi", "custkey", "updated_on")


# every citation of one work shares a DOI, a PMID or a stated relation; walked to closure below
GRAPH = """WITH RECURSIVE keyed AS (
  SELECT *, coalesce(doi_plain, 'pmid:' || pmid, 'pmcid:' || pmcid, source || ':' || source_id) AS k FROM fx_citations),
edge AS (
  SELECT k AS a, 'pmid:' || pmid AS b FROM keyed WHERE pmid IS NOT NULL UNION SELECT k, 'pmcid:' || pmcid FROM keyed WHERE pmcid IS NOT NULL
  UNION SELECT k, related_doi FROM keyed WHERE related_doi IS NOT NULL),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT k, k FROM keyed),
walk AS (SELECT a AS node, a AS seen FROM sym UNION SELECT w.node, s.b FROM walk w JOIN sym s ON s.a = w.seen),
comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1),
placed AS (SELECT c.*, m.component FROM keyed c JOIN comp m ON m.node = c.k),
best AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY is_preprint, doi_plain IS NULL, coalesce(abstract, '') = '', input_pos) AS rn FROM placed),
chosen AS (SELECT * FROM best WHERE rn = 1),
same0 AS (SELECT p.component, p.input_pos, p.pmid, p.pmcid FROM placed p JOIN chosen c ON c.component = p.component WHERE p.doi_plain IS NOT DISTINCT FROM c.doi_plain),
same AS (SELECT * FROM same0 UNION SELECT p.component, p.input_pos, p.pmid, p.pmcid FROM placed p JOIN same s ON s.component = p.component
  AND p.doi_plain IS NULL AND (p.pmid = s.pmid OR p.pmcid = s.pmcid))"""


@query("citation_records", f"""{GRAPH},
full_same AS (SELECT p.* FROM placed p JOIN same s ON s.input_pos = p.input_pos),
agg AS (SELECT component, max({RANK.format('status')}) AS rank,
  arg_min(pmid, input_pos) FILTER (pmid <> '') AS pmid, arg_min(pmcid, input_pos) FILTER (pmcid <> '') AS pmcid,
  arg_min(license, input_pos) FILTER (license <> '') AS license, arg_min(full_text_url, input_pos) FILTER (full_text_url <> '') AS full_text_url
  FROM full_same GROUP BY 1),
whole AS (SELECT component, arg_min(abstract, input_pos) FILTER (abstract <> '') AS abstract, CAST(count(*) AS BIGINT) AS members FROM placed GROUP BY 1)
SELECT c.input_pos, c.source, c.source_id, c.doi_plain AS doi, c.title, coalesce(c.pmid, a.pmid) AS pmid, coalesce(c.pmcid, a.pmcid) AS pmcid,
  coalesce(nullif(c.license, ''), a.license) AS license, coalesce(c.full_text_url, a.full_text_url) AS full_text_url,
  coalesce(c.abstract, w.abstract) AS abstract, {NAME.format('a.rank')} AS status, w.members
FROM chosen c JOIN agg a ON a.component = c.component JOIN whole w ON w.component = c.component""")
def citation_records(spark, sf):
    r = idn.reconcile(citations(spark, sf)).records
    return r.select("input_pos", "source", "source_id", "doi", "title", "pmid", "pmcid", "license", "full_text_url",
                    "abstract", "status", "members")


@query("citation_members", f"""{GRAPH}
SELECT p.input_pos, p.component, CAST(s.input_pos IS NOT NULL AS STRING) AS same_version
FROM placed p LEFT JOIN same s ON s.input_pos = p.input_pos""")
def citation_members(spark, sf):
    return idn.reconcile(citations(spark, sf)).members.select("input_pos", "component", F.col("same_version").cast("string").alias("same_version"))


@query("citation_related_dois", f"""{GRAPH}, linked AS (
  SELECT p.component, p.doi_plain AS d FROM placed p UNION SELECT component, related_doi FROM placed)
SELECT DISTINCT l.component, l.d AS related_doi FROM linked l JOIN chosen c ON c.component = l.component
WHERE l.d IS NOT NULL AND l.d IS DISTINCT FROM c.doi_plain""")
def citation_related(spark, sf):
    return idn.reconcile(citations(spark, sf)).related


@query("citation_relations", f"""{GRAPH}, told AS (SELECT input_pos, input_pos % 3 AS t, status AS kind FROM fx_citations UNION ALL SELECT input_pos, 0, status FROM fx_citations WHERE input_pos % 2 = 0)
SELECT DISTINCT s.component, '10.1234/notice' || t AS target, kind, 'day ' || t AS first_date, 'registry' AS origin FROM told JOIN same s ON s.input_pos = told.input_pos""")
def citation_relations(spark, sf):
    """Update relations of every work, once each however many of its records repeat them; they hold an array and a map."""
    c = F.col
    r = citations(spark, sf)
    t = F.explode(F.when(c("input_pos") % 2 == 0, F.array(c("input_pos") % 3, F.lit(0))).otherwise(F.array(c("input_pos") % 3)))
    told = r.select("input_pos", "status", t.alias("t")).select(
        "input_pos", F.concat(F.lit("10.1234/notice"), "t").alias("target"), c("status").alias("kind"),
        F.array(F.struct(F.concat(F.lit("day "), "t").alias("date"))).alias("dates"), F.create_map(F.lit("origin"), F.lit("registry")).alias("more"))
    found = idn.reconcile(r, told).relations
    return found.select("component", "target", "kind", c("dates")[0]["date"].alias("first_date"), c("more")["origin"].alias("origin"))


@query("canonical_dois", """SELECT input_pos, doi_plain AS doi,
  CASE WHEN doi_plain IS NOT NULL THEN 'doi:' || doi_plain WHEN source = 'arxiv' THEN 'arxiv:' || source_id ELSE source || ':' || source_id END AS citation_key,
  CASE WHEN source = 'arxiv' THEN 'arxiv:arxiv.org/abs/rec-' || input_pos ELSE source || ':' || source_id END AS source_key
FROM fx_citations""")
def canonical_dois(spark, sf):
    c = view(spark, sf, "fx_citations")
    none = F.lit(None).cast("string")
    return c.select("input_pos", text.canonical_doi(F.col("doi_text")).alias("doi"),
                    idn.citation_key(F.col("source"), F.col("source_id"), F.col("doi_text")).alias("citation_key"),
                    idn.citation_key(F.col("source"), F.col("source_id"), none).alias("source_key"))


@query("identifier_table", """SELECT input_pos, 'doi:' || doi_plain AS identifier FROM fx_citations WHERE doi_plain IS NOT NULL
UNION ALL SELECT input_pos, 'pmid:' || pmid FROM fx_citations WHERE pmid IS NOT NULL
UNION ALL SELECT input_pos, 'pmcid:' || pmcid FROM fx_citations WHERE pmcid IS NOT NULL
UNION ALL SELECT input_pos, source || ':' || source_id FROM fx_citations""")
def identifier_table(spark, sf):
    c = F.col
    return view(spark, sf, "fx_citations").select("input_pos", F.explode(idn.identifiers(
        c("doi_text"), c("pmid"), c("pmcid"), c("source"), c("source_id"))).alias("identifier"))


@query("family_components", """WITH RECURSIVE edge AS (SELECT DISTINCT doi_plain AS a, related_doi AS b FROM fx_citations
  WHERE doi_plain IS NOT NULL AND related_doi IS NOT NULL),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT a, a FROM edge UNION SELECT b, b FROM edge),
walk AS (SELECT a AS doi, b AS seen FROM sym UNION SELECT w.doi, s.b FROM walk w JOIN sym s ON s.a = w.seen)
SELECT doi, min(seen) AS family FROM walk GROUP BY 1""")
def family_components(spark, sf):
    c = view(spark, sf, "fx_citations").withColumnRenamed("doi_text", "doi")
    return idn.family_components(c.select("doi"), c.select("doi", "related_doi"))


@query("relabelled_experiments", """WITH RECURSIVE pairs AS (SELECT DISTINCT '10.1234/s' || s_suppkey AS a, '10.1234/s' || (s_suppkey - s_suppkey % 4 + 1) AS b
  FROM supplier WHERE s_suppkey % 3 = 0),
sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs),
walk AS (SELECT a AS doi, b AS seen FROM sym UNION SELECT w.doi, s.b FROM walk w JOIN sym s ON s.a = w.seen),
lab AS (SELECT doi, min(seen) AS family FROM walk GROUP BY 1)
SELECT e.experiment_id, coalesce(l.family, e.study_family) AS study_family FROM fx_experiments e LEFT JOIN lab l ON l.doi = e.doi""")
def relabelled_experiments(spark, sf):
    s = view(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    key = F.col("s_suppkey")
    pairs = s.select(F.concat(F.lit("https://doi.org/10.1234/S"), key).alias("doi"),
                     F.concat(F.lit("10.1234/s"), key - key % 4 + 1).alias("related_doi"))
    families = idn.family_components(pairs.select("doi"), pairs)
    return idn.relabel_families(view(spark, sf, "fx_experiments"), families).select("experiment_id", "study_family")


@query("status_by_doi", f"""SELECT doi_plain AS doi, {NAME.format(f"max({RANK.format('status')})")} AS status
FROM fx_citations WHERE doi_plain IS NOT NULL GROUP BY 1""")
def status_by_doi(spark, sf):
    return idn.status_by_doi(view(spark, sf, "fx_citations").withColumnRenamed("doi_text", "doi"))


@query("notice_targets", f"""WITH n AS (SELECT target_doi, max({RANK.format('status')}) AS r FROM fx_notices WHERE direction = 'updates' GROUP BY 1),
p AS (SELECT target_pmid, max({RANK.format('status')}) AS r FROM fx_notices WHERE direction = 'updates' GROUP BY 1)
SELECT b.publication_id, {NAME.format(f"greatest({RANK.format('b.status')}, coalesce(n.r, 0), coalesce(p.r, 0))")} AS status
FROM fx_publications b LEFT JOIN n ON n.target_doi = b.doi LEFT JOIN p ON p.target_pmid = b.pmid""")
def notice_targets(spark, sf):
    p = view(spark, sf, "fx_publications")
    c = F.col
    ids = p.select("publication_id", F.explode(idn.identifiers(
        c("doi"), c("pmid"), F.lit(None).cast("string"), c("source"), c("source_id"))).alias("identifier"))
    return idn.apply_notices(p, ids, view(spark, sf, "fx_notices")).select("publication_id", "status")


def _merged(spark, sf):
    c = F.col
    none = F.lit(None).cast("string")
    old = view(spark, sf, "fx_publications").withColumn(
        "identifiers", idn.identifiers(c("doi"), c("pmid"), none, c("source"), c("source_id"))).withColumn("license", none)
    # a second known record per fifth work carries only its PMID, until a citation names both
    second = old.where("position % 5 = 0").select(
        F.concat(F.lit("alt-"), c("position")).alias("publication_id"), (c("position") + 10000000).alias("position"),
        F.array(F.concat(F.lit("pmid:"), c("position"))).alias("identifiers"), none.alias("doi"),
        c("position").cast("string").alias("pmid"), c("title"), c("license"), F.lit("active").alias("status"), c("state"))
    old = old.select(second.columns).unionByName(second)
    new = view(spark, sf, "fx_citations").withColumn(
        "identifiers", idn.identifiers(c("doi_text"), c("pmid"), c("pmcid"), c("source"), c("source_id"))).withColumn(
        "notice", (c("input_pos") % 97 == 0))
    new = new.withColumn("doi", text.canonical_doi(c("doi_text")))
    return idn.merge_publications(old, new, ["doi", "pmid", "title", "license"])


MERGE = """WITH RECURSIVE item AS (
  SELECT 0 AS nw, position AS pos, publication_id, status, state, CAST(NULL AS BOOLEAN) AS notice, doi, pmid, CAST(NULL AS STRING) AS pmcid, title, CAST(NULL AS STRING) AS license, source, source_id FROM fx_publications
  UNION ALL SELECT 0, 10000000 + position, 'alt-' || position, 'active', state, NULL, NULL, CAST(position AS STRING), NULL, title, NULL, NULL, NULL FROM fx_publications WHERE position % 5 = 0
  UNION ALL SELECT 1, input_pos, NULL, status, NULL, input_pos % 97 = 0, doi_plain, pmid, pmcid, title, license, source, source_id FROM fx_citations),
link AS (SELECT nw || '#' || pos AS node, 'doi:' || doi AS id FROM item WHERE doi IS NOT NULL UNION SELECT nw || '#' || pos, 'pmid:' || pmid FROM item WHERE pmid IS NOT NULL
  UNION SELECT nw || '#' || pos, 'pmcid:' || pmcid FROM item WHERE pmcid IS NOT NULL UNION SELECT nw || '#' || pos, source || ':' || source_id FROM item WHERE source IS NOT NULL),
idedge AS (SELECT DISTINCT x.id AS a, y.id AS b FROM link x JOIN link y ON x.node = y.node),
walk AS (SELECT a AS id, b AS seen FROM idedge UNION SELECT w.id, e.b FROM walk w JOIN idedge e ON e.a = w.seen),
comp AS (SELECT id, min(seen) AS component FROM walk GROUP BY 1),
placed AS (SELECT DISTINCT i.*, m.component FROM item i JOIN link l ON l.node = i.nw || '#' || i.pos JOIN comp m ON m.id = l.id)"""


@query("publication_merge", f"""{MERGE}
SELECT coalesce(arg_min(publication_id, pos) FILTER (nw = 0),
    arg_min(least('doi:' || doi, 'pmid:' || pmid, 'pmcid:' || pmcid, source || ':' || source_id), pos) FILTER (nw = 1)) AS publication_id,
  CAST(bool_or(nw = 0) AS STRING) AS known,
  {NAME.format(f"max({RANK.format('status')})")} AS status,
  CASE WHEN bool_or(coalesce(notice, false)) THEN 'publication_notice' ELSE coalesce(arg_min(state, pos) FILTER (nw = 0), 'pending_extraction') END AS state,
  coalesce(arg_max(doi, pos) FILTER (nw = 1 AND doi IS NOT NULL), arg_min(doi, pos) FILTER (nw = 0 AND doi IS NOT NULL)) AS doi,
  coalesce(arg_max(pmid, pos) FILTER (nw = 1 AND pmid IS NOT NULL), arg_min(pmid, pos) FILTER (nw = 0 AND pmid IS NOT NULL)) AS pmid,
  coalesce(arg_max(title, pos) FILTER (nw = 1 AND title IS NOT NULL), arg_min(title, pos) FILTER (nw = 0 AND title IS NOT NULL)) AS title,
  coalesce(arg_max(license, pos) FILTER (nw = 1 AND license IS NOT NULL), arg_min(license, pos) FILTER (nw = 0 AND license IS NOT NULL)) AS license
FROM placed GROUP BY component""")
def publication_merge(spark, sf):
    return _merged(spark, sf)["records"].drop("touched").withColumn("known", F.col("known").cast("string"))


@query("publication_identifiers", f"""{MERGE}, rec AS (
  SELECT component, coalesce(arg_min(publication_id, pos) FILTER (nw = 0),
    arg_min(least('doi:' || doi, 'pmid:' || pmid, 'pmcid:' || pmcid, source || ':' || source_id), pos) FILTER (nw = 1)) AS publication_id FROM placed GROUP BY 1)
SELECT r.publication_id, c.id AS identifier FROM comp c JOIN rec r ON r.component = c.component""")
def publication_identifiers(spark, sf):
    return _merged(spark, sf)["identifiers"]


@query("publication_aliases", f"""{MERGE}, rec AS (
  SELECT component, arg_min(publication_id, pos) FILTER (nw = 0) AS publication_id FROM placed GROUP BY 1)
SELECT DISTINCT r.publication_id, p.publication_id AS alias FROM placed p JOIN rec r ON r.component = p.component
WHERE p.nw = 0 AND p.publication_id <> r.publication_id""")
def publication_aliases(spark, sf):
    return _merged(spark, sf)["aliases"]


@query("weekly_check_slots", """SELECT event_id, strftime(timezone('UTC', slot), '%Y-%m-%d %H:%M:%S') AS next_check FROM (
  SELECT event_id, timezone('Europe/Madrid', CASE WHEN d + INTERVAL 8 HOUR > l THEN d + INTERVAL 8 HOUR ELSE d + INTERVAL 176 HOUR END) AS slot FROM (
    SELECT event_id, l, date_trunc('day', l) + CAST((8 - isodow(l)) % 7 AS INTEGER) * INTERVAL 1 DAY AS d FROM (
      SELECT event_id, timezone('Europe/Madrid', timezone('UTC', ts)) AS l FROM events) a) b) c""")
def weekly_check_slots(spark, sf):
    e = view(spark, sf, "events")
    return e.select("event_id", F.date_format(dates.next_weekly_check(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("next_check"))


@query("known_dois", """SELECT DISTINCT doi FROM (SELECT doi FROM fx_publications UNION ALL SELECT doi FROM fx_documents) x""")
def known_dois(spark, sf):
    d = view(spark, sf, "fx_documents").select(F.upper("doi").alias("doi"))
    both = view(spark, sf, "fx_publications").select("doi").unionByName(d)
    return both.select(text.canonical_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()


@query("unreturned_pmids", """SELECT pmid FROM fx_publications WHERE pmid IS NOT NULL EXCEPT SELECT pmid FROM fx_citations WHERE source = 'pubmed'""")
def unreturned_pmids(spark, sf):
    """Requested ids a refresh did not return: the refresh is partial, nothing is retracted."""
    asked = view(spark, sf, "fx_publications").where("pmid is not null").select("pmid")
    return asked.exceptAll(view(spark, sf, "fx_citations").where("source = 'pubmed'").select("pmid").distinct()).distinct()


@query("publication_sources", """SELECT coalesce(doi_plain, source || ':' || source_id) AS work, source, CAST(count(*) AS BIGINT) AS n FROM fx_citations GROUP BY 1, 2""")
def publication_sources(spark, sf):
    """Sources accumulated per work, one row each."""
    c = view(spark, sf, "fx_citations")
    key = F.regexp_replace(F.when(F.col("doi_text").isNotNull(), idn.citation_key(F.col("source"), F.col("source_id"), F.col("doi_text"))).otherwise(
        F.concat_ws(":", "source", "source_id")), "^doi:", "")
    return c.groupBy(key.alias("work"), "source").agg(F.count("*").alias("n"))


@query("doi_batches", """SELECT CAST(i // 50 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(doi) AS first_doi, max(doi) AS last_doi
FROM (SELECT doi, row_number() OVER (ORDER BY doi) - 1 AS i FROM (SELECT DISTINCT doi FROM fx_publications WHERE doi IS NOT NULL) d) x GROUP BY 1""")
def doi_batches(spark, sf):
    """Known DOIs in request batches of at most fifty, however many there are."""
    known = view(spark, sf, "fx_publications").where("doi is not null").select("doi").distinct()
    return idn.batches(known, "doi", 50).groupBy("batch").agg(F.count("*").alias("n"), F.min("doi").alias("first_doi"), F.max("doi").alias("last_doi"))


@query("access_routes", """SELECT input_pos, CASE WHEN status <> 'active' THEN 'needs review' WHEN pmcid IS NOT NULL THEN 'pmc' WHEN input_pos % 3 = 0 AND doi_plain IS NOT NULL THEN 'pmc'
  WHEN doi_plain IS NOT NULL THEN 'doi' ELSE 'no identifier' END AS route,
  CASE WHEN status = 'active' THEN coalesce(pmcid, CASE WHEN input_pos % 3 = 0 AND doi_plain IS NOT NULL THEN 'PMC9' || custkey END) END AS pmcid
FROM fx_citations""")
def access_routes(spark, sf):
    from evloom.operators.projections import access_route
    c = view(spark, sf, "fx_citations").withColumn("doi", text.canonical_doi(F.col("doi_text")))
    table = c.where("input_pos % 3 = 0 and doi is not null").select(
        F.concat_ws("#", "doi", F.col("input_pos").cast("string")).alias("requested_id"), F.concat(F.lit("PMC9"), "custkey").alias("pmcid"))
    return access_route(c.withColumn("lookup", F.concat_ws("#", "doi", F.col("input_pos").cast("string"))), table).select("input_pos", "route", "pmcid")


@query("safe_links", """SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url END AS safe_url,
  CAST(url LIKE 'https://%' AS STRING) AS https FROM pages""")
def safe_links(spark, sf):
    p = view(spark, sf, "pages")
    return p.select("page_id", urls.safe_external_url(F.col("url")).alias("safe_url"),
                    urls.https_url(F.col("url")).isNotNull().cast("string").alias("https"))


@query("status_lattice", f"""SELECT a.input_pos, b.publication_id, {NAME.format(f"greatest({RANK.format("coalesce(a.status, 'active')")}, {RANK.format("coalesce(b.status, 'active')")})")} AS status
FROM fx_citations a FULL JOIN fx_publications b ON b.position = a.custkey""")
def status_lattice(spark, sf):
    """A record new to the table and a publication that no record mentions both keep what they have."""
    a = view(spark, sf, "fx_citations").select("input_pos", "custkey", "status")
    b = view(spark, sf, "fx_publications").select("publication_id", F.col("position").alias("custkey"), F.col("status").alias("prior"))
    known = lambda x: F.coalesce(F.col(x), F.lit("active"))
    return a.join(b, "custkey", "full_outer").select("input_pos", "publication_id", st.higher(known("prior"), known("status")).alias("status"))
