"""Evidence-shaped views over the analytics tables.

The views are plain SELECT text in the subset Spark SQL and ANSI databases share, so the same
view can be a DataFrame here and a common table expression in a cross-check elsewhere.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["fx_documents"] = """
SELECT concat('doc-', s_suppkey) AS document_hash, concat('10.1234/s', s_suppkey) AS doi,
       concat('fam-', s_nationkey) AS study_family, concat(s_name, '.pdf') AS filename,
       CASE s_suppkey % 10 WHEN 0 THEN 'stale' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'uploaded' ELSE 'completed' END AS status,
       s_suppkey % 20 + 1 AS pages,
       CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('pub-', s_suppkey) END AS publication_id
FROM {supplier}"""

VIEWS["fx_measurements"] = """
SELECT *, concat(CAST(value AS BIGINT), ' ', unit) AS raw_value,
       concat('mean of ', CAST(value AS BIGINT), ' ', unit, ' over n = ', n_technical, ' particles') AS excerpt
FROM (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS measurement_id,
    concat('exp-', l_partkey, '-', l_suppkey) AS experiment_id, concat('doc-', l_suppkey) AS document_hash,
    concat('doc-', l_partkey % 97 + 1) AS second_document,
    CASE l_returnflag WHEN 'A' THEN 'Droplet_Size_um' WHEN 'N' THEN 'Zeta_Potential_mV' ELSE 'Stability_Days' END AS outcome,
    CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'nm' ELSE 'um' END WHEN 'N' THEN 'mV'
         ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'hour' ELSE 'day' END END AS unit,
    l_quantity AS value,
    CASE WHEN l_linenumber = 7 THEN 'gt' WHEN l_linenumber = 6 AND l_tax = 0 THEN 'lt' ELSE 'exact' END AS qualifier,
    CASE WHEN l_linestatus = 'F' THEN 'accepted' WHEN l_orderkey % 3 = 0 THEN 'candidate'
         WHEN l_orderkey % 3 = 1 THEN 'uncertain' ELSE 'rejected' END AS status,
    CASE WHEN l_discount > 0.095 THEN 'curve_sample' WHEN l_discount > 0.085 THEN 'digitized' ELSE 'reported' END AS origin,
    CASE WHEN l_linenumber <= 4 THEN 'mean' ELSE 'median' END AS statistic,
    CASE l_suppkey % 3 WHEN 0 THEN 'laser diffraction' WHEN 1 THEN 'microscopy' ELSE CAST(NULL AS STRING) END AS measurement_method,
    CASE WHEN l_partkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(l_partkey % 3 * 7 AS DOUBLE) END AS time_value,
    CASE WHEN l_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'day' END AS time_unit,
    CASE WHEN l_partkey % 11 = 0 THEN 'mass' ELSE CAST(NULL AS STRING) END AS concentration_basis,
    'SD' AS uncertainty_type, 1.0 + l_tax * 100 AS uncertainty,
    CASE WHEN l_orderkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(l_linenumber + 1 AS BIGINT) END AS n_independent,
    CAST(l_linenumber * 3 AS BIGINT) AS n_technical, CAST(l_linenumber AS BIGINT) AS page
  FROM {lineitem}) AS shaped"""

VIEWS["fx_experiments"] = """
SELECT concat('exp-', k.l_partkey, '-', k.l_suppkey) AS experiment_id, concat('doc-', k.l_suppkey) AS document_hash,
       concat('10.1234/s', k.l_suppkey) AS doi, concat('fam-', s.s_nationkey) AS study_family, p.p_name AS sample_label,
       CASE (k.l_partkey + k.l_suppkey) % 50 WHEN 0 THEN 'retracted' WHEN 1 THEN 'corrected' ELSE 'active' END AS source_status,
       k.l_partkey AS part, k.l_suppkey AS supp, p.p_type AS oil_type, p.p_brand AS emulsion_type, p.p_size AS droplet
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) AS k
JOIN {supplier} AS s ON k.l_suppkey = s.s_suppkey JOIN {part} AS p ON k.l_partkey = p.p_partkey"""

VIEWS["fx_citations"] = """
SELECT o_orderkey AS input_pos,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'crossref' WHEN '2' THEN 'pubmed' WHEN '3' THEN 'europepmc'
       WHEN '4' THEN 'openalex' ELSE 'arxiv' END AS source,
  CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN concat('http://arxiv.org/abs/rec-', o_orderkey, 'v', o_orderkey % 3 + 1)
       ELSE concat('rec-', o_orderkey) END AS source_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('https://doi.org/10.1234/C', o_custkey)
       WHEN '2' THEN CAST(NULL AS STRING) WHEN '3' THEN concat(' doi: 10.1234/c', o_custkey)
       WHEN '4' THEN concat('10.1234/c', o_custkey) ELSE concat('10.1234/PRE', o_custkey) END AS doi_text,
  CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN CAST(NULL AS STRING) WHEN '5' THEN concat('10.1234/pre', o_custkey)
       ELSE concat('10.1234/c', o_custkey) END AS doi_plain,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN CAST(o_custkey AS STRING) ELSE CAST(NULL AS STRING) END AS pmid,
  CASE WHEN substr(o_orderpriority, 1, 1) = '2' AND o_orderkey % 4 = 0 THEN concat('PMC', o_custkey) ELSE CAST(NULL AS STRING) END AS pmcid,
  concat('Study ', o_orderkey) AS title, substr(o_orderpriority, 1, 1) = '5' AS is_preprint,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('abstract ', o_orderkey) ELSE CAST(NULL AS STRING) END AS abstract,
  CASE WHEN o_orderkey % 5 = 0 THEN 'cc-by' WHEN o_orderkey % 5 = 1 THEN '' ELSE CAST(NULL AS STRING) END AS license,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('https://example.org/', o_orderkey) ELSE CAST(NULL AS STRING) END AS full_text_url,
  CASE WHEN substr(o_orderpriority, 1, 1) = '5' AND o_orderkey % 3 = 0 THEN concat('10.1234/c', o_custkey) ELSE CAST(NULL AS STRING) END AS related_doi,
  CASE WHEN o_orderkey % 50 = 0 THEN 'retracted' WHEN o_orderkey % 50 = 1 THEN 'withdrawn'
       WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 'corrected' ELSE 'active' END AS status,
  o_custkey AS custkey, CAST(o_orderdate AS DATE) AS updated_on
FROM {orders}"""

VIEWS["fx_publications"] = """
SELECT concat('pub-', c_custkey) AS publication_id, c_custkey AS position, concat('10.1234/c', c_custkey) AS doi,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) ELSE CAST(NULL AS STRING) END AS pmid,
       concat(c_name, ' report') AS title, 'crossref' AS source, concat('reg-', c_custkey) AS source_id,
       CASE WHEN c_custkey % 40 = 0 THEN 'retracted' WHEN c_custkey % 40 = 1 THEN 'corrected' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 4 = 0 THEN 'pending_extraction' ELSE 'extracted' END AS state
FROM {customer}"""

VIEWS["fx_notices"] = """
SELECT event_id AS notice_id, concat('10.1234/c', user_id) AS target_doi, CAST(user_id AS STRING) AS target_pmid,
       CASE event_type WHEN 'error' THEN 'retracted' WHEN 'signup' THEN 'corrected' WHEN 'purchase' THEN 'concern'
            WHEN 'click' THEN 'withdrawn' ELSE 'active' END AS status,
       CASE event_type WHEN 'error' THEN 'RetractionOf' WHEN 'signup' THEN 'ErratumFor' WHEN 'purchase' THEN 'ExpressionOfConcernFor'
            ELSE 'UpdateOf' END AS relation,
       CASE WHEN event_id % 4 = 0 THEN 'updated_by' ELSE 'updates' END AS direction, ts
FROM {events}"""

VIEWS["fx_pages"] = """
SELECT concat('text-', doc_id) AS document_hash, CAST(1 AS BIGINT) AS page, text, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height,
       CASE WHEN doc_id % 20 = 0 THEN 'ocr_requires_review' ELSE 'extracted' END AS text_status,
       concat('page-1-table-', doc_id % 3 + 1) AS table_id
FROM {documents}"""

VIEWS["fx_decisions"] = """
SELECT d.source AS study_family, CAST(d.doc_id AS STRING) AS experiment_id, d.lang AS field,
       CASE WHEN d.doc_id % 11 = 0 THEN CAST(NULL AS STRING) ELSE 'reviewer' END AS reviewer, 'p. 1' AS source_locator,
       l.quality = 1 AS correct, l.toxic = 0 AS recoverable, d.n_chars % 3 > 0 AS accepted, d.n_chars % 3 = 0 AS abstained,
       d.doc_id % 7 = 0 AS additional_to_manual,
       CASE d.lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'table' WHEN 'de' THEN 'figure' ELSE 'microscopy' END AS source_type
FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id"""

VIEWS["fx_reference_rows"] = """
SELECT p_partkey AS reference_row_id, concat('10.1234/s', p_partkey % 100 + 1) AS doi, p_type AS oil_type, p_brand AS emulsion_type,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 17 = 0 THEN concat('>', p_size)
            ELSE CAST(p_size AS STRING) END AS droplet_um, p_name AS label
FROM {part}"""

VIEWS["fx_contrast_pairs"] = """
SELECT concat('analysis-', l.l_suppkey % 10) AS analysis_id, concat(l.l_orderkey, '-', l.l_linenumber, '-', l.l_partkey, '-', l.l_suppkey) AS contrast_id,
       concat('fam-', l.l_orderkey) AS study_family, l.l_quantity + 1.0 AS mean_t, 1.0 + l.l_tax * 100 AS sd_t, CAST(l.l_linenumber + 1 AS BIGINT) AS n_t,
       CAST(p.p_size AS DOUBLE) AS mean_c, 1.0 + l.l_discount * 100 AS sd_c, CAST(l.l_partkey % 9 + 1 AS BIGINT) AS n_c
FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey WHERE l.l_linestatus = 'F'"""

VIEWS["fx_usage_calls"] = """
SELECT o_orderkey AS call_id, o_custkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'small' ELSE 'large' END AS model,
       o_orderkey AS input_tokens, CAST(floor(o_totalprice) AS BIGINT) AS output_tokens,
       CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'reserved' ELSE 'failed' END AS status
FROM {orders}"""

VIEWS["fx_boxes"] = """
SELECT l_orderkey AS page_key, l_linenumber AS box_no, l_quantity * 10 AS x0, CAST(l_linenumber * 40 AS DOUBLE) AS y0,
       l_quantity * 10 + 20 + l_tax * 500 AS x1, CAST(l_linenumber * 40 AS DOUBLE) + 25 + l_discount * 300 AS y1,
       CASE l_returnflag WHEN 'A' THEN 'vector' WHEN 'N' THEN 'table' ELSE 'raster' END AS kind,
       concat('w', CAST(l_quantity AS BIGINT) % 7) AS word, l_extendedprice AS tie, l_partkey AS tie2
FROM {lineitem}"""

VIEWS["fx_jobs"] = """
SELECT concat('job-', o_orderkey) AS job_id, concat('doc-', o_custkey) AS document_hash,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 9 = 0 THEN 'abstained' WHEN o_orderstatus = 'P' THEN 'failed'
            ELSE CASE WHEN o_custkey % 3 = 0 THEN 'pending' ELSE 'completed' END END AS status,
       CAST(o_orderdate AS DATE) AS completed_on
FROM {orders}"""


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(n for _, n, _, _ in string.Formatter().parse(text) if n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a base table as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _names(text)})


def ctes(names: list[str]) -> str:
    """The named views as common table expressions over tables of the same base names."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in VIEWS:
            return
        for inner in _names(VIEWS[name]):
            add(inner)
        done[name] = VIEWS[name].format(**{n: n for n in _names(VIEWS[name])})

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({text})" for name, text in done.items())
