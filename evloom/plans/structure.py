"""Structure queries: figures, page geometry, article elements, provider records, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.functions import text
from evloom.operators import figures as fig
from evloom.operators import structure as sx
from evloom.plans.fixtures import VIEWS, table, view
from evloom.plans.registry import query, sql_stable, stable
from evloom.sources import files, providers


def _ticks(spark, sf):
    """One axis per part: ticks at even pixels, every seventh axis broken, every fifth logarithmic."""
    c = F.col
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
    value = F.when(c("p_partkey") % 5 == 0, F.pow(F.lit(10.0), c("i"))).when((c("p_partkey") % 7 == 0) & (c("i") == 5), F.lit(0.5)).otherwise(c("i") * c("p_size"))
    return p.select(c("p_partkey").alias("axis_id"), F.when(c("p_partkey") % 5 == 0, "log").otherwise("linear").alias("scale"), (c("i") * 40.0).alias("pixel"), value.cast("double").alias("value"))


@query("calibrated_axes", f"""SELECT p_partkey AS axis_id, CASE WHEN p_partkey % 5 = 0 THEN 'log' ELSE 'linear' END AS scale,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'tick values are not monotonic' END AS reason,
  CASE WHEN p_partkey % 5 = 0 THEN {sql_stable('1 / 40.0')} WHEN p_partkey % 7 = 0 THEN NULL ELSE {sql_stable('p_size / 40.0')} END AS slope,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 <> 0 THEN {sql_stable('0.0')} END AS intercept FROM part""")
def calibrated_axes(spark, sf):
    a = fig.calibrate_axes(_ticks(spark, sf), ["axis_id"])
    ok = F.col("reason").isNull()
    return a.select("axis_id", "scale", "reason", F.when(ok, stable(F.col("slope"))).alias("slope"), F.when(ok, stable(F.col("intercept"))).alias("intercept"))


def _points(spark, sf):
    c = F.col
    p = table(spark, sf, "part").where("p_partkey % 5 <> 0")
    axis = lambda name, slope: p.select(c("p_partkey").alias("figure"), F.lit(name).alias("axis"), F.lit(slope).alias("slope"), F.lit(1.0).alias("intercept"), F.lit("linear").alias("scale"),
                                        F.lit(0.0).alias("pixel_min"), F.lit(500.0).alias("pixel_max"), F.lit(None).cast("string").alias("reason"))
    axes = axis("x", 0.5).unionByName(axis("y", 2.0))
    l = table(spark, sf, "lineitem")
    pts = l.select(c("l_partkey").alias("figure"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("point"), (c("l_quantity") * 11).alias("x_pixel"),
                   (c("l_linenumber") * 50.0).alias("y_pixel"), F.when(c("l_returnflag") != "A", c("l_linenumber") * 50.0 - 10).alias("lower_y_pixel"),
                   F.when(c("l_returnflag") != "A", c("l_linenumber") * 50.0 + 10).alias("upper_y_pixel"), F.lit("size").alias("outcome"), F.lit("um").alias("unit"), F.lit("digitized").alias("origin"),
                   F.when(c("l_returnflag") == "N", "SD").when(c("l_returnflag") == "R", "CI").otherwise("SE").alias("uncertainty_type"),
                   F.when(c("l_linenumber") % 2 == 0, "Bars are standard deviation").otherwise("Droplets").alias("caption"))
    return fig.digitize(pts, axes)


@query("digitized_points", f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_quantity) AS point, l_partkey AS figure,
  CASE WHEN l_partkey % 5 = 0 OR p_partkey IS NULL THEN 'axis is not calibrated' WHEN l_quantity * 11 > 500 THEN 'point outside the ticks' END AS reason,
  CASE WHEN l_partkey % 5 <> 0 AND p_partkey IS NOT NULL AND l_quantity * 11 <= 500 THEN {sql_stable('l_quantity * 5.5 + 1')} END AS x,
  CASE WHEN l_partkey % 5 <> 0 AND p_partkey IS NOT NULL AND l_quantity * 11 <= 500 THEN {sql_stable('l_linenumber * 100.0 + 1')} END AS y,
  CASE WHEN l_partkey % 5 <> 0 AND p_partkey IS NOT NULL AND l_quantity * 11 <= 500 AND l_returnflag <> 'A' THEN {sql_stable('l_linenumber * 100.0 - 19')} END AS lower FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def digitized_points(spark, sf):
    d = _points(spark, sf)
    return d.select("point", "figure", "reason", *[stable(F.col(x)).alias(x) for x in ("x", "y", "lower")])


@query("point_measurements", """SELECT CASE WHEN l_returnflag = 'R' THEN 'CI' WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'SD' ELSE 'unknown' END AS uncertainty_type,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_spread,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS with_bounds
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 5 <> 0 AND l_quantity * 11 <= 500 GROUP BY 1""")
def point_measurements(spark, sf):
    m = fig.point_measurements(_points(spark, sf))
    return m.groupBy("uncertainty_type").agg(F.count("*").alias("n"), F.count("uncertainty").alias("with_spread"), F.count("lower_bound").alias("with_bounds"))


@query("supported_ticks", """SELECT count(*) AS n, CAST(sum(t.box_no) AS BIGINT) AS checksum FROM fx_boxes t WHERE EXISTS (SELECT 1 FROM fx_boxes w WHERE w.page_key = t.page_key AND w.word = t.word
  AND (t.x0 + 5) BETWEEN w.x0 - 8 AND w.x1 + 8 AND (abs(w.y0 - 200) < 70 OR abs(w.y1 - 40) < 70))""")
def supported_ticks(spark, sf):
    b = view(spark, sf, "fx_boxes")
    ticks = b.select("page_key", "box_no", F.lit("x").alias("axis"), F.concat(F.lit(" "), F.upper("word")).alias("label"), (F.col("x0") + 5).alias("pixel"),
                     F.lit(0.0).alias("bx0"), F.lit(40.0).alias("by0"), F.lit(600.0).alias("bx1"), F.lit(200.0).alias("by1"))
    return fig.supported_ticks(ticks, b).agg(F.count("*").alias("n"), F.sum("box_no").cast("bigint").alias("checksum"))


BOX_ID = "concat_ws('-', page_key, box_no, tie, tie2)"


@query("uncovered_regions", """SELECT count(*) AS n, CAST(sum(v.box_no) AS BIGINT) AS checksum FROM fx_boxes v WHERE v.kind = 'vector' AND NOT EXISTS (
  SELECT 1 FROM fx_boxes o WHERE o.page_key = v.page_key AND o.kind <> 'vector' AND least((v.x1 - v.x0) * (v.y1 - v.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0
  AND greatest(0.0, least(v.x1, o.x1) - greatest(v.x0, o.x0)) * greatest(0.0, least(v.y1, o.y1) - greatest(v.y0, o.y0)) / least((v.x1 - v.x0) * (v.y1 - v.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0.65)""")
def uncovered_regions(spark, sf):
    b = view(spark, sf, "fx_boxes").withColumn("box_id", F.expr(BOX_ID))
    left = fig.uncovered(b.where("kind = 'vector'"), b.where("kind <> 'vector'"))
    return left.agg(F.count("*").alias("n"), F.sum("box_no").cast("bigint").alias("checksum"))


# every box becomes the bounding box of all boxes near it, on every page until its boxes stay as they are; what is left is not near each other
REGIONS = """WITH RECURSIVE r AS (SELECT DISTINCT 0 AS step, page_key, x0, y0, x1, y1 FROM fx_boxes WHERE x1 > x0 OR y1 > y0
  UNION ALL SELECT DISTINCT step, page_key, x0, y0, x1, y1 FROM (
    SELECT step + 1 AS step, page_key, nx0 AS x0, ny0 AS y0, nx1 AS x1, ny1 AS y1, max(CASE WHEN nx0 < x0 OR ny0 < y0 OR nx1 > x1 OR ny1 > y1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_key) AS moved
    FROM (SELECT a.step, a.page_key, a.x0, a.y0, a.x1, a.y1, min(b.x0) AS nx0, min(b.y0) AS ny0, max(b.x1) AS nx1, max(b.y1) AS ny1 FROM r a JOIN r b
      ON b.page_key = a.page_key AND a.x0 <= b.x1 + 10 AND a.x1 >= b.x0 - 10 AND a.y0 <= b.y1 + 10 AND a.y1 >= b.y0 - 10 GROUP BY 1, 2, 3, 4, 5, 6) g) h WHERE moved = 1),
last AS (SELECT page_key, max(step) AS step FROM r GROUP BY 1)
SELECT r.page_key, x0, y0, x1, y1 FROM r JOIN last ON last.page_key = r.page_key AND last.step = r.step WHERE x1 - x0 >= 30 AND y1 - y0 >= 30"""


@query("merged_regions", REGIONS)
def merged_regions(spark, sf):
    return fig.merge_regions(view(spark, sf, "fx_boxes").select("page_key", "x0", "y0", "x1", "y1"))


@query("clipped_boxes", f"""SELECT CAST(count(*) AS BIGINT) AS n, {sql_stable('sum(least(x1, 480.0))', 3)} AS right_edges, CAST(sum(CASE WHEN least(x1, 480.0) - x0 >= 20 AND least(y1, 300.0) - y0 >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM fx_boxes""")
def clipped_boxes(spark, sf):
    b = fig.clip_boxes(view(spark, sf, "fx_boxes"), F.lit(480.0), F.lit(300.0))
    return b.agg(F.count("*").alias("n"), stable(F.sum("x1"), 3).alias("right_edges"), F.sum(((F.col("x1") - F.col("x0") >= 20) & (F.col("y1") - F.col("y0") >= 20)).cast("bigint")).alias("large"))


@query("word_boxes", f"""SELECT word, CAST(count(*) AS BIGINT) AS n, {sql_stable('sum(x0 * 2)', 3)} AS sx, {sql_stable('sum(y1 * 1.5)', 3)} AS sy FROM fx_boxes GROUP BY 1""")
def word_boxes(spark, sf):
    b = view(spark, sf, "fx_boxes")
    pages = b.select("page_key", F.lit(1200.0).alias("pixel_width"), F.lit(600.0).alias("width"), F.lit(1200.0).alias("pixel_height"), F.lit(800.0).alias("height")).distinct()
    return fig.word_boxes(b, pages).groupBy("word").agg(F.count("*").alias("n"), stable(F.sum("x0"), 3).alias("sx"), stable(F.sum("y1"), 3).alias("sy"))


@query("object_diameters", f"""WITH o AS (SELECT l_orderkey AS figure, l_quantity AS w, l_linenumber * 10 AS h, l_quantity * l_linenumber * 10 * 0.8 AS area, l_partkey FROM lineitem WHERE l_suppkey % 9 <> 0),
k AS (SELECT * FROM o WHERE area BETWEEN 12 AND 100000 AND least(w, h) / greatest(w, h) >= 0.45)
SELECT figure, CAST(count(*) AS BIGINT) AS n_technical, {sql_stable('sum(sqrt(4 * area / 3.141592653589793) * 10 / 50)', 4)} AS diameters FROM k GROUP BY 1""")
def object_diameters(spark, sf):
    c = F.col
    l = table(spark, sf, "lineitem")
    edge = F.when(c("l_suppkey") % 9 == 0, 0.0).otherwise(5.0)
    o = l.select(c("l_orderkey").alias("figure"), c("l_partkey").alias("object"), (c("l_quantity") * c("l_linenumber") * 10 * 0.8).alias("area"), edge.alias("x0"), F.lit(5.0).alias("y0"),
                 (edge + c("l_quantity") - 1).alias("x1"), (F.lit(4.0) + c("l_linenumber") * 10).alias("y1"), F.lit(1000.0).alias("region_width"), F.lit(1000.0).alias("region_height"),
                 F.lit(12.0).alias("min_area"), F.lit(100000.0).alias("max_area"), F.lit(10.0).alias("scale_value"), F.lit(50.0).alias("scale_pixels"))
    return fig.object_diameters(o).groupBy("figure").agg(F.max("n_technical").alias("n_technical"), stable(F.sum("diameter"), 4).alias("diameters"))


@query("tick_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity * 1000 - 1 WHEN l_linenumber % 3 = 1 THEN l_quantity * 1000 END AS value,
  CASE WHEN l_linenumber % 3 = 2 THEN 'um' END AS scale_unit FROM lineitem""")
def tick_numbers(spark, sf):
    c = F.col
    k, q = c("l_linenumber") % 3, c("l_quantity").cast("bigint").cast("string")
    label = F.when(k == 0, F.concat(F.lit(" −"), q, F.lit(",001 "))).when(k == 1, F.concat(q, F.lit(",000"))).otherwise(F.concat(q, F.lit(" um")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.tick_number(label).alias("value"), text.scale_label(label)["unit"].alias("scale_unit"))


@query("scanned_files", """SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(2 AS BIGINT) AS copies FROM documents GROUP BY 1""")
def scanned_files(spark, sf, rows_per_file=50_000):
    """Documents of each source land as XML files, in two folders; the scan finds every content once, with both copies.

    ``rows_per_file`` rows (about 5 MB) at most go to a file, far below the size at which a scan leaves one out, and
    tasks are dealt by document, so that a large source is many tasks. The number of a row keeps contents apart.
    """
    from evloom.session import scratch_path
    root = scratch_path(spark, "folder")
    d = table(spark, sf, "documents").select(F.col("source").alias("folder"), "source", "doc_id")
    rows = (d.repartition(max(1, -(-d.count() // rows_per_file)), "doc_id").sortWithinPartitions("folder", "doc_id")
            .withColumn("row", F.monotonically_increasing_id()))
    for name in ("first", "second"):
        rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("folder").format("xml").option("rowTag", "document").save(f"{root}/{name}")
    found = files.scan_folder(spark, root).where("reason is null")
    inside = spark.read.format("xml").schema("doc_id bigint, source string").option("rowTag", "document").load(f"{root}/first")
    per = inside.withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/+", "/")).groupBy("path", "source").agg(F.count("*").alias("documents"))
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(per, "path").groupBy("source", "copies").agg(
        F.sum("documents").alias("documents")).select("source", "documents", "copies")


@query("nested_dataset", """SELECT o_orderkey AS experiment, CAST(count(*) AS BIGINT) AS measurements, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_dataset(spark, sf, orders_per_file=10_000):
    """Orders with their lines written as nested datasets and read back through the versioned loader.

    A dataset is a file, which is listed, opened and parsed as one record: ``orders_per_file`` keys are about 2 MB, so that files
    are few beside the rows and one still fits a task.
    """
    from evloom.session import scratch_path
    line = F.struct(F.col("l_linenumber").cast("bigint").alias("measurement"), F.col("l_quantity").cast("bigint").alias("value"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("measurements"))
    experiments = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey")
    # one dataset per file, with the experiments of a slice of the order keys
    sets = experiments.groupBy(F.floor(F.col("o_orderkey") / orders_per_file).alias("name")).agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("experiment"), "measurements")).alias("experiments")).withColumn("schema_version", F.lit(2))
    path = scratch_path(spark, "dataset")
    sets.write.option("maxRecordsPerFile", 1).json(path)
    back = files.read_dataset(spark, path, "experiments array<struct<experiment:bigint,measurements:array<struct<measurement:bigint,value:bigint>>>>")
    flat = back.select(F.explode("experiments").alias("e")).select("e.experiment", F.explode("e.measurements").alias("m"))
    return flat.groupBy("experiment").agg(F.count("*").alias("measurements"), F.sum("m.value").cast("bigint").alias("total"))


# ---- articles -----------------------------------------------------------------------------------


def articles(spark, sf):
    """Every document as an article: one section, a paragraph per line, a table and a figure."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f￾￿]", " ")
    paragraphs = F.array_join(F.transform(F.split(clean, "\n"), lambda p: F.concat(F.lit("<p>"), esc(p), F.lit("</p>"))), "")
    body = F.concat(F.lit("<article><front><article-meta><article-id pub-id-type=\"doi\">https://doi.org/10.1234/A"), "doc_id", F.lit("</article-id><article-id pub-id-type=\"pmc\">"), "doc_id",
                    F.lit("</article-id><title-group><article-title>Document <i>"), "doc_id", F.lit("</i></article-title></title-group></article-meta></front><body><sec id=\"s1\">"), paragraphs,
                    F.lit("</sec><table-wrap id=\"t1\"><caption><p>Sizes</p></caption><table><tr><th>n</th><td colspan=\"2\">"), F.col("n_chars").cast("string"),
                    F.lit("</td></tr></table></table-wrap><fig><graphic href=\"f1.png\"/><graphic href=\"../f2.png\"/></fig></body></article>"))
    return table(spark, sf, "documents").select(F.concat(F.lit("text-"), "doc_id").alias("document_hash"), body.alias("content"))


@query("article_paragraphs", """SELECT 'text-' || doc_id AS document_hash, CAST(len(p) AS BIGINT) + 1 AS paragraphs, '/article/body[1]' AS unit_element,
  CAST(list_sum(list_transform(p, lambda s: length(trim(regexp_replace(s, '[\\s\\x0b-\\x1f\\x85\\xa0\\x{2028}\\x{2029}\\x{3000}\\x{2000}-\\x{200a}]+', ' ', 'g'))))) + 5 AS BIGINT) AS characters
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) x""")
def article_paragraphs(spark, sf):
    e = files.article_elements(articles(spark, sf)).where("tag = 'p'")
    return e.groupBy("document_hash", "unit_element").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"))


@query("article_unit_texts", """SELECT 'text-' || doc_id AS document_hash, '/article/body[1]' AS unit_element, CAST(1 + len(string_split(text, chr(10))) + 2 AS BIGINT) AS lines,
  CAST(contains(text, 'Sizes') OR true AS STRING) AS has_table_value FROM documents""")
def article_unit_texts(spark, sf):
    u = files.unit_texts(files.article_elements(articles(spark, sf)))
    value = F.regexp_extract("text", r"Sizes n (\d+)\n[^\n]*\z", 1)
    return u.select("document_hash", "unit_element", F.size(F.split("text", "\n")).cast("long").alias("lines"), (value != "").cast("string").alias("has_table_value"))


@query("article_cells", """SELECT 'text-' || doc_id AS document_hash, CASE k WHEN 0 THEN '/article/body[1]/table-wrap[1]' END AS none, 't1' AS table_locator, CASE k WHEN 0 THEN 'th' ELSE 'td' END AS tag,
  CASE k WHEN 0 THEN 'n' ELSE CAST(n_chars AS STRING) END AS cell, CASE k WHEN 0 THEN '1' ELSE '2' END AS colspan FROM documents, (VALUES (0), (1)) v(k)""".replace("CASE k WHEN 0 THEN '/article/body[1]/table-wrap[1]' END AS none, ", ""))
def article_cells(spark, sf):
    e = files.article_elements(articles(spark, sf)).where("kind = 'cell'")
    return e.select("document_hash", "table_locator", "tag", F.col("text").alias("cell"), "colspan")


@query("article_identifiers", """SELECT 'text-' || doc_id AS document_hash, '10.1234/a' || doc_id AS doi, 'PMC' || doc_id AS pmcid, 'Document ' || doc_id AS title FROM documents""")
def article_identifiers(spark, sf):
    return files.article_identifiers(files.article_elements(articles(spark, sf))).select("document_hash", "doi", "pmcid", "title")


@query("article_assets", """SELECT 'text-' || doc_id AS document_hash, '/article/body[1]/fig[1]' AS locator, 'f1.png' AS asset_ref FROM documents""")
def article_assets(spark, sf):
    return files.safe_asset_refs(files.article_elements(articles(spark, sf)))


@query("element_evidence", """SELECT doc_id AS observation_id, CAST(doc_id % 4 = 1 OR (doc_id % 4 = 2) AS STRING) AS unsupported, CAST(doc_id % 10 = 0 AS STRING) AS has_box FROM documents""")
def element_evidence(spark, sf):
    """Each document cites its title cell: right, altered, or under another document's hash."""
    from evloom.operators import verification as ver
    c = F.col
    e = files.article_elements(articles(spark, sf)).where("tag = 'th'").select("document_hash", "locator", "text", F.col("unit_element"))
    d = table(spark, sf, "documents")
    h = F.concat(F.lit("text-"), "doc_id")
    o = d.select(c("doc_id").alias("observation_id"), h.alias("expected_hash"), F.lit("/article/body[1]").alias("unit_element"),
                 F.when(c("doc_id") % 4 == 1, "text-none").otherwise(h).alias("document_hash"), F.lit("xml").alias("source_format"), F.lit(None).cast("bigint").alias("page"),
                 F.lit("/article/body[1]/table-wrap[1]/table[1]/tr[1]/th[1]").alias("p"), F.when(c("doc_id") % 4 == 2, "invented").otherwise("N").alias("excerpt"),
                 F.when(c("doc_id") % 10 == 0, F.array(F.lit(0.0))).alias("bounding_box"))
    loc = e.select("document_hash", "locator").withColumnRenamed("document_hash", "__h")
    o = o.join(loc, o["expected_hash"] == loc["__h"], "left").withColumn("xml_element", F.coalesce("locator", "p")).drop("p", "locator", "__h")
    v = ver.verify_elements(o, e)
    return v.select("observation_id", c("unsupported").cast("string").alias("unsupported"), c("has_box").cast("string").alias("has_box"))


# ---- provider records ---------------------------------------------------------------------------


def _item(spark, sf, source, build, schema):
    """Landed JSON text derived from the citations of one source, parsed with the provider's schema."""
    c = view(spark, sf, "fx_citations").where(F.col("source") == source)
    return c.select("input_pos", F.to_json(build).alias("json")).select("input_pos", F.from_json("json", schema).alias("item"))


@query("crossref_records", """SELECT doi_plain AS source_id, doi_plain AS doi, title, 'Ada Byron' AS authors, CAST(2000 + input_pos % 20 AS BIGINT) AS year,
  CASE WHEN input_pos % 5 = 0 THEN 'corrected' ELSE 'active' END AS status, CAST(CASE WHEN input_pos % 5 = 0 OR input_pos % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS relations,
  CAST(CASE WHEN input_pos % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS related FROM fx_citations WHERE source = 'crossref'""")
def crossref_records(spark, sf):
    c = F.col
    k = c("input_pos")
    update = F.when(k % 5 == 0, F.array(F.struct(F.lit("correction").alias("type"), c("doi_text").alias("DOI")))).when(
        k % 5 == 1, F.array(F.struct(F.lit("retraction").alias("type"), F.concat(F.lit("10.1234/old"), k).alias("DOI")))).when(
        k % 5 == 2, F.array(F.struct(F.lit("addendum").alias("type"), c("doi_text").alias("DOI"))))
    build = F.struct(c("doi_text").alias("DOI"), F.array("title").alias("title"), F.array(F.struct(F.lit("Ada").alias("given"), F.lit("Byron").alias("family"))).alias("author"),
                     F.struct(F.array(F.array((2000 + k % 20).cast("int"))).alias("date-parts")).alias("issued"), update.alias("update-to"),
                     F.struct(F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("doi:10.1234/PRE"), k).alias("id")))).alias("has-preprint")).alias("relation"))
    r = providers.crossref(_item(spark, sf, "crossref", build, providers.CROSSREF_ITEM))
    return r.select("source_id", "doi", "title", F.array_join("authors", ";").alias("authors"), c("year").cast("bigint").alias("year"), "status",
                    F.size("update_relations").cast("bigint").alias("relations"), F.size("related_dois").cast("bigint").alias("related"))


@query("crossref_notice_dois", """SELECT DISTINCT doi_plain AS doi FROM fx_citations WHERE source = 'crossref' AND input_pos % 5 = 1""")
def crossref_notice_dois(spark, sf):
    c = F.col
    k = c("input_pos")
    update = F.when(k % 5 == 0, F.array(F.struct(F.lit("correction").alias("type"), c("doi_text").alias("DOI")))).when(
        k % 5 == 1, F.array(F.struct(F.lit("retraction").alias("type"), F.concat(F.lit("10.1234/old"), k).alias("DOI"))))
    build = F.struct(c("doi_text").alias("DOI"), update.alias("update-to"))
    return providers.crossref_notice_dois(_item(spark, sf, "crossref", build, providers.CROSSREF_ITEM))


@query("openalex_records", """SELECT source_id, doi_plain AS doi, title, 'stable drops of oil' AS abstract, CASE WHEN input_pos % 4 = 0 THEN 'retracted' ELSE 'active' END AS status, CAST(input_pos % 3 = 0 AS STRING) AS is_preprint,
  CASE WHEN input_pos % 2 = 0 THEN 'https://x.org/a.pdf' ELSE 'https://x.org/a' END AS full_text_url FROM fx_citations WHERE source = 'openalex'""")
def openalex_records(spark, sf):
    c = F.col
    k = c("input_pos")
    index = F.create_map(F.lit("of"), F.array(F.lit(2)), F.lit("drops"), F.array(F.lit(1)), F.lit("stable"), F.array(F.lit(0)), F.lit("oil"), F.array(F.lit(3)))
    place = F.struct(F.when(k % 2 == 0, "https://x.org/a.pdf").alias("pdf_url"), F.lit("https://x.org/a").alias("landing_page_url"))
    build = F.struct(c("source_id").alias("id"), F.concat(F.lit("https://doi.org/"), F.upper("doi_text")).alias("doi"), c("title").alias("display_name"), (k % 4 == 0).alias("is_retracted"),
                     F.when(k % 3 == 0, "preprint").otherwise("article").alias("type"), index.alias("abstract_inverted_index"), place.alias("best_oa_location"))
    r = providers.openalex(_item(spark, sf, "openalex", build, providers.OPENALEX_ITEM))
    return r.select("source_id", "doi", "title", "abstract", "status", c("is_preprint").cast("string").alias("is_preprint"), "full_text_url")


@query("europepmc_records", """SELECT CASE WHEN input_pos % 3 = 0 THEN 'MED:' || input_pos WHEN input_pos % 3 = 1 THEN 'PMC:' || input_pos ELSE 'PPR:PPR' || input_pos END AS source_id,
  CASE WHEN input_pos % 3 = 0 THEN CAST(input_pos AS STRING) END AS pmid, CASE WHEN input_pos % 3 = 1 THEN 'PMC' || input_pos END AS pmcid, doi_plain AS doi, CAST(input_pos % 3 = 2 AS STRING) AS is_preprint,
  CASE WHEN input_pos % 4 = 0 THEN 'retracted' ELSE 'active' END AS status, 'https://free.org' AS full_text_url, CAST(2001 AS BIGINT) AS year FROM fx_citations WHERE source = 'europepmc'""")
def europepmc_records(spark, sf):
    c = F.col
    k = c("input_pos")
    urls = F.array(F.struct(F.lit("S").alias("availabilityCode"), F.lit("https://paid.org").alias("url")), F.struct(F.lit("OA").alias("availabilityCode"), F.lit("https://free.org").alias("url")))
    build = F.struct(F.when(k % 3 == 2, F.concat(F.lit("PPR"), k)).otherwise(k.cast("string")).alias("id"), F.when(k % 3 == 0, "MED").when(k % 3 == 1, "PMC").otherwise("PPR").alias("source"),
                     c("doi_text").alias("doi"), F.lit("2001").alias("pubYear"), F.when(k % 4 == 0, "Y").otherwise("N").alias("isRetracted"), F.struct(urls.alias("fullTextUrl")).alias("fullTextUrlList"))
    r = providers.europepmc(_item(spark, sf, "europepmc", build, providers.EUROPEPMC_ITEM))
    return r.select("source_id", "pmid", "pmcid", "doi", c("is_preprint").cast("string").alias("is_preprint"), "status", "full_text_url", c("year").cast("bigint").alias("year"))


@query("europepmc_dates", """SELECT 'MED:' || input_pos AS record_id, CAST(updated_on AS STRING) AS first_indexed_at FROM fx_citations WHERE source = 'europepmc'""")
def europepmc_dates(spark, sf):
    build = F.struct(F.col("input_pos").cast("string").alias("id"), F.lit("MED").alias("source"), F.col("updated_on").cast("string").alias("firstIndexDate"))
    return providers.europepmc_dates(_item(spark, sf, "europepmc", build, providers.EUROPEPMC_ITEM)).select("record_id", "first_indexed_at")


@query("scopus_records", """SELECT source_id, doi_plain AS doi, title, CAST(year(updated_on) AS BIGINT) AS year FROM fx_citations WHERE source = 'openalex'""")
def scopus_records(spark, sf):
    c = F.col
    build = F.struct(c("source_id").alias("dc:identifier"), c("doi_text").alias("prism:doi"), c("title").alias("dc:title"), c("updated_on").cast("string").alias("prism:coverDate"))
    r = providers.scopus(_item(spark, sf, "openalex", build, providers.SCOPUS_ITEM))
    return r.select("source_id", "doi", "title", c("year").cast("bigint").alias("year"))


@query("pubmed_records", """SELECT CAST(input_pos AS STRING) AS pmid, '10.1234/x' || input_pos AS doi, 'PMC' || input_pos AS pmcid, title, 'Part one.' || chr(10) || 'Part two.' AS abstract,
  CASE WHEN input_pos % 6 = 0 THEN 'retracted' WHEN input_pos % 6 = 1 THEN 'corrected' ELSE 'active' END AS status, CASE WHEN input_pos % 6 <= 2 THEN CASE WHEN input_pos % 6 = 2 THEN 'updates' WHEN input_pos % 6 = 1 THEN 'updated_by' ELSE '' END ELSE '' END AS directions,
  '2020-1-05' AS updated_at, CAST(2019 AS BIGINT) AS year FROM fx_citations WHERE source = 'pubmed'""")
def pubmed_records(spark, sf):
    c = F.col
    k = c("input_pos").cast("string")
    link = F.when(c("input_pos") % 6 == 1, '<CommentsCorrectionsList><CommentsCorrections RefType="ErratumIn"><PMID>9</PMID></CommentsCorrections></CommentsCorrectionsList>').when(
        c("input_pos") % 6 == 2, '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionOf"><PMID>8</PMID></CommentsCorrections><CommentsCorrections RefType="Cites"><PMID>7</PMID></CommentsCorrections></CommentsCorrectionsList>').otherwise("")
    kind = F.when(c("input_pos") % 6 == 0, "Retracted Publication").otherwise("Journal Article")
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID><DateRevised><Year>2020</Year><Month>1</Month><Day>05</Day></DateRevised><Article><Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal><ArticleTitle>"),
                   c("title"), F.lit("</ArticleTitle><Abstract><AbstractText>Part one.</AbstractText><AbstractText>Part two.</AbstractText></Abstract><PublicationTypeList><PublicationType>"), kind,
                   F.lit("</PublicationType></PublicationTypeList></Article>"), link, F.lit('</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1234/X'), k,
                   F.lit('</ArticleId><ArticleId IdType="pmc">PMC'), k, F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    pages = view(spark, sf, "fx_citations").where("source = 'pubmed'").select(F.from_xml(xml, providers.PUBMED_ARTICLE, {"rowTag": "PubmedArticle"}).alias("article"))
    r = providers.pubmed(pages)
    return r.select("pmid", "doi", "pmcid", "title", "abstract", "status", F.array_join(F.transform("update_relations", lambda x: x["direction"]), ";").alias("directions"), "updated_at", c("year").cast("bigint").alias("year"))


@query("arxiv_records", """SELECT source_id, doi_plain AS doi, title, 'Ada Byron' AS authors, CAST(year(updated_on) AS BIGINT) AS year FROM fx_citations WHERE source = 'arxiv'""")
def arxiv_records(spark, sf):
    c = F.col
    xml = F.concat(F.lit("<entry><id> "), c("source_id"), F.lit(" </id><title>"), c("title"), F.lit("</title><author><name>Ada Byron</name></author><published>"), c("updated_on").cast("string"), F.lit("T00:00:00Z</published><doi>"),
                   c("doi_text"), F.lit("</doi></entry>"))
    pages = view(spark, sf, "fx_citations").where("source = 'arxiv'").select(F.from_xml(xml, providers.ARXIV_ENTRY, {"rowTag": "entry"}).alias("entry"))
    r = providers.arxiv(pages)
    return r.select("source_id", "doi", "title", F.array_join("authors", ";").alias("authors"), c("year").cast("bigint").alias("year"))


@query("provider_union", """SELECT source, CASE source WHEN 'crossref' THEN doi_plain WHEN 'pubmed' THEN CAST(input_pos AS STRING) WHEN 'europepmc' THEN 'MED:' || input_pos ELSE source_id END AS source_id,
  CASE WHEN source = 'pubmed' THEN '10.1234/x' || input_pos ELSE doi_plain END AS doi, title, CASE WHEN source = 'openalex' AND input_pos % 4 = 0 THEN 'retracted' WHEN source = 'europepmc' AND input_pos % 4 = 1 THEN 'retracted' ELSE 'active' END AS status
FROM fx_citations
UNION ALL SELECT 'scopus', source_id, doi_plain, title, 'active' FROM fx_citations WHERE source = 'openalex'""")
def provider_union(spark, sf):
    """Every landed record of six providers in one table; what OpenAlex knows, Scopus holds as well."""
    c = F.col
    k = c("input_pos").cast("string")
    doi, title = c("doi_text"), c("title")
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
    xml = lambda source, text, schema, row: view(spark, sf, "fx_citations").where(c("source") == source).select(
        F.from_xml(text, schema, {"rowTag": row}).alias("record"))
    article = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), tag("PMID", k), tag("Article", tag("ArticleTitle", title)),
                       F.lit('</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1234/X'), k, F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    entry = tag("entry", F.concat(tag("id", c("source_id")), tag("title", title), tag("doi", doi)))
    parts = [
        providers.crossref(_item(spark, sf, "crossref", F.struct(doi.alias("DOI"), F.array(title).alias("title")), providers.CROSSREF_ITEM)),
        providers.openalex(_item(spark, sf, "openalex", F.struct(c("source_id").alias("id"), doi.alias("doi"), title.alias("display_name"), (c("input_pos") % 4 == 0).alias("is_retracted")),
                                 providers.OPENALEX_ITEM)),
        providers.europepmc(_item(spark, sf, "europepmc", F.struct(k.alias("id"), F.lit("MED").alias("source"), doi.alias("doi"), title.alias("title"), F.when(c("input_pos") % 4 == 1, "Y").alias("isRetracted")),
                                  providers.EUROPEPMC_ITEM)),
        providers.scopus(_item(spark, sf, "openalex", F.struct(c("source_id").alias("dc:identifier"), doi.alias("prism:doi"), title.alias("dc:title")), providers.SCOPUS_ITEM)),
        providers.pubmed(xml("pubmed", article, providers.PUBMED_ARTICLE, "PubmedArticle"), "record"),
        providers.arxiv(xml("arxiv", entry, providers.ARXIV_ENTRY, "entry"), "record")]
    return providers.union_citations(*parts).select("source", "source_id", "doi", "title", "status")


@query("id_conversions", """SELECT CAST(c_custkey AS STRING) AS requested_id, 'PMC' || c_custkey AS pmcid FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""")
def id_conversions(spark, sf):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(k.cast("string").alias("requested_id"), F.when(k % 3 == 0, F.concat(F.lit("pmc-"), k)).otherwise(F.concat(F.lit("PMC"), k)).alias("pmcid"), F.when(k % 5 == 0, F.lit(False)).when(k % 5 == 1, F.lit(True)).alias("live"))
    return providers.id_conversions(r)


@query("open_locations", """SELECT '10.1234/c' || c_custkey AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'https://x.org/' || c_custkey || '.pdf' ELSE 'https://x.org/' || c_custkey END AS url, CASE WHEN c_custkey % 2 = 0 THEN 'pdf' ELSE 'landing_page' END AS kind FROM customer WHERE c_custkey % 3 <> 0""")
def open_locations(spark, sf):
    k = F.col("c_custkey")
    base = F.concat(F.when(k % 3 == 0, "http").otherwise("https"), F.lit("://x.org/"), k)
    loc = F.struct(F.when(k % 2 == 0, F.concat(base, F.lit(".pdf"))).alias("url_for_pdf"), base.alias("url"), F.lit("cc-by").alias("license"), F.lit("publishedVersion").alias("version"))
    return providers.unpaywall_locations(table(spark, sf, "customer").select(F.concat(F.lit("10.1234/C"), k).alias("doi"), F.array(loc).alias("oa_locations"))).select("doi", "url", "kind")


@query("version_files", """SELECT 'PMC' || c_custkey || '.1' AS version, kind, CAST(c_custkey % 4 = 0 AS STRING) AS manuscript, CASE WHEN kind = 'xml' THEN 'abc' END AS md5 FROM customer, (VALUES ('xml'), ('pdf'), ('media_or_supplement')) v(kind)
WHERE c_custkey % 7 <> 0 AND (kind <> 'pdf' OR c_custkey % 2 = 0)""")
def version_files(spark, sf):
    k = F.col("c_custkey")
    name = F.concat(F.lit("PMC"), k, F.lit(".1"))
    root = F.concat(F.lit("https://files.example.org/"), name)
    r = table(spark, sf, "customer").select(
        F.concat(F.lit("pmc"), k).alias("pmcid"), F.when(k % 7 == 0, F.concat(name, F.lit("x"))).otherwise(name).alias("version"), F.lit(None).cast("string").alias("doi"), F.lit("no").alias("is_retracted"),
        F.when(k % 4 == 0, "yes").otherwise("no").alias("is_manuscript"), F.lit("CC BY").alias("license_code"), F.concat(root, F.lit("/a.xml?md5=abc")).alias("xml_url"),
        F.when(k % 2 == 0, F.concat(root, F.lit("/a.pdf"))).otherwise(F.lit("https://elsewhere.org/a.pdf")).alias("pdf_url"), F.lit(None).cast("string").alias("text_url"), F.array(F.concat(root, F.lit("/m.png"))).alias("media_urls"))
    return providers.pmc_locations(r, "files.example.org").select("version", "kind", F.col("manuscript").cast("string").alias("manuscript"), "md5")


@query("version_status", """SELECT 'PMC' || o_custkey AS pmcid, CASE WHEN max(CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END) = 1 THEN 'retracted' ELSE 'active' END AS publication_status FROM orders GROUP BY 1""")
def version_status(spark, sf):
    none = F.lit(None).cast("string")
    r = table(spark, sf, "orders").select(F.concat(F.lit("PMC"), "o_custkey").alias("pmcid"), F.concat(F.lit("PMC"), "o_custkey", F.lit("."), "o_orderkey").alias("version"), none.alias("doi"), (F.col("o_orderkey") % 20 == 0).alias("is_retracted"),
                                          none.alias("is_manuscript"), none.alias("license_code"), none.alias("xml_url"), none.alias("pdf_url"), none.alias("text_url"), F.lit(None).cast("array<string>").alias("media_urls"))
    return providers.pmc_publication_status(r)


# ---- rollups ------------------------------------------------------------------------------------


@query("family_members", """SELECT DISTINCT study_family, kind, member FROM (
  SELECT study_family, 'experiment' AS kind, experiment_id AS member FROM fx_experiments UNION ALL SELECT study_family, 'doi', doi FROM fx_experiments
  UNION ALL SELECT study_family, 'document', document_hash FROM fx_experiments
  UNION ALL SELECT e.study_family, 'publication', coalesce(d.publication_id, 'local-' || d.document_hash) FROM fx_experiments e JOIN fx_documents d ON d.document_hash = e.document_hash) x""")
def family_members(spark, sf):
    return sx.family_members(view(spark, sf, "fx_measurements"), view(spark, sf, "fx_experiments"), view(spark, sf, "fx_documents"))


def units(spark, sf):
    c = F.col
    return table(spark, sf, "documents").select(c("source").alias("document_hash"), c("doc_id").alias("page"), (c("doc_id") % 3).alias("tables"), (c("doc_id") % 2).alias("figures"), F.when(c("doc_id") % 17 == 0, " ").otherwise(c("text")).alias("text"))


@query("coverage", """SELECT source AS document_hash, CAST(count(*) AS BIGINT) AS units, CAST(sum(doc_id % 3) AS BIGINT) AS tables, CAST(sum(doc_id % 2) AS BIGINT) AS figures, CAST(count(l) AS BIGINT) AS processed,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS measurements, CASE WHEN count(l) = count(*) THEN 'processed' ELSE 'pending' END AS status
FROM (SELECT d.*, l.doc_id AS l, m.n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, 1 + doc_id % 4 AS n FROM labels) m ON m.doc_id = d.doc_id) x GROUP BY 1""")
def coverage(spark, sf):
    u = units(spark, sf)
    done = table(spark, sf, "labels").join(u.select("document_hash", F.col("page").alias("doc_id")), "doc_id").select("document_hash", F.col("doc_id").alias("page"))
    m = done.select("document_hash", "page", F.explode(F.sequence(F.lit(0), (F.col("page") % 4).cast("int"))).alias("x"))
    return sx.coverage(u, m, done)


@query("excluded_coverage", """SELECT source AS document_hash, doc_id AS page, 'screened_ineligible' AS text_status, 'review' AS reason FROM documents WHERE lang = 'xx' OR length(source) % 2 = 0""")
def excluded_coverage(spark, sf):
    u = units(spark, sf)
    e = u.select("document_hash").distinct().select("document_hash", (F.length("document_hash") % 2 != 0).alias("eligible"), F.lit("review").alias("reason"))
    return sx.excluded_coverage(u, e).select("document_hash", "page", "text_status", "reason")


@query("inventory_totals", """SELECT source AS document_hash, CAST(count(*) AS BIGINT) AS pages, CAST(sum(CASE WHEN doc_id % 17 = 0 OR trim(text, ' ' || chr(10)) = '' THEN 0 ELSE 1 END) AS BIGINT) AS text_pages, CAST(sum(doc_id % 3) AS BIGINT) AS table_candidates,
  CAST(sum(doc_id % 2) AS BIGINT) AS figure_candidates FROM documents GROUP BY ROLLUP (source)""")
def inventory_totals(spark, sf):
    return sx.inventory_totals(units(spark, sf))


@query("region_links", """SELECT document_hash, page, CAST(count(DISTINCT CASE WHEN status = 'accepted' THEN measurement_id END) AS BIGINT) AS supported_measurements FROM fx_measurements GROUP BY 1, 2""")
def region_links(spark, sf):
    c = F.col
    m = view(spark, sf, "fx_measurements")
    regions = m.select("document_hash", "page").distinct().select("document_hash", "page", F.concat(F.lit("page-"), "page", F.lit("-table-1")).alias("region_id"), F.lit("table").alias("kind"))
    ev = m.select("document_hash", "page", "measurement_id", F.when(c("status") == "accepted", F.concat(F.lit("page-"), "page", F.lit("-table-1:row 2"))).otherwise("text").alias("locator"), F.lit(None).cast("string").alias("figure_id"))
    return sx.region_links(regions, ev).select("document_hash", "page", "supported_measurements")


@query("merged_attributes", """SELECT 'exp-' || l_suppkey AS experiment_id, l_shipmode AS text, first_status, CASE WHEN anyacc AND first_status <> 'rejected' THEN 'accepted' ELSE first_status END AS status FROM (
  SELECT l_suppkey, l_returnflag AS l_shipmode, arg_min(st, pos) AS first_status, bool_or(st = 'accepted') AS anyacc FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos0,
    l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_quantity AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'uncertain' ELSE 'rejected' END AS st FROM lineitem) x GROUP BY 1, 2) y""")
def merged_attributes(spark, sf):
    c = F.col
    a = table(spark, sf, "lineitem").select(F.concat(F.lit("exp-"), "l_suppkey").alias("experiment_id"), F.lit("Flag").alias("name"), c("l_returnflag").alias("text"), F.lit(None).cast("double").alias("value"),
                                            F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("basis"), (c("l_orderkey") * 1000000000 + c("l_linenumber") * 100000000 + c("l_partkey") * 1000 + c("l_quantity")).alias("pos"),
                                            F.when(c("l_linenumber") % 3 == 0, "accepted").when(c("l_linenumber") % 3 == 1, "uncertain").otherwise("rejected").alias("status"))
    m = sx.merge_attributes(a)
    first = a.groupBy("experiment_id", "text").agg(F.min_by("status", "pos").alias("first_status"))
    return m.join(first, ["experiment_id", "text"]).select("experiment_id", "text", "first_status", "status")


@query("merged_measurements", """SELECT experiment_id, outcome, raw_value, CAST(min(page) AS BIGINT) AS pos FROM fx_measurements GROUP BY 1, 2, 3""")
def merged_measurements(spark, sf):
    m = view(spark, sf, "fx_measurements").select("experiment_id", "outcome", "raw_value", F.col("page").alias("pos"))
    return sx.merge_measurements(m, ["experiment_id", "outcome", "raw_value"]).select("experiment_id", "outcome", "raw_value", "pos")


@query("first_seen_notes", """SELECT event_type || ':' || CAST(user_id % 50 AS STRING) AS note, min(event_id) AS pos FROM events GROUP BY 1""")
def first_seen_notes(spark, sf):
    return sx.first_seen(table(spark, sf, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string")).alias("note"), F.col("event_id").alias("pos")))


@query("dataset_fingerprint", """SELECT CAST(count(*) AS BIGINT) AS rows, 'true' AS order_free, 'true' AS content_bound FROM fx_measurements""")
def dataset_fingerprint(spark, sf, rows_per_task=500_000):
    """The same table in two layouts and once altered: equal, then different.

    The second layout deals the table by row into tasks of ``rows_per_task`` rows, before its texts are formed.
    """
    m = view(spark, sf, "fx_measurements")
    lines = table(spark, sf, "lineitem")
    dealt = lines.repartition(max(7, -(-lines.count() // rows_per_task)), "l_orderkey", "l_linenumber", "l_partkey")
    other = spark.sql(VIEWS["fx_measurements"], lineitem=dealt)
    a = sx.dataset_fingerprint(m).withColumnRenamed("fingerprint", "a")
    b = sx.dataset_fingerprint(other).select(F.col("fingerprint").alias("b"))
    c = sx.dataset_fingerprint(m.withColumn("value", F.when(F.col("page") == 7, F.col("value") + 1).otherwise(F.col("value")))).select(F.col("fingerprint").alias("c"))
    return a.crossJoin(b).crossJoin(c).select("rows", (F.col("a") == F.col("b")).cast("string").alias("order_free"), (F.col("a") != F.col("c")).cast("string").alias("content_bound"))


@query("changed_bundles", """SELECT 'doc-' || s_suppkey AS document_hash, CASE WHEN s_suppkey % 6 = 0 THEN 'source_unavailable' ELSE 'source_changed' END AS change FROM supplier WHERE s_suppkey % 6 = 0 OR s_suppkey % 4 = 0""")
def changed_bundles(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("doc-"), k).alias("document_hash"), F.explode(F.array(F.lit("a.xml"), F.lit("f.png"))).alias("path"), k.alias("k"))
    before = rows.select("document_hash", "path", F.sha2("path", 256).alias("sha256"), F.lit("v1").alias("access"))
    after = rows.where("k % 6 <> 0").select("document_hash", "path", F.sha2(F.when((F.col("k") % 4 == 0) & (F.col("path") == "f.png"), "new").otherwise(F.col("path")), 256).alias("sha256"), F.lit("v1").alias("access"))
    return sx.changed_bundles(sx.bundle_signature(after), sx.bundle_signature(before))


@query("bounds_violations", """SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600""")
def bounds_violations(spark, sf):
    return sx.bounds_violations(table(spark, sf, "lineitem"), ["l_suppkey"], 600, "too many measurements").select("l_suppkey", "n")


@query("contract_violations", """SELECT id, violation FROM (
  SELECT l_orderkey || '-' || l_linenumber AS id, 'measurement id repeats' AS violation FROM lineitem GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'parent experiment is missing' FROM lineitem WHERE l_partkey % 500 = 3
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'missing observation has a value' FROM lineitem WHERE l_partkey % 400 = 7
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'number is not finite' FROM lineitem WHERE l_partkey % 300 = 9) x""")
def contract_violations(spark, sf):
    c = F.col
    l = table(spark, sf, "lineitem")
    m = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("measurement_id"), c("l_partkey").alias("experiment_id"), F.when(c("l_partkey") % 400 == 7, "missing").otherwise("exact").alias("qualifier"),
                 F.when(c("l_partkey") % 300 == 9, F.lit(float("nan"))).otherwise(c("l_quantity")).alias("value"))
    e = l.where("l_partkey % 500 <> 3").select(c("l_partkey").alias("experiment_id")).distinct()
    return sx.contract_violations(m, e, ["value"])


@query("element_ids", """SELECT l_orderkey, l_linenumber, position, 'page-' || page || '-' || CASE WHEN kind = 'table' THEN 'table' ELSE 'figure-candidate' END || '-' || k AS element_id FROM (
  SELECT *, row_number() OVER (PARTITION BY document, page, kind = 'table' ORDER BY kind = 'vector', position) AS k FROM (
    SELECT l_orderkey, l_linenumber, 'doc-' || l_suppkey AS document, l_linenumber AS page, CASE l_returnflag WHEN 'A' THEN 'vector' WHEN 'N' THEN 'table' ELSE 'raster' END AS kind,
      CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey AS position FROM lineitem) x) y""")
def element_ids(spark, sf):
    """Tables and figure candidates of every page, named by their order on it."""
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "vector").when(c("l_returnflag") == "N", "table").otherwise("raster")
    boxes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("doc-"), "l_suppkey").alias("document_hash"), c("l_linenumber").alias("page"), kind.alias("kind"),
                                                (c("l_orderkey").cast("bigint") * 1000000 + c("l_partkey")).alias("position"))
    return fig.element_ids(boxes).select("l_orderkey", "l_linenumber", "position", "element_id")


@query("condition_records", """SELECT experiment_id, CASE WHEN part % 9 = 0 THEN row_number() OVER (PARTITION BY document_hash ORDER BY part, experiment_id) - 1 END AS condition_record FROM fx_experiments""")
def condition_records(spark, sf):
    e = view(spark, sf, "fx_experiments").select("experiment_id", "document_hash", F.col("part").alias("position"))
    return sx.condition_records(e, e.where("position % 9 <> 0")).select("experiment_id", "condition_record")


@query("merged_batches", """WITH a AS (SELECT 'doc-' || l_suppkey AS document_hash, CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS label, l_linestatus AS text, l_linenumber % 3 AS page,
  CAST(l_orderkey AS BIGINT) * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_quantity AS pos FROM lineitem),
v AS (SELECT document_hash, label, text, min(pos) AS pos FROM a WHERE label <> '' GROUP BY 1, 2, 3), f AS (SELECT document_hash, label, min(pos) AS first FROM v GROUP BY 1, 2),
e AS (SELECT document_hash, label, text, CAST(count(DISTINCT page) AS BIGINT) AS evidence FROM a WHERE label <> '' GROUP BY 1, 2, 3)
SELECT v.document_hash, v.label, v.text, CAST(v.pos > f.first AS STRING) AS conflict, e.evidence FROM v JOIN f ON f.document_hash = v.document_hash AND f.label = v.label
  JOIN e ON e.document_hash = v.document_hash AND e.label = v.label AND e.text = v.text
UNION ALL SELECT document_hash, '', NULL, NULL, CAST(count(*) AS BIGINT) FROM a WHERE label = '' GROUP BY 1""")
def merged_batches(spark, sf):
    """Batches of a document tied by stripped label: values, conflicts and distinct evidence; rows without a label are counted."""
    c = F.col
    l = table(spark, sf, "lineitem")
    label = F.when(c("l_linenumber") == 7, F.lit("  ")).when(c("l_linenumber") % 2 == 0, F.concat(F.lit(" "), "l_returnflag")).otherwise(F.concat("l_returnflag", F.lit("\t ")))
    a = sx.tied_by_label(l.select(F.concat(F.lit("doc-"), "l_suppkey").alias("document_hash"), label.alias("sample_label"), F.lit("Line").alias("name"), c("l_linestatus").alias("text"),
                                  F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("basis"), F.lit("accepted").alias("status"),
                                  F.struct((c("l_linenumber") % 3).alias("page"), F.array(F.lit("cell")).alias("path")).alias("place"),
                                  (c("l_orderkey").cast("bigint") * 1000000000 + c("l_linenumber") * 100000000 + c("l_partkey") * 1000 + c("l_quantity")).alias("pos")))
    names = a.where("experiment_key is not null").groupBy("experiment_key", "document_hash").agg(text.strip(F.min("sample_label")).alias("label"))
    merged = sx.merge_conditions(a)
    evidence = sx.union_evidence(a.where("experiment_key is not null"), ["experiment_key", "name", "text"], ["place"]).groupBy("experiment_key", "text").agg(F.count("*").alias("evidence"))
    told = merged.join(evidence, ["experiment_key", "text"]).join(names, "experiment_key").select("document_hash", "label", "text", c("conflict").cast("string").alias("conflict"), "evidence")
    blank = a.where("experiment_key is null").groupBy("document_hash").agg(F.count("*").alias("evidence"))
    return told.unionByName(blank.withColumn("label", F.lit("")), allowMissingColumns=True)


@query("publication_gate", """SELECT 'published' AS what, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'hash is missing', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'filename is missing', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey % 15 = 0""")
def publication_gate(spark, sf):
    """A snapshot is published, a faulty successor is refused and leaves the first one readable."""
    from evloom.sources.publication import Publications
    from evloom.streaming.living import folders
    c = F.col
    m = view(spark, sf, "fx_measurements").groupBy("measurement_id").agg(F.min("experiment_id").alias("experiment_id"), F.min("qualifier").alias("qualifier"), F.min("value").alias("value"))
    good = {"documents": table(spark, sf, "supplier").select(F.concat(F.lit("doc-"), "s_suppkey").alias("document_id"), F.concat("s_name", F.lit(".pdf")).alias("filename"),
                                                            F.sha2(c("s_suppkey").cast("string"), 256).alias("sha256"), F.lit("completed").alias("status"), c("s_suppkey").alias("k")),
            "experiments": view(spark, sf, "fx_experiments").select("experiment_id"), "measurements": m}
    faulty = {"documents": good["documents"].withColumn("sha256", F.when(c("k") % 10 != 0, c("sha256"))).withColumn("filename", F.when(c("k") % 15 == 0, " ").otherwise(c("filename")))}
    store = Publications(spark, folders(spark, "published")[0])
    audit = lambda tables: sx.snapshot_violations(tables, ["value"])
    first = store.publish(good, audit)
    refused = store.publish(faulty, audit, kept=["experiments", "measurements"])
    if first or not refused:
        raise RuntimeError(f"the gate let a faulty snapshot pass or held a sound one: {first[:3]}")
    wrong = sx.document_violations(faulty["documents"]).groupBy(c("violation").alias("what")).agg(F.count("*").alias("n"))
    return store.read()["documents"].agg(F.lit("published").alias("what"), F.count("*").alias("n")).unionByName(wrong)
