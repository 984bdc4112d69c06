"""Folders, article XML, OCR word tables and datasets as tables; exports as files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evloom.functions import text
from evloom.session import cut

MAX_BYTES = 100 * 1024 * 1024
ELEMENTS = ("document_hash string, unit_element string, locator string, element_id string, tag string, kind string, position long, "
            "table_locator string, row_no long, rowspan string, colspan string, caption string, asset_ref string, text string")


def scan_folder(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Source files of a folder tree, one row per distinct content: the first path of each hash.

    Bytes are hashed where they are read and dropped before the shuffle. A file above ``MAX_BYTES`` is
    listed with a ``reason`` and without a hash, since its content is not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(path).where(F.lower("path").rlike(r"\.(pdf|xml|nxml)\z"))
    small = files.where(F.col("length") <= MAX_BYTES)
    hashed = small.select("path", "length", F.sha2("content", 256).alias("sha256"), F.startswith("content", F.lit(b"%PDF-")).alias("is_pdf"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("path", "length", "is_pdf")).alias("f"), F.count("*").alias("copies"))
    out = first.select("sha256", "f.*", "copies", F.lit(None).cast("string").alias("reason"))
    if known is not None:
        out = out.join(known.select("sha256"), "sha256", "left_anti")
    large = files.where(F.col("length") > MAX_BYTES).select(
        F.lit(None).cast("string").alias("sha256"), "path", "length", F.lit(None).cast("boolean").alias("is_pdf"), F.lit(1).cast("long").alias("copies"), F.lit("too large").alias("reason"))
    return out.unionByName(large)


def file_checks(content: Column, md5: Column | None = None) -> Column:
    """Struct (is_pdf, sha256, md5_ok) of a file's bytes."""
    ok = F.lit(None).cast("boolean") if md5 is None else F.md5(content) == F.lower(md5)
    return F.struct(F.startswith(content, F.lit(b"%PDF-")).alias("is_pdf"), F.sha2(content, 256).alias("sha256"), ok.alias("md5_ok"))


# Elements whose text is evidence, and where the source units of an article stand.
TEXTUAL = ("p", "title", "table-wrap", "fig", "caption", "td", "th", "article-id", "article-title")
UNIT_PATH = (r"^/article/(?:front\[\d+\]/article-meta\[\d+\]/abstract\[\d+\]|body\[1\]|back\[1\]|floats-group\[\d+\]|sub-article\[\d+\])")
_META = r"^/article/front\[\d+\]/article-meta\[\d+\]/"
NODES = ("document_hash string, position long, parent long, tag string, id string, path string, rowspan string, colspan string, ref string, text string, problem string")


class _Nodes:
    """Parser events to node rows: where an element stands, its attributes of interest and, for evidence, its text."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.runs: list[str] = []
        self.started = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition("}")[2]
        if self.open:
            counts, above = self.open[-1][3], self.open[-1][2]
            counts[name] = counts.get(name, 0) + 1
            path = f"{above}/{name}[{counts[name]}]"
        else:
            path = f"/{name}"
        self.open.append((self.started, name, path, {}, attributes, len(self.runs)))
        self.started += 1

    def data(self, run: str) -> None:
        self.runs.append(run)

    def end(self, tag: str) -> None:
        position, name, path, _, attributes, run = self.open.pop()
        words = " ".join("".join(self.runs[run:]).split()) if name in TEXTUAL else None
        if name in TEXTUAL:
            self.runs.append(" ")  # neighbouring cells and paragraphs are words of their own
        href = attributes.get("{http://www.w3.org/1999/xlink}href") or attributes.get("href") or attributes.get("pub-id-type")
        self.rows.append((position, self.open[-1][0] if self.open else None, name, attributes.get("id") or None, path,
                          attributes.get("rowspan", "1"), attributes.get("colspan", "1"), href, words, None))

    def close(self) -> list[tuple]:
        return self.rows


def _nodes(body: bytes | str | None) -> list[tuple]:
    """Node rows of one article, or a single row that says why it cannot be used."""
    refuse = lambda why: [(0, None, None, None, None, None, None, None, None, why)]
    raw = body.encode() if isinstance(body, str) else bytes(body or b"")
    if len(raw) > MAX_BYTES or b"<!ENTITY" in raw.upper():
        return refuse("too large or declares entities")
    parser = ET.XMLParser(target=_Nodes())
    try:
        parser.feed(raw)
        rows = parser.close()
    except ET.ParseError:
        return refuse("not well-formed XML")
    ids = [r[3] for r in rows if r[3]]
    if rows[-1][2] != "article":
        return refuse("not an article")
    return rows if len(ids) == len(set(ids)) else refuse("element ids are not unique")


# A frame of node rows is sent on once it holds so many rows or characters.
FRAME_ROWS, FRAME_CHARS = 2_000, 4_000_000


def _frames(articles: Iterator[tuple[str, bytes | str | None]]) -> Iterator[pa.RecordBatch]:
    """Node rows of (key, body) pairs in frames that a few articles fill, whatever the number of articles."""
    shape = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in NODES.split(", "))])
    text_at = shape.get_field_index("text") - 1
    rows: list[tuple] = []
    chars = 0

    def frame() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), shape.types)], schema=shape)

    for key, body in articles:
        for row in _nodes(body):
            rows.append((key, *row))
            chars += len(row[text_at] or "")
            if len(rows) >= FRAME_ROWS or chars >= FRAME_CHARS:
                yield frame()
                rows, chars = [], 0
    if rows:
        yield frame()


def article_nodes(documents: DataFrame) -> DataFrame:
    """Elements of articles (document_hash, content) in document order: the one place that needs Python.

    Positional paths and mixed content have no built-in expression. Everything after this table is SQL. A task
    holds one article and one frame of rows as Python objects, however many articles an Arrow batch brings.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frames((key.as_py(), body.as_py()) for batch in batches for key, body in zip(batch["document_hash"], batch["content"]))
    return documents.select("document_hash", "content").mapInArrow(parse, NODES)


def article_elements(documents: DataFrame) -> DataFrame:
    """Long element table of articles, with one ``rejected`` row for each that cannot be used.

    Units are abstracts, the first body and back, floats and sub-articles. A cell belongs to the table
    that holds it most closely; rows of a table count from zero.
    """
    c = F.col
    nodes = cut(article_nodes(documents))  # parsed once, used by every rule below
    doc = "document_hash"
    where = F.when(c("id").isNotNull(), F.concat(F.lit("id:"), "id")).otherwise(c("path"))
    placed = nodes.withColumn("locator", where).withColumn("unit_path", F.regexp_extract("path", UNIT_PATH, 0))
    units = placed.where((c("path") == c("unit_path")) & (c("path") != "")).select(doc, "unit_path", c("locator").alias("unit_element"))
    inside = placed.where("unit_path <> ''").join(units, [doc, "unit_path"])
    text_rows = inside.where(c("tag").isin("p", "title", "table-wrap", "fig", "caption", "td", "th"))

    captions = nodes.where("tag = 'caption'").groupBy(doc, c("parent").alias("position")).agg(F.min_by("text", c("position")).alias("caption"))
    kind = F.when(c("tag").isin("table-wrap", "td", "th"), "table").when(c("tag") == "fig", "figure").otherwise("text")
    heading = F.when(c("tag").isin("table-wrap", "fig"), F.coalesce("caption", F.lit("")))
    main = text_rows.join(captions, [doc, "position"], "left").withColumn("kind", kind).withColumn("caption", heading)

    around = lambda tag: F.regexp_extract("path", rf"^(.*/{tag}\[\d+\])/", 1)
    rows = nodes.where("tag = 'tr'").withColumn("table_path", around("table-wrap")).where("table_path <> ''").withColumn(
        "row_no", F.row_number().over(Window.partitionBy(doc, "table_path").orderBy("position")).cast("long") - 1)
    tables = placed.where("tag = 'table-wrap'").select(doc, c("path").alias("table_path"), F.coalesce("id", "path").alias("table_locator"))
    numbered = rows.join(tables, [doc, "table_path"]).select(doc, c("position").alias("parent"), "row_no", "table_locator")
    cells = text_rows.where(c("tag").isin("td", "th")).join(numbered, [doc, "parent"]).withColumn("kind", F.lit("cell"))

    figures = placed.where("tag = 'fig'").select(doc, c("path").alias("fig_path"), c("locator").alias("fig_locator"), c("id").alias("fig_id"))
    assets = inside.where(c("tag").isin("graphic", "media") & c("ref").isNotNull()).withColumn("fig_path", around("fig")).join(figures, [doc, "fig_path"]).select(
        doc, "unit_element", c("fig_locator").alias("locator"), c("fig_id").alias("id"), F.lit("fig").alias("tag"), F.lit("asset").alias("kind"), "position", c("ref").alias("asset_ref"))

    meta = placed.where(c("path").rlike(_META + r"article-id\[\d+\]$")).withColumn("kind", F.lit("identifier")).withColumn("asset_ref", c("ref"))
    heads = placed.where(c("path").rlike(_META + r"title-group\[\d+\]/article-title\[1\]$")).withColumn("kind", F.lit("title"))
    refused = nodes.where("problem is not null").select(doc, F.lit("rejected").alias("kind"), "position", c("problem").alias("text"))

    fields = [f.split() for f in ELEMENTS.split(", ")]
    source = {"element_id": "id"}

    def shaped(df: DataFrame, *drop: str) -> DataFrame:
        have = set(df.columns) - set(drop)
        return df.select(*[(c(source.get(n, n)) if source.get(n, n) in have else F.lit(None)).cast(t).alias(n) for n, t in fields])

    out = shaped(main, "rowspan", "colspan")
    for part in (shaped(cells), shaped(assets), shaped(meta, "rowspan", "colspan"), shaped(heads, "rowspan", "colspan"), shaped(refused)):
        out = out.unionByName(part)
    return out


def unit_texts(elements: DataFrame) -> DataFrame:
    """Text of each source unit: its paragraphs, then its tables, then its figures, one per line.

    Numbers that stand only in a table are part of it, so verification can find them.
    """
    c = F.col
    rank = F.when(c("tag") == "p", 0).when(c("tag") == "table-wrap", 1).otherwise(2)
    lines = elements.where(c("tag").isin("p", "table-wrap") & c("kind").isin("text", "table") | (c("kind") == "figure"))
    return lines.groupBy("document_hash", "unit_element").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), "position", "text"))), lambda x: x["text"]), "\n").alias("text"))


def article_identifiers(elements: DataFrame) -> DataFrame:
    """doi, pmid, pmcid and title of each article."""
    c = F.col
    of = lambda kind, v=c("text"): F.min_by(v, F.when((c("kind") == "identifier") & (c("asset_ref") == kind), c("position")))
    g = elements.where("kind in ('identifier', 'title')").groupBy("document_hash").agg(
        of("doi").alias("doi"), of("pmid").alias("pmid"), F.coalesce(of("pmcid"), of("pmc")).alias("pmcid"),
        F.min_by("text", F.when(c("kind") == "title", c("position"))).alias("title"))
    return g.select("document_hash", text.canonical_doi(c("doi")).alias("doi"), "pmid",
                    F.when(c("pmcid").rlike(r"^\d+$"), F.concat(F.lit("PMC"), "pmcid")).otherwise(c("pmcid")).alias("pmcid"), "title")


def safe_asset_refs(elements: DataFrame) -> DataFrame:
    """Figure assets that are plain relative paths without wildcards."""
    from evloom.functions.urls import safe_relative_path
    ref = F.col("asset_ref")
    return elements.where(F.col("kind") == "asset").where(
        safe_relative_path(ref) & ref.rlike(r"^(?![A-Za-z][A-Za-z0-9+.\-]*:)") & ~ref.rlike(r"[*?\[\]]")).select("document_hash", "locator", "asset_ref")


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognized words of tab-separated OCR output: confidence of at least 50, with their boxes."""
    schema = ("level int, page_num int, block_num int, par_num int, line_num int, word_num int, left_px int, top_px int, "
              "width_px int, height_px int, conf double, text string")
    return keep_words(spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path))


def keep_words(words: DataFrame) -> DataFrame:
    c = F.col
    box = F.array(c("left_px"), c("top_px"), c("left_px") + c("width_px"), c("top_px") + c("height_px")).cast("array<double>")
    return words.where((text.strip(c("text")) != "") & (c("conf") >= 50)).withColumn("box", box)


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested dataset file with a pinned schema version; any other version is refused."""
    df = spark.read.schema(f"schema_version int, {schema}").option("multiLine", "true").json(path)
    if df.where(F.coalesce("schema_version", F.lit(2)) != 2).limit(1).count():
        raise ValueError("only schema_version 2 is supported")
    return df


DECISIONS = ("study_family string, experiment_id string, field string, reviewer string, source_locator string, correct boolean, recoverable boolean, "
             "accepted boolean, abstained boolean, additional_to_manual boolean, source_type string")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Reviewer decisions from JSON lines; fields a file lacks are null and a line that is no JSON is refused."""
    return spark.read.schema(DECISIONS).option("mode", "FAILFAST").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events of an append-only log, whatever the number of appends."""
    return spark.read.schema(schema).json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def export_rows(rows: DataFrame, path: str, fmt: str) -> None:
    """Write flat measurement rows as json, csv or parquet.

    CSV columns are sorted and guarded against formulas; nested columns become JSON text.
    """
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    flat = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        flat.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        csv_rows(flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError("supported formats: json, csv, parquet")


def csv_rows(flat: DataFrame) -> DataFrame:
    types = dict(flat.dtypes)
    return flat.select(*[text.spreadsheet_safe(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in sorted(flat.columns)])
