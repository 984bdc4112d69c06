"""Landed rows of a manual reference table: what cannot be used comes back with a reason instead of stopping the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.functions import text
from evloom.operators.primitives import dense_index

#: Origin of rows as they were printed; comparisons take no other.
MANUAL = "manual_original"


def _nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)<")


def _infinite(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.schema_of_variant(value).isin("DOUBLE", "FLOAT") & (F.isnan(number) | (F.abs(number) == F.lit(float("inf"))))


def read_reference_rows(spark: SparkSession, path: str, doi_field: str = "DOI") -> DataFrame:
    """(reference_row_id, row_hash, doi, study_family, origin, fields, raw, reason) for every line of landed JSON lines.

    ``reference_row_id`` counts all lines from 1, in the order of file names and of lines in a file, so that an id
    still names the printed row where others were refused. ``row_hash`` is the SHA-256 of the line as it landed. ``fields`` maps
    every name to its value as text, JSON nulls to null. ``reason`` is null for a row that can be used, else the first that holds of:
    no JSON object (broken text, a list, a name twice), nested field, number that is not finite, no valid DOI. A refused row keeps
    ``raw`` and has neither DOI, family nor origin. Blank lines are no rows; an empty folder gives no rows.

    Lines are numbered through range partitions, so no task sees the whole table.
    """
    c = F.col
    lines = spark.read.text(path).select(
        c("value").alias("raw"), c("_metadata.file_path").alias("__file"), c("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line")).where(F.trim("raw") != "")
    rows = dense_index(lines, [c("__file"), c("__block"), c("__line")], "__at")
    parsed = rows.withColumn("__variant", F.try_parse_json("raw"))
    is_object = F.coalesce(F.schema_of_variant("__variant").startswith("OBJECT<"), F.lit(False))
    # text that is no object never reaches the typed parser
    values = F.from_json(F.when(is_object, c("raw")), "map<string,variant>")
    parsed = parsed.withColumn("__values", values).withColumn("fields", F.from_json(F.when(is_object, c("raw")), "map<string,string>"))
    parsed = parsed.withColumn("__doi", text.canonical_doi(F.try_element_at("fields", F.lit(doi_field))))
    held = F.coalesce(F.map_values("__values"), F.array().cast("array<variant>"))
    reason = (F.when(~is_object, "no JSON object")
              .when(F.exists(held, lambda v: F.coalesce(_nested(v), F.lit(False))), "nested field")
              .when(F.exists(held, lambda v: F.coalesce(_infinite(v), F.lit(False))), "number is not finite")
              .when(c("__doi").isNull(), "no valid DOI"))
    parsed = parsed.withColumn("reason", reason)
    usable = c("reason").isNull()
    return parsed.select((c("__at") + 1).alias("reference_row_id"), F.sha2("raw", 256).alias("row_hash"), F.when(usable, c("__doi")).alias("doi"),
                         F.when(usable, c("__doi")).alias("study_family"), F.when(usable, F.lit(MANUAL)).alias("origin"),
                         F.when(usable, c("fields")).alias("fields"), "raw", "reason")


def reference_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Usable rows with the named fields as text columns, as the comparison takes them."""
    fields = [F.try_element_at("fields", F.lit(name)).alias(name) for name in names]
    return rows.where(F.col("reason").isNull()).select("reference_row_id", "row_hash", "doi", "study_family", "origin", *fields)
