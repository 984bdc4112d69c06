"""Evidence verification: every number is checked against the text it is said to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evloom.functions import text
from evloom.functions.units import MASS_BASIS, VOLUME_BASIS

# Wording that counts as support.
STATISTIC_WORDS = {"mean": r"\b(?:mean|average)\b", "arithmetic_mean": r"\b(?:mean|average)\b", "median": r"\bmedian\b"}
UNCERTAINTY_WORDS = {"SD": r"\b(?:sd|standard deviation)\b", "SE": r"\b(?:se|sem|standard error)\b",
                     "CI": r"\b(?:ci|confidence interval)\b"}
BASIS_WORDS = {"mass": r"wt\.?\s*%|w/w|mass|weight", "volume": r"vol\.?\s*%|v/v|volume"}
QUALIFIER_SIGNS = {"lt": ["<", "less than"], "le": ["≤", "<=", "at most"], "gt": [">", "greater than"], "ge": ["≥", ">=", "at least"]}
INDEPENDENT = r"independent|separately prepared|separate preparations|biological replicates"
COUNT_BEFORE = r"(?iU)\b(\d+)(?=\s+(?:[a-z]+\s+){0,3}(?:independent|separate|biological)\b)"
COUNT_AFTER = r"(?iU)(?<=(?:independent|separate|biological).{0,55})\bn\s*[=:]\s*(\d+)\b"
TECHNICAL = r"technical|particles|droplets|repeat|replicat|measurements"
ARMS = r"independent(?:ly)?[^.]{0,60}(?:arms|groups)|(?:arms|groups)[^.]{0,60}independent"

NUMBERS = ["value", "lower_bound", "upper_bound", "uncertainty", "ci_lower", "ci_upper", "time_value"]


def _find(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def _contains(haystack: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(haystack, needle), F.lit(False))


def page_index(pages: DataFrame) -> DataFrame:
    """Canonical text of each page, computed once per page and not once per citation of it.

    ``pages``: document_hash, page, text, tables (array of id, rows), width, height, text_status.
    """
    table_ids = F.transform("tables", lambda t: t["id"])
    # without rows of tables the text may be plain as it is
    bare = F.size(F.flatten(F.transform("tables", lambda t: t["rows"]))) == 0
    whole = F.when(bare, F.col("text")).otherwise(text.source_text(F.col("text"), F.col("tables")))
    return pages.select(
        "document_hash", "page", text.canonical_text(whole).alias("__page_text"),
        table_ids.alias("__tables"), F.col("width").alias("__width"), F.col("height").alias("__height"),
        F.coalesce("text_status", F.lit("")).alias("__text_status"))


def _box_inside(box: Column, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = [F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)]
    real = F.forall(box, text.finite)
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)
    return F.coalesce((F.size(box) == 4) & real & inside, F.lit(False))


def check_evidence(evidence: DataFrame, pages: DataFrame, owner: list[str]) -> DataFrame:
    """One row per owner with the notes and the supported excerpts of all its evidence.

    ``evidence``: owner columns, pos, document_hash, expected_hash, page, source_type, locator,
    excerpt, bounding_box. The regrouping holds one owner's evidence, which was one nested array before.
    """
    c = F.col
    gathered = _checked(evidence, pages, [*owner, "pos"]).groupBy(*owner).agg(F.array_sort(F.collect_list(
        F.struct("pos", "failures", "ambiguities", "excerpt"))).alias("e"))
    return gathered.select(
        *owner, F.flatten(c("e.failures")).alias("__failures"), F.flatten(c("e.ambiguities")).alias("__ambiguities"),
        F.array_compact(c("e.excerpt")).alias("__excerpts"))


def _checked(evidence: DataFrame, pages: DataFrame, carried: list[str]) -> DataFrame:
    """Failures, ambiguities and, where it is supported, the excerpt of each row of evidence, beside the ``carried`` columns.

    The containment test runs behind an equi-join on (document_hash, page), which adaptive execution
    may split when one page is cited by a large share of the rows.
    """
    c = F.col
    # settled before the rows move, so that one hash travels and not two
    settled = evidence.withColumn("__foreign", c("document_hash") != c("expected_hash")).drop("expected_hash")
    joined = settled.join(page_index(pages), ["document_hash", "page"], "left")
    textual = c("source_type").isin("text", "table")
    # tested once per citation, and only where a page was found: several notes read the result
    # a lower-cased excerpt within canonical text is canonical itself but for blanks at its ends, so most need no more than that
    body = c("__page_text")
    # lower case within canonical text is canonical but for blanks at its ends; plain text in single blanks has no other canonical form
    stated = c("excerpt").rlike(text.WORD) & (_contains(body, F.lower("excerpt")) | (
        c("excerpt").rlike(text.NOT_PLAIN) & _contains(body, text.canonical_text(c("excerpt")))))
    joined = joined.withColumns({"__found": body.isNotNull(),
                                 "__exact": F.when(textual & body.isNotNull(), F.coalesce(stated, F.lit(False))).otherwise(False)}).drop("__page_text")
    found, exact = c("__found"), c("__exact")
    located = F.exists("__tables", lambda t: F.contains(c("locator"), t))
    return joined.select(
        *carried,
        F.array_compact(F.array(
            F.when(c("__foreign"), "evidence cites another source"),
            F.when(~found, "page is outside the document"),
            F.when(found & textual & ~exact, "excerpt not found on the stated page"),
            F.when(found & ~textual & c("is_reported"), "figure value without calibrated geometry"),
            F.when(found & c("bounding_box").isNotNull() & ~_box_inside(c("bounding_box"), c("__width"), c("__height")),
                   "bounding box outside the page"))).alias("failures"),
        F.array_compact(F.array(
            F.when(found & F.startswith("__text_status", F.lit("ocr")), "OCR page needs visual verification"),
            F.when(found & (c("source_type") == "table") & ~F.coalesce(located, F.lit(False)), "table locator unknown"))).alias("ambiguities"),
        F.when(exact, c("excerpt")).alias("excerpt"))


def _attach(rows: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    return _with_texts(rows.join(checks, key, "left"))


def _attach_one(rows: DataFrame, pages: DataFrame, reported: Column) -> DataFrame:
    """The same for rows that cite one place each: a row goes to the page it cites and is not brought together again."""
    c = F.col
    cited = c("evidence").isNotNull()
    own = {x: f"__own_{x}" for x in rows.columns}  # a row may have columns named like those of its evidence
    asked = rows.select(*[c(x).alias(y) for x, y in own.items()], cited.alias("__cited"), c("expected_hash"), reported.alias("is_reported"), "evidence.*")
    told = _checked(asked, pages, [*own.values(), "__cited"])
    return _with_texts(told.select(*[c(y).alias(x) for x, y in own.items()], *[F.when(c("__cited"), x).alias(f"__{name}") for name, x in (
        ("failures", c("failures")), ("ambiguities", c("ambiguities")), ("excerpts", F.array_compact(F.array("excerpt"))))]))


def _with_texts(joined: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    joined = joined.withColumn("__cited", F.col("__excerpts").isNotNull())
    for name in ("__failures", "__ambiguities", "__excerpts"):
        joined = joined.withColumn(name, F.coalesce(name, empty))
    joined = joined.withColumn("__text", F.array_join("__excerpts", "\n"))
    return joined.withColumn("__canonical", text.canonical_text(F.col("__text"))).withColumn(
        "__numbers", text.numeric_values(F.col("__text")))


def _evidence_rows(rows: DataFrame, key: str, reported: Column) -> DataFrame:
    return rows.select(key, "expected_hash", reported.alias("is_reported"), F.posexplode("evidence").alias("pos", "ev")).select(
        key, "expected_hash", "is_reported", "pos", "ev.*")


def verify_measurements(measurements: DataFrame, pages: DataFrame) -> DataFrame:
    """Status, notes and withheld counts of each candidate measurement.

    ``measurements`` carries measurement_id, expected_hash, evidence (array of struct, or one struct where
    each cites one place) and the measurement columns; a page occurs once. Supported-number checks run on
    the counts as stated, before any is withheld.
    """
    c = F.col
    reported = c("origin") == "reported"
    if isinstance(measurements.schema["evidence"].dataType, StructType):
        m = _attach_one(measurements, pages, reported)
    else:
        m = _attach(measurements, check_evidence(_evidence_rows(measurements, "measurement_id", reported), pages, ["measurement_id"]), "measurement_id")
    nums, body, canonical = c("__numbers"), c("__text"), c("__canonical")
    unsupported = lambda name: c(name).isNotNull() & ~F.coalesce(
        text.supported_number(c(name).cast("double"), nums), F.lit(False))
    present = lambda name: c(name).isNotNull() & (c(name) != "")
    literal = lambda name: _contains(canonical, text.canonical_text(c(name)))

    raw_numbers = text.numeric_values(c("raw_value"))
    raw_supported = (F.size(raw_numbers) > 0) & F.forall(raw_numbers, lambda n: text.supported_number(n, nums))
    signs = F.lit(False)
    folded = text.casefold(body)
    for q, words in QUALIFIER_SIGNS.items():
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | _contains(folded, F.lit(w))
        signs = signs | ((c("qualifier") == q) & ~any_word)

    basis = F.lower(c("concentration_basis"))
    basis_ok = ((basis.isin(*MASS_BASIS) & _find(body, BASIS_WORDS["mass"]))
                | (basis.isin(*VOLUME_BASIS) & _find(body, BASIS_WORDS["volume"])))
    basis_bad = present("concentration_basis") & ~F.coalesce(basis_ok, F.lit(False))
    statistic_ok = F.lit(False)
    for s, pattern in STATISTIC_WORDS.items():
        statistic_ok = statistic_ok | ((c("statistic") == s) & _find(body, pattern))
    other = ~c("statistic").isin(*STATISTIC_WORDS) & _contains(F.lower(body), F.lower(c("statistic")))
    statistic_bad = present("statistic") & ~F.coalesce(statistic_ok | other, F.lit(False))
    named = F.lit(False)
    for u, pattern in UNCERTAINTY_WORDS.items():
        named = named | ((c("uncertainty_type") == u) & _find(body, pattern))
    spread_bad = ~F.coalesce(c("uncertainty_type").isin("none", "unknown"), F.lit(True)) & ~named
    # the counts that stand next to such wording, extracted once by fixed patterns
    counted = F.concat(F.regexp_extract_all(body, F.lit(COUNT_BEFORE), 1), F.regexp_extract_all(body, F.lit(COUNT_AFTER), 1))
    tied = F.array_contains(counted, c("n_independent").cast("string"))
    independent_bad = c("n_independent").isNotNull() & ~F.when(_find(body, INDEPENDENT), tied).otherwise(F.lit(False))
    technical_bad = c("n_technical").isNotNull() & ~_find(body, TECHNICAL)
    # each decides a note and a column: tested once per row
    m = m.withColumns({f"__{name}": F.coalesce(reported & bad, F.lit(False)) for name, bad in {
        "basis": basis_bad, "spread": spread_bad, "independent": independent_bad, "technical": technical_bad}.items()})

    failures = F.array_compact(F.concat(
        F.when(c("__cited"), F.array().cast("array<string>")).otherwise(F.array(F.lit("no source evidence"))),
        c("__failures"),
        F.array(*[F.when(reported & unsupported(x), f"reported {x} lacks numerical support") for x in NUMBERS],
                F.when(reported & present("raw_value") & ~literal("raw_value") & ~raw_supported, "raw value lacks support"),
                F.when(reported & signs, "inequality lacks explicit support"),
                *[F.when(reported & unsupported(x), f"{x} lacks numerical support") for x in ("n_independent", "n_technical")])))
    ambiguities = F.array_compact(F.concat(
        c("__ambiguities"),
        F.array(*[F.when(reported & present(x) & ~literal(x), f"{x} is not literal in the excerpt")
                  for x in ("unit", "time_unit", "measurement_method")],
                F.when(reported & statistic_bad, "statistic is not named"),
                F.when(c("__basis"), "concentration basis is not supported, withheld"),
                F.when(c("__spread"), "uncertainty is not defined, kept unknown"),
                F.when(c("__independent"), "independent n is not tied to preparations, withheld"),
                F.when(c("__technical"), "technical n is not defined, withheld"),
                F.when(c("origin") == "curve_sample", "curve samples carry no replication"),
                F.when(c("qualifier") == "missing", "missing observation kept without imputation"))))
    curve = c("origin") == "curve_sample"
    out = m.withColumn("failures", failures).withColumn("ambiguities", ambiguities)
    status = (F.when(c("qualifier") == "missing", "uncertain").when(F.size("failures") > 0, "rejected")
              .when((F.size("ambiguities") > 0) | c("origin").isin("digitized", "derived", "curve_sample"), "uncertain").otherwise("accepted"))
    null = lambda cond, name: F.when(~cond, c(name))
    replaced = {
        "status": status, "concentration_basis": null(c("__basis"), "concentration_basis"),
        "uncertainty_type": F.when(c("__spread"), "unknown").otherwise(c("uncertainty_type")),
        "n_independent": null(c("__independent") | curve, "n_independent"),
        "n_technical": null(c("__technical") | curve, "n_technical")}
    keep = [x for x in measurements.columns if x not in replaced]
    return out.select(*keep, *[v.alias(k) for k, v in replaced.items()], "failures", "ambiguities",
                      F.concat("failures", "ambiguities").alias("validation_notes"))


def verify_attributes(attributes: DataFrame, pages: DataFrame) -> DataFrame:
    """Status and notes of each condition attribute (attribute_id, name, text, value, evidence)."""
    c = F.col
    evidence = _evidence_rows(attributes, "attribute_id", F.lit(False)).withColumnRenamed("text", "__t")
    checks = check_evidence(evidence, pages, ["attribute_id"])
    figure = (evidence.where(~c("source_type").isin("text", "table")).select("attribute_id").distinct()
              .withColumn("__figure", F.lit(True)))
    a = _attach(attributes, checks, "attribute_id").join(figure, "attribute_id", "left")
    lacking = (F.size("__failures") > 0) | F.coalesce(c("__figure"), F.lit(False))
    nothing = F.size("__excerpts") == 0
    arms = (c("name") == "arms_independent") & (c("text") == "true")
    stated = F.when(arms, _find(c("__text"), ARMS)).otherwise(_contains(c("__canonical"), text.canonical_text(c("text"))))
    number_bad = c("value").isNotNull() & ~F.coalesce(text.supported_number(c("value"), c("__numbers")), F.lit(False))
    status = (F.when(lacking | number_bad, "rejected").when(nothing | ~stated, "uncertain")
              .when(F.size("__ambiguities") > 0, "uncertain").otherwise("accepted"))
    notes = F.array_compact(F.concat(
        F.when(lacking, F.array(F.lit("attribute evidence lacks source support"))).otherwise(F.array().cast("array<string>")),
        F.array(F.when(nothing, "attribute needs source evidence"),
                F.when(~nothing & arms & ~stated, "independent arms are not stated"),
                F.when(~nothing & ~arms & ~stated, "text needs interpretation"),
                F.when(number_bad, "attribute value lacks numerical support")), c("__ambiguities")))
    keep = [x for x in attributes.columns if x != "status"]
    return a.select(*keep, status.alias("status"), notes.alias("validation_notes"))


def verify_elements(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """Provenance notes of observations that cite article elements instead of pages.

    ``observations``: observation_id, expected_hash, unit_element, evidence rows already exploded
    (document_hash, source_format, page, xml_element, excerpt, bounding_box). ``elements``:
    document_hash, locator, text, unit_element of the unit that holds it.
    """
    c = F.col
    located = elements.select("document_hash", F.col("locator").alias("xml_element"),
                              text.canonical_text(F.col("text")).alias("__text"), F.col("unit_element").alias("__home"))
    j = observations.join(located, ["document_hash", "xml_element"], "left")
    unsupported = ((c("document_hash") != c("expected_hash")) | (c("source_format") != "xml") | c("page").isNotNull()
                   | c("xml_element").isNull() | c("__text").isNull() | (c("__text") == "")
                   | ~_contains(c("__text"), text.canonical_text(c("excerpt"))))
    outside = c("__home").isNotNull() & c("unit_element").isNotNull() & (c("__home") != c("unit_element")) & \
        (c("xml_element") != c("unit_element"))
    return j.groupBy("observation_id").agg(
        F.max(unsupported).alias("unsupported"), F.max(c("bounding_box").isNotNull()).alias("has_box"),
        F.max(outside).alias("outside_unit"))


def apply_review(measurements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review verdicts over verification: rejected beats uncertain, neither ever raises a status.

    ``verdicts``: measurement_id, verdict (``rejected`` or ``uncertain``).
    """
    v = verdicts.groupBy("measurement_id").agg(F.max(F.when(F.col("verdict") == "rejected", 2).otherwise(1)).alias("__v"))
    out = measurements.join(v, "measurement_id", "left")
    status = F.when(F.col("__v") == 2, "rejected").when(
        (F.col("__v") == 1) & (F.col("status") != "rejected"), "uncertain").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("__v")


def without_review(measurements: DataFrame) -> DataFrame:
    """Before an independent review, accepted evidence counts as uncertain only."""
    return measurements.withColumn("status", F.when(F.col("status") == "accepted", "uncertain").otherwise(F.col("status")))


def unknown_verdicts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts about measurements outside the job; must be empty."""
    return verdicts.join(candidates.select("measurement_id"), "measurement_id", "left_anti")


def location_valid(fmt: Column, page: Column, element: Column, asset: Column) -> Column:
    """A page for PDF only, an element for XML, a safe relative path for media."""
    from evloom.functions.urls import safe_relative_path
    fmt = F.coalesce(fmt, F.lit("pdf"))
    return F.coalesce(F.when(fmt == "pdf", page.isNotNull() & (page >= 1))
                      .when(fmt == "xml", page.isNull() & (text.strip(F.coalesce(element, F.lit(""))) != ""))
                      .when(fmt == "media", page.isNull() & safe_relative_path(asset)), F.lit(False))
