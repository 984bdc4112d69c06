"""Text, identifier and number expressions. Everything here is a Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a DOI, a number, a caption and a printed cell.
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)"
DOI_SHAPE = r"(?U)^10\.\d{4,9}/\S+\z"
NUMBER = r"(?U)(?<![\w.])[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?(?![\w.])"
CELL = r"(?U)^\s*(<=|>=|<|>|≤|≥)?\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*\z"
CAPTION = r"(?iU)^\s*(?:Fig(?:ure)?\.?|Scheme)\s*\d"
PRINTED_DOI = r"""(?i)10\.\d{4,9}/[^\s"<>]+"""
BLANK = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)[^\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove every kind of Unicode blank at both ends; plain ``trim`` only knows the space."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def bind(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _rare_folds() -> list[tuple[str, str]]:
    """Characters above Latin-1 that full case folding changes although they are already lower case.

    Derived from the interpreter's Unicode tables.
    """
    chars = (chr(i) for i in range(0x100, 0x1FFFF))
    return [(ch, ch.casefold()) for ch in chars if ch.lower() == ch and ch.casefold() != ch]


def _ranges(chars: list[str]) -> str:
    """A character class of ranges: long lists of single characters match far more slowly."""
    runs: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


_FOLDS = _rare_folds()
_TABLE = " ".join(ch + folded for ch, folded in _FOLDS)
_RARE = _ranges([ch for ch, _ in _FOLDS])


def casefold(c: Column) -> Column:
    """Full case folding. The table walk runs only for rows that hold one of the rare characters."""
    plain = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    table = F.split(F.lit(_TABLE), " ")

    def fold(p: Column) -> Column:
        walked = F.aggregate(table, p, lambda acc, x: F.replace(acc, F.substring(x, 1, 1), F.substring(x, 2, 9)))
        return F.when(p.rlike(r"[^\x00-\xff]") & p.rlike(_RARE), walked).otherwise(p)

    return bind(plain, fold)


#: Characters beyond printable ASCII, blanks that follow each other or stand at an end: all that has a form besides lower case.
NOT_PLAIN = r"[^ -~]|  |^ | \z"


def canonical_text(c: Column) -> Column:
    """Comparison form of source text: one minus sign, one mu, single blanks, folded case. Plain text is only lower-cased."""
    return F.when(c.rlike(NOT_PLAIN), casefold(collapse(F.translate(c, "−µ", "-μ")))).otherwise(F.lower(c))


def numeric_values(c: Column) -> Column:
    """All free-standing numbers of a text as doubles, decimal comma included."""
    found = F.regexp_extract_all(F.translate(c, "−", "-"), F.lit(NUMBER), F.lit(0))
    cast = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    return F.filter(cast, lambda x: x.isNotNull())


def finite(c: Column) -> Column:
    """True for a real number; null, NaN and the infinities are not."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    bound = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.abs(a - b) <= bound


def supported_number(value: Column, numbers: Column) -> Column:
    """The value equals one of the printed numbers up to 1e-8 relative, 1e-12 absolute."""
    return finite(value) & F.exists(numbers, lambda n: close(value, n, 1e-8, 1e-12))


def source_text(text: Column, tables: Column) -> Column:
    """Page text followed by its tables, one line per table row."""
    rows = F.flatten(F.transform(tables, lambda t: t["rows"]))
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "))
    return F.concat(text, F.lit("\n"), F.array_join(lines, "\n"))


def canonical_doi(c: Column) -> Column:
    """Lower-case bare DOI, or null when the text is not one.

    Percent escapes are decoded; a plus stays a plus and a stray percent sign stays itself.
    """
    s = strip(c)
    guarded = F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(F.contains(s, F.lit("%")), F.try_url_decode(guarded)).otherwise(s)
    bare = F.lower(strip(F.regexp_replace(decoded, DOI_PREFIX, "")))
    return F.when(bare.rlike(DOI_SHAPE), bare)


def printed_dois(text: Column) -> Column:
    """Sorted distinct DOI candidates of a text, trailing punctuation removed."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PRINTED_DOI), F.lit(0)))
    return F.transform(F.array_sort(found), lambda x: F.lower(F.regexp_replace(x, r"[.,;)]+\z", "")))


def caption_lines(text: Column) -> Column:
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.transform(F.filter(lines, lambda x: x.rlike(CAPTION)), strip)


def parse_cell(c: Column) -> Column:
    """Struct (qualifier, value) of a printed cell such as ``>= 2.5``; text keeps a null value."""
    sign = F.regexp_extract(c, CELL, 1)
    number = F.regexp_extract(c, CELL, 2).try_cast("double")
    hit = c.rlike(CELL)
    qualifier = (F.when(hit & (sign == "<"), "lt").when(hit & sign.isin("<=", "≤"), "le")
                 .when(hit & (sign == ">"), "gt").when(hit & sign.isin(">=", "≥"), "ge").otherwise("exact"))
    return F.struct(qualifier.alias("qualifier"), F.when(hit, number).alias("value"))


def spreadsheet_safe(c: Column) -> Column:
    """Text a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def inverted_abstract(index: Column) -> Column:
    """Rebuild an abstract from a map token -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    words = F.transform(F.array_sort(pairs), lambda x: x["w"])
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def person_name(given: Column, family: Column) -> Column:
    blank = lambda x: F.when(x != "", x)
    return F.concat_ws(" ", blank(given), blank(family))


def author_line(authors: Column) -> Column:
    """The first five authors, then "et al." if there are more."""
    n = F.coalesce(F.size(authors), F.lit(0))
    head = F.array_join(F.slice(authors, 1, 5), ", ")
    return (F.when(n <= 0, F.lit("Authors not available"))
            .otherwise(F.concat(head, F.when(n > 5, F.lit(", et al.")).otherwise(F.lit("")))))


def source_location(fmt: Column, page: Column, element: Column, asset: Column) -> Column:
    return (F.when(fmt == "xml", F.concat(F.lit("XML "), F.coalesce(element, F.lit("locator not reported"))))
            .when(fmt == "media", F.concat(F.lit("Media "), F.coalesce(asset, F.lit("asset not reported"))))
            .otherwise(F.concat(F.lit("p. "), F.coalesce(page.cast("string"), F.lit("null")))))


def artifact_hash(key: Column) -> Column:
    found = F.regexp_extract(key, r"(?i)(?:^|/)([a-f0-9]{64})(?:-[^/]*)?\.(?:png|jpe?g|webp)\z", 1)
    return F.when(found != "", F.lower(found))


def time_point(value: Column, unit: Column) -> Column:
    """``7 day`` for 7.0 and day: up to six significant digits, no trailing zeros."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e6)
    digits = F.lit(5) - F.floor(F.log10(F.abs(value))).cast("int")
    scaled = F.pow(F.lit(10.0), digits)
    short = (F.rint(value * scaled) / scaled).cast("decimal(30,12)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(short, r"0+\z", ""), r"\.\z", "")
    small_or_large = (F.abs(value) < 1e-4) | (F.abs(value) >= 1e6)
    exponent = F.floor(F.log10(F.abs(value))).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(
        F.round(value / F.pow(F.lit(10.0), exponent), 5).cast("decimal(12,5)").cast("string"), r"0+\z", ""), r"\.\z", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
                          F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    shown = (F.when(whole, value.cast("bigint").cast("string"))
             .when(small_or_large, scientific).otherwise(plain))
    return F.when(value.isNotNull() & unit.isNotNull() & (unit != ""), F.concat_ws(" ", shown, unit))


def tick_number(label: Column) -> Column:
    """Value of a printed tick label; null where the notation is not a plain number."""
    cleaned = F.replace(F.translate(strip(label), "−", "-"), F.lit(","), F.lit(""))
    return F.when(cleaned.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), cleaned.try_cast("double"))


def scale_label(label: Column) -> Column:
    """Struct (value, unit) of a scale-bar label such as ``10 um``."""
    pattern = r"(?U)^\s*([0-9]+(?:\.[0-9]+)?)\s*([^\d\s]+)\s*\z"
    return F.struct(F.regexp_extract(label, pattern, 1).try_cast("double").alias("value"),
                    F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 2)).alias("unit"))


def fingerprint(*parts: Column, length: int = 32) -> Column:
    """Stable id: leading hex digits of the SHA-256 of the parts as one JSON object."""
    body = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, length)


def joined_id(*parts: Column, length: int = 24) -> Column:
    """Stable id over parts joined by a bar, absent parts written as ``None``."""
    body = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha2(body, 256), 1, length)


def family_split(family: Column, seed: str, holdout: float = 0.2) -> Column:
    """Stable development / holdout assignment: leading 64 bits of SHA-256(seed:family) over 2^64."""
    if not 0 < holdout < 1:
        raise ValueError("holdout must lie strictly between 0 and 1")
    digest = F.sha2(F.concat(F.lit(seed + ":"), family), 256)
    fraction = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0 ** 64)
    return F.when(fraction < holdout, "holdout").otherwise("development")


def token_estimate(text: Column, image_patches: Column | None = None) -> Column:
    """Upper bound on tokens: UTF-8 bytes plus a fixed reserve plus image patches."""
    base = F.octet_length(text).cast("bigint") + F.lit(2048)
    return base if image_patches is None else base + image_patches


def search_text(*cols: Column, arrays: list[Column] | None = None) -> Column:
    """Lower-case haystack of all non-empty parts."""
    nonempty = [F.when(c != "", c) for c in cols]
    return F.lower(F.concat_ws(" ", *nonempty, *(arrays or [])))
