"""Personal data replaced by keyed surrogates of the same type and form, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions.text import bind
from evloom.llm.tables import keyed, written

# Titles that show the gender of the name after them.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_SECRET = "password|passwd|pwd|secret|token|api_?key"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Characters of an IBAN by country, so that one in groups of four ends where it should.
_IBAN = {15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
         23: "AE|GI|IL|IQ|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
         28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
_GROUPED_IBAN = "|".join(f"(?:{c})\\d{{2}}(?:[ -][A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f"[ -][A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN.items())
_WORD = "\\p{Lu}(?:\\p{L}|['’-](?!s\\b)(?=\\p{L}))+"
#: What counts as personal data or a secret; an earlier kind wins at the same place.
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "ip": f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\.?\\d)",
    # eight groups, or :: behind a first group of three digits or more, with a decimal digit; times and slices have neither
    "ipv6": f"(?<![\\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*\\d)[0-9A-Fa-f]{{3,4}}:(?:{_HEX}:){{0,5}}(?::{_HEX}){{1,6}}|"
            f"(?=[A-Fa-f:]*\\d)[0-9A-Fa-f]{{3,4}}:(?:{_HEX}:){{1,6}}:)(?![\\w:])",
    "key": "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b",
    "secret": f"(?<=(?i:{_SECRET})\\s{{0,2}}[=:]\\s{{0,2}}[\"']?)[A-Za-z0-9_/+.~-]{{5,}}[A-Za-z0-9_/+~-]",
    "iban": f"\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}\\b|\\b(?=[A-Z]{{2}}\\d{{2}}[ -])(?=(?:[A-Z -]*\\d){{6}})(?:{_GROUPED_IBAN})\\b",
    "card": "(?<![\\w.-])\\d{4}(?:[ -]?\\d{4}){2}[ -]?\\d{1,7}(?![\\w-])|(?<![\\w.-])3[04-9]\\d{2}[ -]\\d{6}[ -]\\d{4,5}(?![\\w-])",
    "ssn": "(?<![\\w-])\\d{3}-\\d{2}-\\d{4}(?![\\w-])",
    "phone": "(?<![\\w+])(?:\\+?\\d{1,3}[ .-]?)?\\(\\d{2,4}\\)[ .-]?\\d{3,4}[ .-]?\\d{3,4}(?!\\d)|(?<![\\w+])\\+\\d{1,3}(?:[ .-]?\\d{2,4}){3,4}(?!\\d)"
             # without + or parentheses only in the usual groups, and not inside a longer row of numbers
             "|(?<![\\w.+-])(?<!\\d )(?:(?:1-)?\\d{3}-\\d{3}-\\d{4}|(?:1\\.)?\\d{3}\\.\\d{3}\\.\\d{4}|(?:1 )?[2-9]\\d{2} \\d{3}[ -]\\d{4}"
             "|0\\d{2,4}[ -]\\d{3,4}[ -]?\\d{3,4}|0\\d{2,4}\\.\\d{3,4}\\.\\d{3,4}|0\\d(?:[ .-]\\d{2}){4})(?![\\w-]|[. ]\\d)",
    "name": f"\\b(?:{MALE}|{FEMALE})\\.? {_WORD}(?: {_WORD})?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds nothing to find; the whole pattern is then not tried.
_HINT = f"[0-9@]|(?i:{_SECRET})|\\b(?:{MALE}|{FEMALE})\\b"
#: So many attempts keep the form of an entity; each later one widens it, so that no kind runs out of values.
STRICT = 20
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "a", "n", "er"), "cyrillic": ("бвгдклмнпрстз", "аеиоу", "а", "н", "ов"), "greek": ("βγδκλμνπρστζ", "αειου", "α", "ν", "ης")}


def _kind(entity: Column) -> Column:
    out = F.lit("secret")
    for kind in ("name", "phone", "ssn", "card", "iban", "key", "ipv6", "ip", "email"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _canonical(entity: Column, kind: Column) -> Column:
    """Spellings of one entity agree in this: letters and digits only, without case; addresses keep their dots and colons."""
    return F.when(kind.isin("ip", "ipv6"), F.lower(entity)).otherwise(F.lower(F.regexp_replace(entity, "[^\\p{L}\\d]", "")))


def _number(stream: Column, k: Column, digits: int = 2) -> Column:
    """The k-th number of a hexadecimal stream of 128 characters."""
    return F.conv(F.substr(stream, F.pmod(k * digits, F.lit(128)) + 1, F.lit(digits)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _pick(pool: Column, n: Column) -> Column:
    return F.substr(pool, F.pmod(n, F.char_length(pool)) + 1, F.lit(1))


def _character(c: Column, n: Column, letters: Column) -> Column:
    return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.chr(F.lit(97) + F.pmod(n, letters))).when(c.rlike("[A-Z]"), F.chr(F.lit(65) + F.pmod(n, letters)))
            .otherwise(c))


def _spelled(entity: Column, kind: Column, stream: Column, extra: Column) -> Column:
    """Every letter and digit replaced by one of its class; country code, issuer, key family and top domain stay.

    ``extra`` letters in front of an address, or digits behind anything else, widen the form.
    """
    head = (F.when(kind == "phone", F.char_length(F.regexp_extract(entity, "^(?:\\+\\d{1,3}|1)(?=[ .(-])", 0))).when(kind == "card", 1)
            .when(kind == "key", 4).when(kind == "iban", 2).otherwise(0))
    tail = F.when(kind == "email", F.char_length(F.regexp_extract(entity, "\\.[A-Za-z]+$", 0))).otherwise(0)
    letters = F.when(F.lower(entity).rlike("^[0-9a-f:]+$"), 6).otherwise(26)

    def one(form, c, i):
        rank = F.char_length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when((i < form["head"]) | (i >= F.char_length(entity) - form["tail"]), c).otherwise(_character(c, _number(stream, rank), form["letters"]))

    more = _repeat(extra, lambda i: F.when(kind == "email", F.chr(F.lit(97) + F.pmod(_number(stream, -i), F.lit(26))))
                   .otherwise(F.pmod(_number(stream, -i), F.lit(10)).cast("string")))
    form = F.struct(head.alias("head"), tail.alias("tail"), letters.alias("letters"))
    spelled = bind(form, lambda f: F.array_join(F.transform(F.split(entity, ""), lambda c, i: one(f, c, i)), ""))
    return bind(spelled, lambda new: F.when(extra == 0, new).when(kind == "email", F.concat(more, new)).otherwise(F.concat(new, more)))


def _repeat(times: Column, make) -> Column:
    """make(1) to make(times) in a row; nothing if ``times`` is 0."""
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(0), times), F.lit(2), times), make), "")


def _address(entity: Column, stream: Column, extra: Column) -> Column:
    """Octets of as many digits; widened first to any octet, then by further digits."""
    def octet(o, i):
        n, size = _number(stream, i, 4), F.char_length(o)
        strict = F.when(size == 1, F.pmod(n, F.lit(10))).when(size == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(156)) + 100).cast("string")
        more = _repeat(extra - 1, lambda k: F.pmod(_number(stream, k * 4 + i + 16), F.lit(10)).cast("string"))
        return F.when(extra == 0, strict).otherwise(F.concat(F.pmod(n, F.lit(256)).cast("string"), F.when(extra > 1, more).otherwise("")))
    return F.array_join(F.transform(F.split(entity, "\\."), octet), ".")


def _named(word: Column, kind: Column, stream: Column, extra: Column) -> Column:
    """A name of syllables in the script of ``word``, ``extra`` ones included, ending by gender or as a surname."""
    scripts = {script: F.struct(*[F.lit(x).alias(f"s{n}") for n, x in enumerate(pools)]) for script, pools in _SYLLABLES.items()}
    own = F.when(word.rlike("\\p{IsCyrillic}"), scripts["cyrillic"]).when(word.rlike("\\p{IsGreek}"), scripts["greek"]).otherwise(scripts["latin"])

    def made(script: Column) -> Column:
        consonants, vowels, female, male, last = [script[f"s{n}"] for n in range(5)]
        syllable = lambda i: F.concat(_pick(consonants, _number(stream, 2 * i)), _pick(vowels, _number(stream, 2 * i + 1)))
        stem = F.concat(*(syllable(F.lit(i)) for i in range(3)), F.when(F.char_length(word) > 7, syllable(F.lit(3))).otherwise(""),
                        F.when(extra > 0, _repeat(extra, lambda k: syllable(k + 3))).otherwise(""))
        return F.initcap(F.concat(stem, F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise(last)))
    return bind(own, made)


def _words(entity: Column) -> Column:
    """Parts of an entity that get surrogates: (text, kind); a name has a given name and a surname, others are one part."""
    words = F.split(entity, " ")
    given = F.when(entity.rlike(f"^(?:{FEMALE})\\b"), "given_f").otherwise("given_m")
    part = lambda text, kind: F.struct(text.alias("text"), kind.alias("kind"))
    return bind(_kind(entity), lambda kind: (
        F.when((kind == "name") & (F.size(words) > 2), F.array(part(F.get(words, F.lit(1)), given), part(F.get(words, F.lit(2)), F.lit("surname"))))
        .when(kind == "name", F.array(part(F.get(words, F.lit(1)), F.lit("surname")))).otherwise(F.array(part(entity, kind)))))


def surrogate(text: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one part; deterministic in the key, so all mentions of an entity agree.

    The stream and the attempt are bound once: written out wherever a character asks for them, they make a plan that the
    driver has to hold, optimise and compile many times over.
    """
    def made(seen: Column) -> Column:
        stream, extra = seen["stream"], seen["extra"]
        return (F.when(kind.isin("given_f", "given_m", "surname"), _named(text, kind, stream, extra))
                .when(kind == "ip", _address(text, stream, extra)).otherwise(_spelled(text, kind, stream, extra)))

    return bind(attempt, lambda n: bind(F.struct(
        _stream(key, kind, _canonical(text, kind), n).alias("stream"), F.greatest(n - (STRICT - 1), F.lit(0)).alias("extra")), made))


def _found(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), 0))


def assign(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt) of the distinct parts whose first surrogate is taken, so that they use another.

    A surrogate is taken if an earlier part (in the order of its canonical form) has it or if it is
    itself a real part of the corpus. Groups of parts with one surrogate are tiny, as surrogates are
    hashes. A form may have fewer values than entities; parts without one after ``STRICT`` attempts
    get a longer form with each attempt, whose values soon outnumber any table.
    """
    distinct = written(parts.groupBy("kind", F.col("canonical")).agg(F.min("text").alias("text")), "entities")
    real = distinct.select("kind", F.col("canonical").alias("new"), F.lit(True).alias("real"))
    now = written(distinct.withColumn("attempt", F.lit(0)), "attempts")
    while True:
        made = written(now.withColumn("new", _canonical(surrogate(F.col("text"), F.col("kind"), F.col("attempt"), key), F.col("kind"))), "surrogates")
        owner = made.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("owner"))
        taken = made.join(owner, ["kind", "new"]).join(real, ["kind", "new"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.struct("attempt", "canonical") != F.col("owner"))
        after = written(taken.select("kind", "canonical", "text", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "attempts")
        now = after.drop("again")
        if after.where("again").isEmpty():
            return written(now.where("attempt > 0").select("kind", "canonical", "attempt"), "exceptions")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced, plus ``n_replaced``.

    Equal entities get equal surrogates in all documents, different entities different ones (checked
    over the whole table), and no surrogate is an entity of the corpus. Form, letter case, script, and
    the gender of names after a title are kept; where a form has too few values, some surrogates are longer. Text around them is unchanged.

    A name is known by a title before it. Its words are then keys of that document: mentions without a
    title, in any part of the text, get the same surrogates and count as replaced.

    Null texts stay null, texts without findings stay as they are, with a count of zero. Null ids and
    repeated rows do not matter. An existing column ``n_replaced`` is replaced. An empty table gives an
    empty table.
    """
    source = keyed(docs, id_col, text_col).where(F.col("__text").isNotNull())
    parts = (source.select("__id", "__th", F.explode(F.array_distinct(_found(F.col("__text")))).alias("e"))
             .select("__id", "__th", F.explode(_words(F.col("e"))).alias("p"))
             .select("__id", "__th", "p.kind", _canonical(F.col("p.text"), F.col("p.kind")).alias("canonical"), "p.text"))
    parts = written(parts, "parts")  # far smaller than the texts: only what was found
    exceptions = assign(parts, key)
    marked = parts.join(exceptions, ["kind", "canonical"]).select("__id", "__th", F.concat("kind", F.lit("|"), "canonical").alias("k"), "attempt").distinct()
    own = written(marked.groupBy("__id", "__th").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("__again"))
                  .withColumnRenamed("__id", "__mid").withColumnRenamed("__th", "__mth"), "again")
    names = [c for c in docs.columns if c != "n_replaced"]
    full = docs.select(*names, F.xxhash64(F.col(text_col)).alias("__th"))
    # written, so its size is known: few documents hold an exception, and the planner broadcasts them only if they are small
    full = full.join(own, (F.col("__th") == F.col("__mth")) & F.col(id_col).eqNullSafe(F.col("__mid")), "left")

    def attempt(text: Column, kind: Column) -> Column:
        return F.coalesce(F.element_at("__again", F.concat(kind, F.lit("|"), _canonical(text, kind))), F.lit(0))

    def render(entity: Column) -> Column:
        new = F.transform(_words(entity), lambda p: surrogate(p["text"], p["kind"], attempt(p["text"], p["kind"]), key))
        title = F.regexp_extract(entity, f"^(?:{MALE}|{FEMALE})\\.? ", 0)
        return F.concat(F.when(_kind(entity) == "name", title).otherwise(""), F.array_join(new, " "))

    full = full.withColumn("__m", _found(F.col(text_col)))
    gaps = F.split(F.col(text_col), _ANY, -1)
    titled = F.flatten(F.transform(F.filter("__m", lambda e: _kind(e) == "name"), _words))
    words = F.array_distinct(F.transform(titled, lambda p: p["text"]))
    full = full.withColumn("__titled", titled).withColumn("__mention", F.when(F.size(words) > 0, F.concat(
        F.lit("(?<![\\p{L}\\d])(?:"), F.array_join(F.sort_array(words, asc=False), "|"), F.lit(")(?![\\p{L}\\d])"))))

    def mentions(gap: Column) -> Column:
        return F.regexp_extract_all(gap, F.col("__mention"), F.lit(0))

    def untitled(gap: Column) -> Column:
        def one(word: Column) -> Column:
            kind = F.get(F.filter("__titled", lambda p: p["text"] == word), F.lit(0))["kind"]
            return surrogate(word, kind, attempt(word, kind), key)
        return F.array_join(F.zip_with(F.split(gap, F.col("__mention"), -1), F.transform(mentions(gap), one), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    again = F.when(F.col("__mention").isNotNull(), F.aggregate(gaps, F.lit(0), lambda n, g: n + F.size(mentions(g)))).otherwise(0)
    gaps = F.when(F.col("__mention").isNotNull(), F.transform(gaps, untitled)).otherwise(gaps)
    text = F.when(F.size("__m") > 0, F.array_join(F.zip_with(gaps, F.transform("__m", render), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""))
    return full.select(*[F.coalesce(text, F.col(c)).alias(c) if c == text_col else F.col(c) for c in names],
                       F.when(F.size("__m") > 0, F.size("__m") + again).otherwise(0).cast("long").alias("n_replaced"))
