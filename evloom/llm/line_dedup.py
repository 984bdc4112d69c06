"""Line deduplication by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.llm.tables import keyed


def _prints(docs: DataFrame, id_col: str, text_col: str, window: int, min_chars: int) -> DataFrame:
    """(__id, __th, line, windows): selected positions, their line digest and the windows they stand for.

    ``line`` is a digest of 128 bits. ``windows`` holds (start, content, chars): every window of lines whose smallest
    hash is at this position, so that each window of a text is named once, and the line alone if it has ``min_chars``.
    """
    source = keyed(docs, id_col, text_col).where(F.col("__text").isNotNull())
    trimmed = F.transform(F.split("__text", "\n"), lambda l: F.btrim(l))
    lines = (source.select("__id", "__th", trimmed.alias("__l"))
             .select("__id", "__th", F.transform("__l", lambda l: F.xxhash64(l)).alias("__h"),
                     F.transform("__l", lambda l: F.xxhash64(F.lit("line"), l)).alias("__g"),
                     F.transform("__l", lambda l: F.char_length(l)).alias("__c")))
    last = F.size("__h") - 1

    def hashes(start: Column) -> Column:
        return F.slice(F.col("__h"), start + 1, window)

    # position of the smallest hash of the window; array_max of (negated order, position) takes the last on ties
    def minimum(start: Column) -> Column:
        low = F.array_min(hashes(start))
        return start + F.array_max(F.transform(hashes(start), lambda h, i: F.when(h == low, i).otherwise(-1)))

    starts = F.when(last >= window - 1, F.sequence(F.lit(0), last - (window - 1))).otherwise(F.array().cast("array<int>"))
    lines = lines.withColumn("__m", F.transform(starts, minimum))

    def named(start: Column, width: int) -> Column:
        part = [F.xxhash64(F.slice(F.col(name), start + 1, width)) for name in ("__h", "__g")]
        return F.struct(start.alias("start"), F.struct(part[0].alias("a"), part[1].alias("b")).alias("content"),
                        F.slice(F.col("__c"), start + 1, width).alias("chars"))

    def described(p: Column) -> Column:
        held = F.filter(F.sequence(F.greatest(F.lit(0), p - (window - 1)), p), lambda s: F.get(F.col("__m"), s) == p)
        alone = F.filter(F.array(p), lambda s: F.get(F.col("__c"), s) >= min_chars)
        return F.struct(F.struct(F.get("__h", p).alias("a"), F.get("__g", p).alias("b")).alias("line"), p.alias("p"),
                        F.concat(F.transform(held, lambda s: named(s, window)), F.transform(alone, lambda s: named(s, 1))).alias("windows"))

    long = F.filter(F.sequence(F.lit(0), last), lambda p: F.get(F.col("__c"), p) >= min_chars)
    # described before the explode, so that the arrays of a long document are not repeated for each of its lines
    found = F.explode(F.transform(F.array_distinct(F.concat(F.col("__m"), long)), described))
    return lines.select("__id", "__th", found.alias("__d")).select("__id", "__th", "__d.*")


def _repeated(rows: DataFrame, key: str, place: Column) -> DataFrame:
    """(repeated, __first): values of the pair ``key`` that stand at two places or more, and the earliest.

    Grouped by the parts and joined by the whole: the join then deals out both sides anew, and a hot value may be split.
    """
    return (rows.groupBy(F.col(f"{key}.a").alias("a"), F.col(f"{key}.b").alias("b")).agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
            .where(~F.col("__first").eqNullSafe(F.col("__last"))).select(F.struct("a", "b").alias("repeated"), "__first"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_chars: int = 40) -> DataFrame:
    """(__id, __th, __lines): per document the positions of lines that lie in a later copy of a repeated run.

    1. *Fingerprints*: the smallest line hash of every window of ``window`` lines is selected (the last
       one on ties), so two texts that share a run of ``window`` lines share a fingerprint. So is every
       line of ``min_chars`` characters.
    2. *Positions are joined* on fingerprints that occur at two places or more.
    3. *Extension*: the windows of such a position are compared as a whole with the earliest equal window.
       A window that has an earlier copy ties its lines together, so from any fingerprint a run grows to the left and
       to the right as long as the next window agrees as well, however short its lines are.
    4. Evidence is counted over the whole run: its lines are marked if they have ``min_chars`` characters together.
       Places are ordered by id, content hash and position, and the earliest place of a line is never marked.

    Windows of a run may have their earliest copies in different documents.
    """
    prints = _prints(docs, id_col, text_col, window, min_chars)
    shared = _repeated(prints, "line", F.struct("__id", "__th", "p")).select("repeated")
    windows = (prints.join(shared, F.col("line") == F.col("repeated")).select("__id", "__th", F.explode("windows").alias("__w"))
               .select("__id", "__th", "__w.*"))
    # the characters belong to the place only so that both uses of the windows read the same columns, shuffled once
    place = F.struct("__id", "__th", "start", "chars")
    later = (windows.join(_repeated(windows, "content", place), F.col("content") == F.col("repeated"))
             .where(~place.eqNullSafe(F.col("__first"))))
    ties = later.select("__id", "__th", "start", F.posexplode("chars").alias("__i", "__n")).select(
        "__id", "__th", (F.col("start") + F.col("__i")).alias("__line"), "__n", (F.col("__i") > 0).alias("__tied"))
    # dealt once by document, which then serves the grouping and both windows
    covered = (ties.repartition("__id", "__th").groupBy("__id", "__th", "__line")
               .agg(F.max("__n").alias("__n"), F.max("__tied").alias("__tied")))
    run = F.sum(F.when(F.col("__tied"), 0).otherwise(1)).over(Window.partitionBy("__id", "__th").orderBy("__line"))
    covered = covered.withColumn("__run", run)
    size = F.sum("__n").over(Window.partitionBy("__id", "__th", "__run"))
    marked = covered.withColumn("__size", size).where(F.col("__size") >= min_chars)
    return marked.groupBy("__id", "__th").agg(F.array_sort(F.collect_set("__line")).alias("__lines"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_chars: int = 40) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text, plus ``n_lines`` and ``n_removed_lines``.

    Every row stays, with all its columns; a text whose lines are all repeated becomes empty. Null
    text stays null with zero lines; an empty text has one (empty) line. Null ids rank first. Rows
    that share id and text are one document and share the result: such a row never counts as a later copy of
    itself. Existing columns named ``n_lines`` or ``n_removed_lines`` are replaced; all others stay as they are,
    whatever their names. An empty table gives an empty table.
    """
    marked = (repeated_lines(docs, id_col, text_col, window, min_chars)
              .withColumnRenamed("__id", "__mid").withColumnRenamed("__th", "__mth"))
    own = docs.drop("n_lines", "n_removed_lines")
    names = own.columns
    # positions instead of names while columns of this function stand beside those of the user
    at = {name: f"u{i}" for i, name in enumerate(names)}
    own = own.toDF(*at.values()).withColumn("__th", F.xxhash64(F.col(at[text_col])))
    joined = own.join(marked, (F.col("__th") == F.col("__mth")) & F.col(at[id_col]).eqNullSafe(F.col("__mid")), "left")
    split = joined.withColumn("__l", F.split(at[text_col], "\n"))
    count = F.when(F.col(at[text_col]).isNull(), F.lit(0)).otherwise(F.size("__l")).cast("long")
    # kept lines are the gaps between deleted positions; copying gap by gap stays linear in the lines
    edges = F.concat(F.array(F.lit(-1)), F.col("__lines"), F.array(F.size("__l")))
    split = split.withColumn("__e", F.when(F.col("__lines").isNotNull(), edges))
    gaps = F.transform(F.sequence(F.lit(1), F.size("__e") - 1), lambda k: F.slice(
        F.col("__l"), F.element_at("__e", k) + 2, F.element_at("__e", k + 1) - F.element_at("__e", k) - 1))
    text = F.when(F.col("__lines").isNull(), F.col(at[text_col])).otherwise(F.array_join(F.flatten(gaps), "\n"))
    removed = F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0)).cast("long")
    return split.select(*[(text if name == text_col else F.col(at[name])).alias(name) for name in names],
                        count.alias("n_lines"), removed.alias("n_removed_lines"))
