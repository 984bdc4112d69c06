"""Distributed building blocks: connected components, dense numbering, exact medians."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from evloom.session import cut, written


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; key columns of the left side survive once."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    two_parents = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return two_parents.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of
    the graph, not with its diameter, and each step is an aggregate with map-side combine plus an
    equi-join that adaptive execution can split when one node owns a large share of the edges.
    Every round is cut through the shared checkpoint folder. A cheap signature taken while the
    round is written tells when to run the exact test. Nodes without edges are not returned.
    """
    current = cut(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
                  .where(F.col("a") != F.col("b")).distinct())
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        step = _small_star(_large_star(current)).observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        current = cut(step)
        after = (seen.get["n"], seen.get["h"])
        if after[0] == 0 or (after == before and _is_star_forest(current)):
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 0, 1, 2, … in the given order without sending them through one task.

    Range partitions are sorted and numbered on their own; only the partition sizes, one row per
    partition, are summed in one place. The sorted rows are cut first, so a recomputed partition
    cannot change the numbering.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("__pid", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__pid").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # one row per partition, so the broadcast side is bounded by the partition count
    joined = placed.join(F.broadcast(offsets.select("__pid", "__before", "__first")), "__pid")
    return joined.withColumn(name, F.col("__seq") - F.col("__first") + F.col("__before")).drop(
        "__pid", "__seq", "__before", "__first", "__n")


def group_ordinals(df: DataFrame, keys: list[str], order: list[Column], name: str, block: int = 100_000) -> DataFrame:
    """Number the rows of every group 1, 2, 3, … in the given order, for groups of any size.

    All rows are numbered through range partitions by (keys, order); a group is then a span of numbers, and
    a row's ordinal its distance from the start of the span. Spans are looked up by key and block of
    numbers, so that a lookup key has at most ``block`` rows however large its group is. Null keys are a
    group of their own. The running number stays in the result as ``name`` + "_at".
    """
    at = f"{name}_at"
    placed = cut(dense_index(df, [*[F.asc_nulls_first(k) for k in keys], *order], at))
    spans = placed.groupBy(*keys).agg(F.min(at).alias("__from"), F.max(at).alias("__to"))
    blocks = F.sequence(F.floor(F.col("__from") / block), F.floor(F.col("__to") / block))
    starts = spans.select(*keys, "__from", F.explode(blocks).alias("__block"))
    found = null_safe(placed.withColumn("__block", F.floor(F.col(at) / block)), starts, [*keys, "__block"])
    return found.withColumn(name, F.col(at) - F.col("__from") + 1).drop("__from", "__block")


def next_in_group(numbered: DataFrame, keys: list[str], name: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the following row of the same group, under new names; null for the last one.

    ``numbered`` comes from ``group_ordinals``. Neighbours find each other by their running numbers, all
    different, so no group is ordered in one task.
    """
    at = f"{name}_at"
    following = numbered.where(F.col(name) > 1).select((F.col(at) - 1).alias(at), *[F.col(c).alias(new) for c, new in columns.items()])
    return numbered.join(following, at, "left")


def neighbours(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str], block: int = 100_000) -> DataFrame:
    """Rows with columns of the following row of the same group under new names; null for the last one. Groups may have any size.

    A window looks ahead within groups of at most ``block`` rows, which move once. Larger groups are spread over range partitions.
    """
    large = written(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block).select(*keys), "large_groups")
    some = not large.isEmpty()
    spot = Window.partitionBy(*keys).orderBy(*order)
    few = null_safe(df, large, keys, "left_anti") if some else df
    found = few.select(*df.columns, *[F.lead(x).over(spot).alias(new) for x, new in columns.items()])
    return found.unionByName(_neighbours_by_range(null_safe(df, large, keys, "left_semi"), keys, order, columns, block)) if some else found


def _neighbours_by_range(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str], block: int) -> DataFrame:
    """The same for groups of any size.

    Range partitions by (keys, order) are written in order. A window then looks ahead within blocks of at most ``block`` rows of one
    partition; the row after a block is the first of the next one, and these few rows are joined to the ends of the blocks.
    """
    c = F.col
    sorted_by = [*[F.asc_nulls_first(k) for k in keys], *order]
    placed = written(df.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by).withColumn("__pid", F.spark_partition_id()).withColumn(
        "__seq", F.monotonically_increasing_id()), "placed")
    spot = Window.partitionBy("__pid", "__block").orderBy("__seq")
    told = F.struct(*[c(k).alias(f"k{n}") for n, k in enumerate(keys)], *[c(x).alias(f"c{n}") for n, x in enumerate(columns)])
    ahead = placed.withColumn("__block", F.floor(c("__seq") / block)).withColumn("__told", told).withColumn("__next", F.lead("__told").over(spot))
    # one row per block; blocks of a partition and partitions follow each other in the order of their numbers
    heads = written(placed.withColumn("__block", F.floor(c("__seq") / block)).groupBy("__pid", "__block").agg(F.min_by(told, "__seq").alias("__head")), "heads")
    after = heads.select("__pid", "__block", F.lead("__head").over(Window.orderBy("__pid", "__block")).alias("__head"))
    found = ahead.join(F.broadcast(after), ["__pid", "__block"], "left").withColumn("__next", F.coalesce("__next", "__head"))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"__next.k{n}")) for n, k in enumerate(keys)], c("__next").isNotNull())
    return found.select(*df.columns, *[F.when(same, c(f"__next.c{n}")).alias(new) for n, new in enumerate(columns.values())])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median",
                 weight: str | None = None, slices: int = 32) -> DataFrame:
    """Exact median per group, for groups of any size.

    Equal values collapse into counts first. Each group is then cut into value slices at
    approximate quantiles (any cut points give the right answer, good ones give even slices), and
    only the slice or two that hold the middle ranks are ordered. ``weight`` names a column of
    multiplicities when the input is already counted.
    """
    counted = cut(df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("__n")))
    points = [i / slices for i in range(1, slices)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, points, 1000).alias("__cuts"), F.sum("__n").alias("__total"))
    placed = null_safe(counted, cuts, keys).withColumn(
        "__slice", F.size(F.filter("__cuts", lambda c: c < F.col(value))))
    sizes = placed.groupBy(*keys, "__slice").agg(F.sum("__n").alias("__size"), F.max("__total").alias("__total"))
    upto = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ranks of the two middle rows (equal for an odd count), 1-based
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    middle = (sizes.withColumn("__end", F.sum("__size").over(upto)).withColumn("__start", F.col("__end") - F.col("__size"))
              .where((F.col("__end") >= low) & (F.col("__start") < high))
              .select(*keys, "__slice", "__start"))
    within = Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (null_safe(placed.drop("__cuts"), middle, [*keys, "__slice"])
              .withColumn("__end", F.sum("__n").over(within) + F.col("__start"))
              .withColumn("__begin", F.col("__end") - F.col("__n")))
    pick = lambda r: F.max(F.when((F.col("__begin") < r) & (F.col("__end") >= r), F.col(value)))
    return ranked.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias(name))
