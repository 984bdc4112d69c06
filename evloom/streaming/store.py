"""Tables that streams keep: a log with a compacted base, and rows whose rank only rises.

Both change in ``foreachBatch``. Rows lie in buckets by a hash of their key; a change rewrites the buckets
it touches and no other file. A batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: So many names of a batch at most are sent to every task that reads the index; more of them meet it through a shuffle.
BROADCAST_NAMES = 250_000


class Folder:
    """The few file operations that need no job, on whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._streams = jvm.org.apache.commons.io.IOUtils
        self.path = path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        """Names of the entries of a folder; none if it is not there."""
        path = self._path(f"{self.path}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def complete(self, sub: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{sub}/_SUCCESS"))

    def read(self, sub: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{sub}"))
        try:
            return self._streams.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, sub: str, text: str) -> None:
        """A whole file appears under its name, or none: written aside, then renamed."""
        aside = self._path(f"{self.path}/{sub}.tmp")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(aside, self._path(f"{self.path}/{sub}")):
            raise RuntimeError(f"{sub} exists: another writer was faster")

    def delete(self, sub: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{sub}"), True)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class MergeLog:
    """Reduced batches under ``delta``, folded now and then into a base of buckets.

    ``merge`` reduces rows (with their ``batch_id``) to one row per key with the same columns and must not
    care how rows are grouped before. The manifest of the highest number names, for every bucket, the
    version that holds it, and the batch up to which deltas are in the base: it is the only thing a reader
    trusts, so that readers see a fold whole or not at all. The newest batch is never folded, since it may
    be replayed and since a reader may ask what it changed. What a fold replaced stays for readers that
    began before it, until the next fold. One checkpoint writes a log.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
                 schema: str | StructType | None = None, buckets: int = 32, every: int = 16) -> None:
        self.spark, self.keys, self.merge, self.schema, self.buckets, self.every = spark, keys, merge, schema, buckets, every
        self.folder = Folder(spark, path)

    def manifests(self) -> list[dict]:
        """All that are there, oldest first."""
        names = sorted(int(n) for n in self.folder.names("manifest") if n.isdigit())
        return [json.loads(self.folder.read(f"manifest/{n}")) for n in names]

    def manifest(self) -> dict:
        return (self.manifests() or [{"version": 0, "through": -1, "files": {}, "buckets": self.buckets}])[-1]

    def batches(self, after: int) -> list[int]:
        """Finished batches whose number is above ``after``."""
        found = sorted(int(n.partition("=")[2]) for n in self.folder.names("delta") if n.startswith("batch_id="))
        return [b for b in found if b > after and self.folder.complete(f"delta/batch_id={b}")]

    def append(self, reduced: DataFrame, batch_id: int) -> None:
        """Write a batch, again if it is replayed; fold when ``every`` batches are open."""
        through = self.manifest()["through"]
        if batch_id <= through:
            return
        reduced.write.mode("overwrite").parquet(f"{self.folder.path}/delta/batch_id={batch_id}")
        if len(self.batches(through)) > self.every:
            self.compact()

    def _deltas(self, batches: list[int]) -> DataFrame:
        root = f"{self.folder.path}/delta"
        reader = self.spark.read.option("basePath", root)
        if self.schema:
            reader = reader.schema(self.schema)
        return reader.parquet(*[f"{root}/batch_id={b}" for b in batches]).withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def _base(self, files: dict[str, int], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/base/version={v}/bucket={b}" for b, v in sorted(files.items())])

    def paths(self) -> list[str]:
        """The folders a read touches."""
        now = self.manifest()
        return [f"base/version={v}/bucket={b}" for b, v in sorted(now["files"].items())] + [f"delta/batch_id={b}" for b in self.batches(now["through"])]

    def rows(self) -> DataFrame:
        """Base and open batches, not yet merged; every row says its ``batch_id``."""
        now = self.manifest()
        open_batches = self.batches(now["through"])
        if not open_batches:
            if not self.schema:
                raise FileNotFoundError(f"no finished batch in {self.folder.path}")
            kind = self.spark.createDataFrame([], self.schema)
            return kind if "batch_id" in kind.columns else kind.withColumn("batch_id", F.lit(None).cast("bigint"))
        deltas = self._deltas(open_batches)
        return self._base(now["files"], deltas.schema).unionByName(deltas) if now["files"] else deltas

    def compact(self) -> None:
        """Fold all open batches but the newest into the buckets they touch."""
        before = self.manifest()
        closed = self.batches(before["through"])[:-1]
        if not closed:
            return
        version, n = before["version"] + 1, before["buckets"]
        deltas = self._deltas(closed).withColumn("bucket", bucket_of(self.keys, n))
        touched = [str(r[0]) for r in deltas.select("bucket").distinct().collect()]  # at most n numbers
        old = {b: v for b, v in before["files"].items() if b in touched}
        rows = deltas.drop("bucket")
        if old:
            rows = self._base(old, rows.schema).unionByName(rows)
        merged = self.merge(rows).select(rows.columns).withColumn("bucket", bucket_of(self.keys, n))
        merged.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/base/version={version}")
        now = {"version": version, "through": closed[-1], "files": {**before["files"], **dict.fromkeys(touched, version)}, "buckets": n}
        self.folder.publish(f"manifest/{version}", json.dumps(now))
        self._sweep(before, now)

    def _sweep(self, before: dict, now: dict) -> None:
        """Drop what neither this manifest nor the one before it names."""
        held = {(b, v) for m in (before, now) for b, v in m["files"].items()}
        for folder in self.folder.names("base"):
            version = int(folder.partition("=")[2])
            names = {b: f"bucket={b}" for b in (x.partition("=")[2] for x in self.folder.names(f"base/{folder}") if x.startswith("bucket="))}
            gone = [name for b, name in names.items() if (b, version) not in held]
            for sub in [f"base/{folder}"] if len(gone) == len(names) else [f"base/{folder}/{g}" for g in gone]:
                self.folder.delete(sub)
        for name in self.folder.names("delta"):
            if name.startswith("batch_id=") and int(name.partition("=")[2]) <= before["through"]:
                self.folder.delete(f"delta/{name}")
        for name in self.folder.names("manifest"):
            if name.isdigit() and int(name) < before["version"]:
                self.folder.delete(f"manifest/{name}")


class RankedTable:
    """Rows with a ``rank`` that only rises, found by the names they answer to.

    ``keys`` holds the rows as they landed, each under a number, and is never written again. ``names`` is an index
    in buckets by a hash of the name: the numbers, and their buckets, of the rows that answer to it. ``rows`` holds
    number and rank of the rows that ever rose; a row that is not there has rank 0. A change reads the index buckets
    of its names and the rank buckets they lead to, and writes only those in which a rank really rises. So only
    numbers travel with a change, and what a row carries is looked up when it is read.

    The manifest of the highest number names the version of every rank bucket, so that a batch is seen whole or not
    at all. A replayed batch finds its version whole, or starts from the manifest before it and writes it again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 32) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.folder = Folder(spark, path)
        #: ranks that the names have been given so far: what a batch repeats needs no search
        self.applied = MergeLog(spark, f"{self.path}/applied", ["name"], lambda rows: rows.groupBy("name").agg(
            F.max("rank").alias("rank"), F.max("batch_id").alias("batch_id")), "name string, rank int, batch_id bigint", buckets)

    def land(self, rows: DataFrame | None, names: DataFrame) -> None:
        """Write the rows, all at rank 0, and the index. ``names``: the key and a name; null names find nothing.

        A row has few names: they are gathered by row. Without ``rows`` these are the different keys of ``names``.
        """
        c, n = F.col, self.buckets
        part = bucket_of([self.key], 4 * n)
        if rows is None:
            dealt = (names.select(self.key, "name").withColumn("__part", part).repartition(c("__part"))
                     .groupBy(self.key, "__part").agg(F.collect_set("name").alias("__names")))
        else:
            gathered = names.groupBy(self.key).agg(F.collect_set("name").alias("__names"))
            dealt = rows.join(gathered, self.key, "left").withColumn("__part", part).repartition(c("__part"))
        # numbered in the job that writes them, so that every file has its numbers for good
        numbered = dealt.withColumn("__row", F.monotonically_increasing_id()).withColumn("bucket", c("__part") % n).drop("__part")
        numbered.write.partitionBy("bucket").parquet(f"{self.path}/keys")
        index = (self._keys().where(c(self.key).isNotNull()).select("__row", "bucket", F.explode("__names").alias("name"))
                 .withColumn("name_bucket", bucket_of(["name"], n)))
        # a name may be very common: its rows need not meet in one task to be written
        salted = index.repartition(c("name_bucket"), c("bucket") % 4).sortWithinPartitions("name_bucket", "name", "bucket", "__row")
        salted.write.partitionBy("name_bucket").parquet(f"{self.path}/names")

    def _keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys")

    def _manifest(self, before: int | None = None) -> dict:
        """Version of every rank bucket, now or before a batch."""
        names = [int(x) for x in self.folder.names("manifest") if x.isdigit()]
        held = [x for x in names if before is None or x < before]
        return json.loads(self.folder.read(f"manifest/{max(held)}")) if held else {}

    def _ranks(self, files: dict[str, int]) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/rows").schema("__row bigint, rank int, rises boolean, version bigint, bucket int")
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(files.items())]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], "__row bigint, rank int, rises boolean, version bigint, bucket int")

    def rows(self) -> DataFrame:
        ranks = self._ranks(self._manifest()).select("__row", F.col("rank").alias("__rank"))
        return self._keys().join(ranks, "__row", "left").withColumn("rank", F.coalesce("__rank", F.lit(0))).drop("__row", "__rank", "__names", "bucket")

    def _numbers(self, df: DataFrame, column: str) -> list[int]:
        return [r[0] for r in df.select(column).distinct().collect()]  # at most one number per bucket

    def raise_ranks(self, changes: DataFrame, batch_id: int) -> DataFrame:
        """Raise the rows that answer to a changed name; returns the rows of the table that rose (key, rank). ``changes``: name, rank."""
        c = F.col
        staged = f"{self.path}/staged/batch_id={batch_id}"
        before = self._manifest(batch_id)
        nothing = self._keys().select(self.key, F.lit(0).alias("rank")).limit(0)
        if self._whole(batch_id):
            self.applied.append(self.spark.read.schema("name string, rank int").parquet(f"{staged}/asked"), batch_id)
            return self._risen(batch_id)
        known = self.applied.rows().where(c("batch_id") < batch_id).groupBy("name").agg(F.max("rank").alias("__known"))
        asked = (changes.where("name is not null and rank > 0").groupBy("name").agg(F.max("rank").alias("rank"))
                 .join(known, "name", "left").where(c("rank") > F.coalesce("__known", F.lit(0))).select("name", "rank"))
        # written, so that its size is known: a few names are sent to the index, which then stays where it is
        asked.write.mode("overwrite").parquet(f"{staged}/asked")
        asked = self.spark.read.schema(asked.schema).parquet(f"{staged}/asked")
        if not (asked_buckets := self._numbers(asked.select(bucket_of(["name"], self.buckets).alias("b")), "b")):
            return nothing
        index = self.spark.read.parquet(f"{self.path}/names").where(c("name_bucket").isin(asked_buckets))
        few = asked.count() <= BROADCAST_NAMES
        hit = index.join(F.broadcast(asked) if few else asked, "name").select("__row", "bucket", "rank")
        hit.write.mode("overwrite").parquet(f"{staged}/hit")
        hit = self.spark.read.schema(hit.schema).parquet(f"{staged}/hit")
        touched = self._numbers(hit, "bucket")
        old = self._ranks({b: v for b, v in before.items() if int(b) in touched})
        # several names may lead to a row
        both = hit.select("__row", "bucket", c("rank").alias("new"), F.lit(0).alias("old")).unionByName(
            old.select("__row", "bucket", F.lit(0).alias("new"), c("rank").alias("old")))
        met = both.withColumn("__part", bucket_of(["__row"], 4)).repartition(c("bucket"), c("__part"))
        ranked = met.groupBy("bucket", "__part", "__row").agg(F.max("new").alias("new"), F.max("old").alias("old")).select(
            "bucket", "__row", F.greatest("new", "old").alias("rank"), (c("new") > c("old")).alias("rises"))
        version = f"rows/version={batch_id}"
        ranked.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{version}")
        now = self._ranks(dict.fromkeys(map(str, touched), batch_id)).where("rises")
        rising = self._numbers(now, "bucket")
        for b in set(touched) - set(rising):
            self.folder.delete(f"{version}/bucket={b}")
        if rising:
            self.folder.delete(f"manifest/{batch_id}")
            self.folder.publish(f"manifest/{batch_id}", json.dumps({**before, **dict.fromkeys(map(str, rising), batch_id)}))
        self.applied.append(asked, batch_id)
        return self._risen(batch_id) if rising else nothing

    def _own(self, batch_id: int) -> list[str]:
        """The buckets that a batch wrote."""
        return [b for b, v in self._manifest(batch_id + 1).items() if v == batch_id]

    def _whole(self, batch_id: int) -> bool:
        """Whether a batch is seen already and all it wrote is still there."""
        own = {f"bucket={b}" for b in self._own(batch_id)}
        return bool(own) and own <= set(self.folder.names(f"rows/version={batch_id}")) and self.folder.complete(f"staged/batch_id={batch_id}/asked")

    def _risen(self, batch_id: int) -> DataFrame:
        own = self._own(batch_id)
        risen = self._ranks(dict.fromkeys(own, batch_id)).where("rises").select("__row", "rank")
        return risen.join(self._keys().where(F.col("bucket").isin([int(b) for b in own])).select("__row", self.key), "__row").select(self.key, "rank")

    def forget(self, before: int) -> None:
        """Drop what belongs only to batches below ``before``; those are committed and never come again."""
        for name in self.folder.names("staged"):
            if int(name.partition("=")[2]) < before:
                self.folder.delete(f"staged/{name}")
        numbers = sorted(int(x) for x in self.folder.names("manifest") if x.isdigit())
        # a replay of ``before`` starts from the last manifest below it
        kept = [x for x in numbers if x >= before] + [x for x in numbers if x < before][-1:]
        held = {(b, v) for x in kept for b, v in json.loads(self.folder.read(f"manifest/{x}")).items()}
        for folder in self.folder.names("rows"):
            version = int(folder.partition("=")[2])
            for name in self.folder.names(f"rows/{folder}"):
                if name.startswith("bucket=") and version < before and (name.partition("=")[2], version) not in held:
                    self.folder.delete(f"rows/{folder}/{name}")
        for x in set(numbers) - set(kept):
            self.folder.delete(f"manifest/{x}")


def cascade(tables: list[RankedTable], changes: DataFrame, batch_id: int) -> None:
    """Ranks rise in the first table by its names; the keys that rose are the names of the next table, and so on."""
    def down(found: DataFrame, table: RankedTable) -> DataFrame:
        return table.raise_ranks(found, batch_id).select(F.col(table.key).alias("name"), "rank")
    reduce(down, tables, changes)
    for table in tables:
        table.forget(batch_id)
