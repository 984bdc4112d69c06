"""Compacted logs and rank tables: whole reads of few folders, replays that change nothing, untouched files left alone."""

import glob
import os
import shutil
from collections import Counter

from evloom.streaming import living as lv
from evloom.streaming.store import MergeLog, RankedTable
from pyspark.sql import functions as F


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def files(path):
    return sorted(p for p in glob.glob(f"{local(path)}/**/*.parquet", recursive=True))


def summed(spark, path, **options):
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch_id").alias("batch_id"))
    return MergeLog(spark, path, ["k"], merge, "k int, n bigint, batch_id bigint", **options)


def batch(spark, number, keys):
    return spark.createDataFrame([(k, number + 1) for k in keys], "k int, n bigint").coalesce(1)


def test_log_folds_and_replays(spark):
    path = lv.folders(spark, "log")[0]
    log, want = summed(spark, path, buckets=4, every=4), Counter()
    assert log.rows().count() == 0 and log.manifest()["through"] == -1
    for number in range(19):
        keys = range(number % 3, 12, 3)
        for _ in range(1 + (number % 5 == 0)):  # some batches come twice
            log.append(batch(spark, number, keys), number)
        want.update(dict.fromkeys(keys, number + 1))
        if number % 6 == 5:
            assert {r["k"]: r["n"] for r in log.merge(log.rows()).collect()} == want
    now = log.manifest()
    assert now["version"] >= 3 and now["through"] < 18 == log.batches(-1)[-1]
    # a read opens the base and the few open batches, and nothing else is left but the generation before
    read = {f"{log.folder.path}/{p}" for p in log.paths()}
    assert len(log.batches(now["through"])) <= 5 and len(log.manifests()) <= 2
    assert {os.path.dirname(local(f)) for f in log.rows().inputFiles()} <= {local(p) for p in read}
    assert len(log.folder.names("delta")) <= 12 and len(read) <= 4 + 5
    # a replay of a folded batch
    before = files(path)
    log.append(batch(spark, 99, range(12)), now["through"])
    assert files(path) == before and {r["k"]: r["n"] for r in log.merge(log.rows()).collect()} == want


def test_fold_rewrites_touched_buckets_only(spark):
    path = lv.folders(spark, "buckets")[0]
    log = summed(spark, path, buckets=8, every=100)
    for number, keys in enumerate((range(40), range(40), [3], [3])):
        log.append(batch(spark, number, keys), number)
        log.compact()
    versions = Counter(log.manifest()["files"].values())
    assert sorted(versions.values()) == [1, 7] and len(versions) == 2
    # an unfinished batch is not read
    log.append(batch(spark, 4, range(40)), 4)
    log.folder.delete("delta/batch_id=4/_SUCCESS")
    assert {r["k"]: r["n"] for r in log.merge(log.rows()).collect()} == {k: 3 + (7 if k == 3 else 0) for k in range(40)}


def test_fold_that_failed_before_its_manifest(spark):
    path = lv.folders(spark, "failed")[0]
    log = summed(spark, path, buckets=2, every=100)
    for number in range(3):
        log.append(batch(spark, number, range(6)), number)
    publish = log.folder.publish
    log.folder.publish = lambda *_: 1 / 0
    try:
        log.compact()
    except ZeroDivisionError:
        pass
    want = dict.fromkeys(range(6), 6)
    assert {r["k"]: r["n"] for r in log.merge(log.rows()).collect()} == want
    log.folder.publish = publish
    log.compact()
    assert {r["k"]: r["n"] for r in log.merge(log.rows()).collect()} == want and log.manifest()["through"] == 1


def test_snapshot_after_folds(spark):
    """Folding is invisible to the reader, the change of the newest batch included."""
    rows = [(k, f"t{(k + b) // 4}", "active" if b < 3 else "corrected", b, f"s{b}") for b in range(6) for k in range(10) if (k + b) % 3]
    frame = spark.createDataFrame(rows, "key int, title string, status string, seq int, source string")
    found = []
    for every in (100, 2):
        path = lv.folders(spark, "snap")[0]
        log = lv.upsert_log(spark, path, "key")
        log.every = every
        for b in range(6):
            reduced = frame.where(F.col("seq") == b).groupBy("key").agg(
                F.max(F.struct("seq", "title")).alias("last"), F.lit(1 if b >= 3 else 0).alias("rank"), F.collect_set("source").alias("sources"))
            log.append(reduced, b)
        found.append(sorted(map(repr, lv.read_snapshot(spark, path, "key", ["title"]).collect())))
    assert found[0] == found[1] and len(found[0]) == 10 and any("change='changed'" in r for r in found[0])


def test_rank_table(spark):
    path = lv.folders(spark, "ranks")[0]
    table = RankedTable(spark, path, "id", buckets=8)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id int, payload string")
    names = spark.createDataFrame([(i, n) for i in range(60) for n in (f"n{i}", f"g{i % 10}")] + [(5, None)], "id int, name string")
    table.land(rows, names)
    before = files(f"{path}/rows")

    def changes(*pairs):
        return spark.createDataFrame(list(pairs), "name string, rank int")

    risen = table.raise_ranks(changes(("n7", 3), ("n7", 2), ("nobody", 4), (None, 4), ("n9", 0)), 0)
    assert sorted(map(tuple, risen.collect())) == [(7, 3)]
    after = files(f"{path}/rows")
    folder = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(folder) == 1  # one bucket has new files, all others keep theirs
    table.raise_ranks(changes(("n7", 3)), 0)  # the same batch again
    assert table.raise_ranks(changes(("n7", 1)), 1).count() == 0 and table.rows().count() == 60
    want = {i: 3 if i == 7 else 4 if i % 10 == 2 else 0 for i in range(60)}
    # a batch that fails between the staged buckets and the rows, with one bucket already gone
    table.raise_ranks(changes(("g2", 4)), 2)
    lost = {os.path.dirname(f) for f in set(files(f"{path}/rows")) - set(after)}
    shutil.rmtree(sorted(lost)[0])
    table.raise_ranks(changes(("g2", 4)), 2)
    assert {r["id"]: r["rank"] for r in table.rows().collect()} == want and {r["payload"] for r in table.rows().collect()} == {f"p{i}" for i in range(60)}
    table.forget(2)
    assert table.folder.names("staged") == ["batch_id=2"]


def test_change_does_not_write_what_rows_carry(spark):
    """A batch writes numbers and ranks of the rows that rose: what rows carry and rows that never rose are not written again."""
    path = lv.folders(spark, "carried")[0]
    table = RankedTable(spark, path, "id", buckets=2)
    rows = spark.createDataFrame([(i, f"payload {i}") for i in range(40)], "id int, payload string")
    table.land(rows, spark.createDataFrame([(i, f"n{i % 4}") for i in range(40)], "id int, name string"))
    keys = files(f"{path}/keys")
    assert table.raise_ranks(spark.createDataFrame([("n1", 2)], "name string, rank int"), 0).count() == 10
    written = spark.read.parquet(f"{path}/rows")
    assert "payload" not in written.columns and written.count() == 10 and files(f"{path}/keys") == keys
    # the same names no higher than before: nothing is searched or written
    assert table.raise_ranks(spark.createDataFrame([("n1", 1)], "name string, rank int"), 1).count() == 0 and table.folder.names("staged/batch_id=1") == ["asked"]
    assert {(r["id"], r["payload"], r["rank"]) for r in table.rows().collect()} == {(i, f"payload {i}", 2 if i % 4 == 1 else 0) for i in range(40)}


def test_more_names_than_are_broadcast(spark, monkeypatch):
    from evloom.streaming import store
    monkeypatch.setattr(store, "BROADCAST_NAMES", 1)
    path = lv.folders(spark, "many")[0]
    table = RankedTable(spark, path, "id", buckets=4)
    table.land(None, spark.createDataFrame([(i, f"n{i % 4}") for i in range(40)] + [(3, None), (99, None), (3, "n3")], "id int, name string"))
    risen = table.raise_ranks(spark.createDataFrame([("n1", 2), ("n3", 4)], "name string, rank int"), 0)
    assert {(r["id"], r["rank"]) for r in risen.collect()} == {(i, 2 if i % 4 == 1 else 4) for i in range(40) if i % 2}
    assert table.rows().count() == 41 and table.rows().where("rank = 0").count() == 21


def test_cascade_is_the_batch_form(spark):
    documents = spark.createDataFrame([("d1", "10.1234/A", "p1", "completed"), ("d2", None, "p2", "completed"), ("d3", "10.1234/c", None, "uploaded"), ("d4", None, None, "completed")],
                                      "document_hash string, doi string, publication_id string, status string")
    evidence = spark.createDataFrame([("m1", "d1"), ("m1", "d2"), ("m2", "d3"), ("m3", "d4")], "measurement_id string, document_hash string")
    changes = spark.createDataFrame([("p1", "https://doi.org/10.1234/a", "corrected"), ("p2", None, "retracted"), ("p3", "10.1234/C", "active")],
                                    "publication_id string, doi string, status string")
    path, mark = lv.folders(spark, "cascade")
    lv.land_cascade(documents, evidence, path, buckets=4)
    landed = lv.folders(spark, "changes")[0]
    changes.coalesce(1).write.parquet(landed)
    lv.run_cascade(lv.landed(spark, landed, changes.schema), path, mark, buckets=4)
    batch = lv.invalidate(changes, documents)
    key = lambda df: sorted(map(tuple, df.select("document_hash", "publication_status", "status").collect()))
    assert key(lv.read_documents(spark, path, buckets=4)) == key(batch)
    assert sorted(map(tuple, lv.read_stale(spark, path, buckets=4).collect())) == [("m1", "publication status: retracted")]
