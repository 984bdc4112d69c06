"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from evloom.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, rows, _, message = compare(spark, name, QUERIES[name], ORACLES.get(name), SF, con)
    assert ok is not False, message
    assert rows >= 0


def test_scan_counts_sources_of_many_files(spark, con, monkeypatch):
    """Files above the bound are left out by the scan: a source must not be one file that grows with it."""
    from evloom.plans import structure
    from evloom.sources import files
    monkeypatch.setattr(files, "MAX_BYTES", 700)  # seven rows or so; every source has ten
    for rows, whole in ((3, True), (1000, False)):
        fn = lambda s, sf: structure.scanned_files(s, sf, rows)  # noqa: E731, B023
        ok, _, _, message = compare(spark, "scanned_files", fn, ORACLES["scanned_files"], SF, con)
        assert ok == whole, message


def test_nested_datasets_are_few_beside_the_orders(spark, con, monkeypatch, tmp_path):
    """A file per 100 orders was half a million files at size; the rows do not depend on the slices."""
    from evloom import session
    from evloom.plans import structure
    for size, most in ((None, 1), (100, 16)):
        folder = tmp_path / str(size)
        monkeypatch.setattr(session, "scratch_path", lambda *_: str(folder))  # noqa: B023
        fn = lambda s, sf: structure.nested_dataset(s, sf, **({"orders_per_file": size} if size else {}))  # noqa: E731, B023
        ok, _, _, message = compare(spark, "nested_dataset", fn, ORACLES["nested_dataset"], SF, con)
        assert ok, message
        assert len(list(folder.glob("*.json"))) <= most


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"pooled_intervals", "clustered_estimates"}


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
