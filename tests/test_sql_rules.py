"""Queries next to their SQL on tables where the SQL once stated another rule."""

import os

import duckdb
from compare import TABLES, compare, connect

from evloom.plans import load

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def _tables(path, **changed):
    """The smallest tables in a folder of their own, some of them replaced by the rows of a query."""
    for name in TABLES:
        if name in changed:
            duckdb.sql(f"COPY ({changed[name]}) TO '{path}/{name}.parquet'")
        else:
            os.symlink(f"{SMALL}/{name}.parquet", f"{path}/{name}.parquet")
    return str(path)


def test_regions_of_a_page_that_needs_many_rounds(spark, tmp_path):
    """A page on which a fifth round of merging still finds near regions."""
    sf = _tables(tmp_path, lineitem="SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey BETWEEN 113900 AND 113910")
    ok, rows, _, message = compare(spark, "merged_regions", QUERIES["merged_regions"], ORACLES["merged_regions"], sf, connect(sf))
    assert ok and rows, message


def test_agreement_where_nothing_is_matched(spark, tmp_path):
    """Every reference row twice, so that no experiment has a single partner: counts are 0 and the denominator stays."""
    part = f"SELECT p.* REPLACE (CAST(p_partkey + r.range * 1000000 AS BIGINT) AS p_partkey) FROM '{SMALL}/part.parquet' p, range(2) r"
    sf = _tables(tmp_path, part=part)
    ok, _, _, message = compare(spark, "agreement_summary", QUERIES["agreement_summary"], ORACLES["agreement_summary"], sf, connect(sf))
    assert ok, message
    got = QUERIES["agreement_summary"](spark, sf).first()
    assert got["exact_matches"] == got["compared_fields"] == 0 and got["manual_nonmissing_fields"] > 0 and got["recovery_agreement"] == 0
