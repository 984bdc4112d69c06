"""Stream rules give the same rows however the input is landed."""

import pytest
from compare import _rows

from evloom.plans import living
from evloom.streaming import living as lv

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_check_activity"])
def test_number_of_files_does_not_matter(spark, name):
    results = []
    for n in (1, 4, 16):
        df = getattr(living, name)(spark, SF, files=n)
        results.append(_rows(df.columns, [tuple(r) for r in df.collect()]))
    assert results[0] == results[1] == results[2]


def test_notice_before_its_publication(spark):
    rows = [("10.1234/LATE", None, None, "retracted", "updates"), (None, "77", None, "corrected", "updates"), (None, None, "pmc5", "withdrawn", "updates"), ("10.1234/x", None, None, "retracted", "is_updated_by")]
    notices = spark.createDataFrame(rows, "target_doi string, target_pmid string, target_pmcid string, status string, direction string")
    path = lv.folders(spark, "early")[0]
    notices.repartition(4).write.parquet(path)
    out, mark = lv.folders(spark, "raised")
    lv.run_notices(lv.landed(spark, path, notices.schema, files_per_batch=1), out, mark)
    known = spark.createDataFrame([("a", "https://doi.org/10.1234/late", None, None, "active"), ("b", None, "77", None, "active"), ("c", None, None, "PMC5", "corrected"), ("d", "10.1234/x", None, None, "active")],
                                  "publication_id string, doi string, pmid string, pmcid string, status string")
    assert {r["publication_id"]: r["status"] for r in lv.read_notices(spark, known, out).collect()} == {"a": "retracted", "b": "corrected", "c": "withdrawn", "d": "active"}
