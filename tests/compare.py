"""Run registered queries next to their SQL and compare rows without regard to order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return f"f{x:.9g}" if x != int(x) or abs(x) > 1e15 else f"n{int(x)}"
    if isinstance(x, int):
        return f"n{x}"
    return str(x)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


# what the two engines call the same column type
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, ""
    res = con.execute(sql)
    want_cols, want = _rows([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return False, len(got), t1 - t0, f"columns {got_cols} != {want_cols}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    other = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    if kinds != other:
        return False, len(got), t1 - t0, f"types {[(c, kinds[c], other[c]) for c in kinds if kinds[c] != other[c]]}"
    if got != want:
        a, b = set(got), set(want)
        return False, len(got), t1 - t0, f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b, key=repr)[:3]}; only sql {sorted(b - a, key=repr)[:3]}"
    return True, len(got), t1 - t0, ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from evloom.plans import load
    from evloom.session import build_session
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = connect(sf)
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, n, sec, msg = compare(spark, name, fn, oracles.get(name), sf, con)
        except Exception as exc:  # noqa: BLE001
            ok, n, sec, msg = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:38s} rows={n:7d} {sec:6.2f}s {msg}", flush=True)
    print("failures:", bad)
