"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple("\x00" if v is None else (round(v, 9) if isinstance(v, float) else str(v)) for v in row) and tuple(
        str(None if v is None else (float(f"{v:.12g}") if isinstance(v, float) else v)) for v in row
    )


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


_FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=_key)
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"columns differ: {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if _FAMILY.get(t) != kinds[c]]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    if odd:
        return False, f"types differ: {odd}"
    if len(got) != len(want):
        return False, f"{len(got)} rows, want {len(want)}; first only here {[r for r in got if r not in want][:2]} there {[r for r in want if r not in got][:2]} {cols}"
    for a, b in zip(got, want):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return False, f"row {cols}: {a} want {b}"
    note = "" if got else " EMPTY"
    return True, f"{len(got)} rows{note}, {took:.1f}s"


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
