"""Run queries and their SQL side by side: ``compare.py FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pageloom.plans import ORACLES, QUERIES  # noqa: E402
from pageloom.session import build_session  # noqa: E402
from pageloom.sources.tables import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(row[i]) for i in order) for row in rows)


# Spark type names by SQL type names.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "HUGEINT": "bigint"}


def type_gaps(df, description) -> list[str]:
    want = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in description}
    return [f"{name}: {kind} != {want[name]}" for name, kind in df.dtypes if want.get(name) != kind]


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in ORACLES:
        return True, f"{len(got[1])} rows, no SQL, {spent:.1f}s"
    start = time.time()
    cur = con.execute(ORACLES[name])
    description = cur.description
    want = rows_of([d[0] for d in description], cur.fetchall())
    sql = time.time() - start
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    gaps = type_gaps(df, description)
    if gaps:
        return False, f"types {gaps}"
    if got[1] != want[1]:
        extra, lacking = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return False, (
            f"rows {len(got[1])} vs {len(want[1])}; {len(extra)} only Spark, {len(lacking)} only SQL\n"
            f"   columns {got[0]}\n   Spark {sorted(extra)[:3]}\n   SQL   {sorted(lacking)[:3]}"
        )
    return True, f"{len(got[1])} rows, spark {spent:.1f}s, sql {sql:.1f}s"


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
