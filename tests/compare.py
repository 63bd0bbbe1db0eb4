"""Run registered queries against their SQL in DuckDB and report differences.

    python tests/compare.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"
_KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    found = []
    got = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    mine = dict(spark_df.dtypes)
    if sorted(mine) != sorted(names):
        return [f"columns {sorted(mine)} != {sorted(names)}"]
    for n in names:
        if _KINDS.get(mine[n], mine[n]) != kinds[n]:
            found.append(f"type of {n}: {mine[n]} != {kinds[n]}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(spark_df.columns, got), _rows(names, want)
    if a != b:
        left, right = set(a), set(b)
        found.append(f"only Spark: {sorted(left - right)[:2]}; only SQL: {sorted(right - left)[:2]}")
    return found


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--rows-only", action="store_true", help="run the queries without SQL")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    entry = importlib.import_module("__spark_entry__")
    from clonelens.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = sorted(set(oracles) - set(queries))
    if bad:
        print("oracles without a query:", bad)
    chosen = args.names or [q for q in queries if (q in oracles) != args.rows_only]
    failed = 0
    for name in chosen:
        started = time.perf_counter()
        try:
            df = queries[name](spark, f"{DATA}/sf{args.sf}")
            if name in oracles:
                found = differences(df, con, oracles[name])
                state = "ok" if not found else f"DIFF {found}"
            else:
                state = f"rows {len(df.collect())}"
                found = []
        except Exception as error:
            found, state = [str(error)], f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failed += bool(found)
        print(f"{name}: {time.perf_counter() - started:.1f}s {state}", flush=True)
    print(f"{len(chosen) - failed}/{len(chosen)} good")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
