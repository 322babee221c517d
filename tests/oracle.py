"""Run registered queries beside their SQL in DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    try:
        return format(float(v), ".10g") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def canonical(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows agree, else a short account of the first difference."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    wanted = canonical(found.fetchall(), names)
    got = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows / {len(wanted)}"
    for g, w in zip(got, wanted):
        if g != w:
            return f"{g} / {w}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from inclina.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            note = difference(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
            failed = name in sql and note is not None
        except Exception as error:  # noqa: BLE001  (report and go on)
            note, failed = f"{type(error).__name__}: {str(error)[:600]}", True
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print(f"{bad} failed of {len(sys.argv[2:] or queries)}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
