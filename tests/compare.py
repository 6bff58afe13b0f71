"""Compare every query with its SQL: ``python tests/compare.py sf0.01 [query ...]``."""

import math
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{source}')")
    return con


def plain(value):
    """A value in a form in which both engines' values can be compared and sorted."""
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, Decimal)):
        return "~nan" if math.isnan(value) else f"{round(float(value), 6) + 0.0:.6f}"
    if isinstance(value, int):
        return f"{value:.6f}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()[:19]
    if isinstance(value, dict):
        return "{" + ",".join(plain(v) for v in value.values()) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(mine) != len(theirs):
        a, b = set(mine), set(theirs)
        return f"{len(mine)} rows against {len(theirs)}; only here {sorted(a - b)[:2]}, only there {sorted(b - a)[:2]}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{a} against {b}; {sum(x != y for x, y in zip(mine, theirs, strict=True))} differ"
    return ""


def main(sf: str, names: list[str]) -> None:
    import time

    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from lexmill.session import get_session

    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(f"{DATA}/{sf}"), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, f"{DATA}/{sf}")
            what = compare(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:
            what = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name}: {what or 'equal'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
