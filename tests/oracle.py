"""Compare registered queries with their SQL twins: `python tests/oracle.py [folder] [name ...]`."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (int, float)):
            v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = normal(left), normal(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry

    from rankflow import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(
        master=f"local[{os.environ.get("ORACLE_CPUS", "8")}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(w) for w in sys.argv[2:]):
            continue
        t = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - t
            t = time.time()
            verdict = "rows only" if name not in sql else differences(got, con.execute(sql[name]).df()) or "ok"
            print(f"{name:32s} {len(got):8d} rows {took:6.1f}s / {time.time() - t:5.1f}s  {verdict[:600]}", flush=True)
            failed += verdict not in ("ok", "rows only")
        except Exception as error:
            failed += 1
            print(f"{name:32s} FAILED {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
