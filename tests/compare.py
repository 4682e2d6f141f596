"""Runs registered queries and their oracle SQL side by side.

``python tests/compare.py [folder] [name ...]``
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""

    def text(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return repr(v)
        if hasattr(v, "item"):
            return text(v.item())
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = got.copy(), want.copy()
    for c in got.columns:  # whole numbers with nulls come as Int64 or as float64
        if {str(got[c].dtype), str(want[c].dtype)} in ({"Int64", "float64"}, {"Int64", "int64"}):
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    a, b = canonical(got), canonical(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {bad[:2]}; types {kinds(got)} {kinds(want)}"
    return None


def main() -> int:
    from cellmosaic.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name in oracles:
                problem = difference(got, con.execute(oracles[name]).df())
                state = problem or "ok"
                bad += problem is not None
            else:
                state = f"no oracle ({len(got)} rows)"
            print(f"{name:32s} {took:6.2f}s {len(got):8d} {state}"[:900], flush=True)
        except Exception as e:
            bad += 1
            print(f"{name:32s} FAILED {type(e).__name__}: {str(e)[:700]}", flush=True)
            if names:
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
