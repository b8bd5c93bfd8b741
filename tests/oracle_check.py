"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [sf] [prefix ...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pitcast.session import build_session

    spark = build_session(
        "pitcast-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.logLevel": "debug"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if s.dtype == object or str(s.dtype) in ("string", "str"):
            df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT else str(v.tolist() if hasattr(v, "tolist") else v))
        elif str(s.dtype).startswith("datetime"):
            df[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f")
        elif s.dtype == bool:
            df[c] = s.astype(str)
        else:
            df[c] = s.astype(float)
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    a, b = normal(spark_df), normal(duck_df)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} differ in {c}: {a[c][i]!r} != {b[c][i]!r}; row {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    import __spark_entry__ as entry

    root = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    spark = session()
    bad = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            got = fn(spark, root).toPandas()
            took = time.time() - started
            if name in oracle:
                want = con.execute(oracle[name]).df()
                problem = compare(got, want)
                dated = [x[0] for x in con.execute("DESCRIBE " + oracle[name]).fetchall() if x[1] == "DATE"]
                if dated:
                    problem = f"DATE columns {dated}; {problem}"
            else:
                problem = None
            note = "ok" if problem is None else f"MISMATCH {problem}"
            print(f"{name:40s} {len(got):6d} {took:5.1f}s {'sql ' if name in oracle else 'rows'} {note}"[:420], flush=True)
            bad += problem is not None
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error).strip().splitlines()
            print(f"{name:45s} ERROR {type(error).__name__}: {' | '.join(text[:4])[:600]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
        spark.catalog.clearCache()
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
