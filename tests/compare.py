"""Run a registered query and its SQL twin and compare rows, as the correctness gate does."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else (float(v) + 0.0 if isinstance(v, float) else v) for v in r)
            for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: "text" if df[c].dtype.kind in "OTU" else df[c].dtype.kind.replace("u", "i") for c in sorted(df.columns)}


def mismatch(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"{len(spark_df)} rows vs {len(duck_df)}"
    a, b = canonical(spark_df), canonical(duck_df)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    if len(spark_df) and kinds(spark_df) != kinds(duck_df):
        return f"types {kinds(spark_df)} vs {kinds(duck_df)}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from rankloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    oracle, bad = oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        begun = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            spent = time.time() - begun
            note = mismatch(got, con.execute(oracle[name]).df()) if name in oracle else "rows only"
        except Exception as error:  # noqa: BLE001
            got, spent, note = [], time.time() - begun, f"{type(error).__name__}: {str(error)[:600]}"
        bad += note not in (None, "rows only")
        print(f"{name:24s} {len(got):8d} rows {spent:7.2f} s  {note or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
