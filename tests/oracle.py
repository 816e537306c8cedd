"""Run a query and its SQL side by side on one folder of tables."""

from pathlib import Path

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    same = lambda v: round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, str) else v
    return sorted((tuple(same(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)), key=repr)


def by_sql(sql: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return rows(con.execute(sql).fetchdf())
