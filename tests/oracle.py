"""A query's rows beside those of its SQL."""

from pathlib import Path

import duckdb
import pandas as pd


def rows(frame) -> list[tuple]:
    """Rows with columns by name, in an order of their own."""
    names = sorted(frame.columns)
    return sorted((tuple(map(_plain, r)) for r in frame[names].itertuples(index=False)), key=repr)


def _plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x.item() if hasattr(x, "item") else x


def sql(sf_dir: str, statement: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con.execute(statement).df()


def differences(spark, sf_dir: str, query, statement: str, show: int = 2) -> str:
    """Empty if both give the same columns and rows."""
    ours, theirs = query(spark, sf_dir).toPandas(), sql(sf_dir, statement)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = rows(ours), rows(theirs)
    if a == b:
        return ""
    from collections import Counter

    only_a, only_b = Counter(a) - Counter(b), Counter(b) - Counter(a)
    return f"{len(a)} and {len(b)} rows; {sorted(ours.columns)}\nours: {list(only_a)[:show]}\nSQL:  {list(only_b)[:show]}"
