"""Run registered queries against their SQL in DuckDB: python tests/compare.py <folder> [names]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if pd.isna(v) else v for v in row)) for row in frame.astype(object).itertuples(index=False))


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """Why two results differ, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    kinds = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and not all("datetime" in t for t in k)}
    numeric = {c: k for c, k in odd.items() if "object" not in k and "str" not in k}
    a, b = canonical(ours), canonical(theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values {wrong}"
    return f"types {numeric}" if numeric else None


def main(folder: str, names: list[str]) -> int:
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    spark, connection, failures = make_session(), duck(folder), 0
    sql, all_queries = oracle_sql(), queries()
    for name in names or list(all_queries):
        started = time.time()
        try:
            ours = all_queries[name](spark, folder).toPandas()
            reason = difference(ours, connection.execute(sql[name]).df()) if name in sql else "(no SQL)"
        except Exception as error:  # noqa: BLE001
            reason = f"error {str(error)[:600]}"
        good = reason is None or reason == "(no SQL)"
        failures += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - started:.1f}s {reason or ''}"[:900], flush=True)
    return failures


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
