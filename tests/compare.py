"""Run registered queries next to their SQL checks: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.11g}")
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    expected = rows_of(columns, result.fetchall())
    actual = rows_of(spark_df.columns, spark_df.collect())
    if actual == expected:
        return None
    missing, extra = list((expected - actual).items()), list((actual - expected).items())
    return (
        f"{sum(actual.values())} rows against {sum(expected.values())}; columns {sorted(columns)}; "
        f"missing {len(missing)} {missing[:2]}; extra {len(extra)} {extra[:2]}"
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from terrascope.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(run(spark, sf_dir), con, checks[name]) if name in checks else "no check"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(main())
