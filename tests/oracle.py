"""Compare a query with its SQL in DuckDB: same columns, same rows in any order.

    python tests/oracle.py [data folder] [query ...]
"""

import math
import sys
import time
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(directory):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql):
    """None when equal, else what differs."""
    columns, got = _bag(df.columns, df.collect())
    result = con.execute(sql)
    names, expected = _bag([d[0] for d in result.description], result.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if got != expected:
        return f"rows {sum(got.values())} vs {sum(expected.values())}; only here {list((got - expected).items())[:2]}; missing {list((expected - got).items())[:2]}"
    return None


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from taskloom.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    oracles, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, directory)
            difference = compare(con, df, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:500]}"
        if difference:
            failed.append(name)
        print(f"{name:32} {time.time() - start:6.2f}s  {difference or 'ok'}", flush=True)
    print(f"{len(failed)} not equal: {failed}")


if __name__ == "__main__":
    main()
