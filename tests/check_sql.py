"""Compare every query with its SQL: ``python tests/check_sql.py [folder] [names...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return value


def kind(value):
    return type(value).__name__


def compare(df, connection, statement):
    """Empty text if names, value types and rows agree, else what differs."""
    names = sorted(df.columns)
    mine = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    result = connection.execute(statement)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    left, right = Counter(mine), Counter(theirs)
    kinds = [
        (n, sorted({kind(r[i]) for r in mine} | {kind(r[i]) for r in theirs} - {"NoneType"}))
        for i, n in enumerate(names)
        if len(({kind(r[i]) for r in mine} | {kind(r[i]) for r in theirs}) - {"NoneType"}) > 1
    ]
    if left != right:
        a, b = list((left - right).elements()), list((right - left).elements())
        key = lambda r: tuple((x is None, str(x)) for x in r)
        pairs = list(zip(sorted(a, key=key)[:3], sorted(b, key=key)[:3]))
        return f"rows {len(mine)}/{len(theirs)}, only left {len(a)}, only right {len(b)}: {names} {pairs}"
    return f"types {kinds}" if kinds else ""


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        connection.execute(
            f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')"
        )
    return connection


def main():
    from tests.conftest import session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, connection = session(), connect(folder)
    statements, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if (names and name not in names) or name not in statements:
            continue
        begin = time.time()
        try:
            difference = compare(query(spark, folder), connection, statements[name])
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(difference)
        print(f"{name:34s} {time.time() - begin:6.2f}s {'ok' if not difference else difference[:1500]}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
