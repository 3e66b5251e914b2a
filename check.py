"""Compare the registered queries with their DuckDB statements.

    python check.py [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from webquire.oracles import ORACLES
from webquire.queries import QUERIES
from webquire.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    got = QUERIES[name](spark, sf)
    left = rows(got.columns, got.collect())
    if name not in ORACLES:
        return True, f"{len(left)} rows, no statement"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    right = rows(columns, result.fetchall())
    if sorted(columns) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(columns)}"
    if left != right:
        a = [x for x, y in zip(left, right) if x != y][:1]
        b = [y for x, y in zip(left, right) if x != y][:1]
        return False, f"{len(left)} / {len(right)} rows; spark {repr(a)[:400]} duckdb {repr(b)[:400]}"
    return True, f"{len(left)} rows"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf)
        except Exception as e:  # report and go on
            ok, note = False, str(e)[:600].replace("\n", " | ")
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, f"{time.time() - start:.1f}s", flush=True)
    sys.exit(bad > 0)
