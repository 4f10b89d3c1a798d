"""Runs registered queries next to their SQL and compares the rows.

    python tests/compare.py FOLDER [QUERY ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def database(folder: str):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, db, query, sql: str, folder: str) -> str:
    """Empty if equal, otherwise what differs."""
    table = query(spark, folder)
    left = rows_of(table.columns, table.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    if sorted(table.columns) != sorted(names):
        return f"columns {sorted(table.columns)} against {sorted(names)}"
    if left == right:
        return ""
    a, b = set(left), set(right)
    return f"{len(left)} against {len(right)} rows; only left {list(a - b)[:3]}; only right {list(b - a)[:3]}; {len(a - b)} differ"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from plateview.session import local_session

    session, folder, wanted = local_session(8), sys.argv[1], sys.argv[2:]
    checks, registered, db = entry.oracle_sql(), entry.queries(), database(sys.argv[1])
    for name, query in registered.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in checks:
                verdict = compare(session, db, query, checks[name], folder) or "equal"
            else:
                verdict = f"no SQL, {query(session, folder).count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"FAILED {str(error)[:800]}"
        print(f"{name:26s} {time.time() - start:6.1f}s {verdict}", flush=True)
