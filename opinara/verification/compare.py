"""Run registered queries and their SQL side by side and compare names, counts and values."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return len(mine) > 0, f"{len(mine)} rows, no SQL, {took:.1f}s"
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        return False, f"{len(mine)} rows / {len(theirs)} rows"
    different = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if different:
        return False, f"{len(different)} of {len(mine)} rows differ, {sorted(df.columns)}: {different[0][0]} / {different[0][1]}"
    return True, f"{len(mine)} rows equal, {took:.1f}s"


def main(argv: list[str]) -> int:
    from opinara.session import local_session
    from opinara.verification import registry

    sf_dir, wanted = argv[0], argv[1:]
    registry.load_all()
    spark, con, failed = local_session(8), duck(sf_dir), 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, sf_dir, name, fn, registry.SQL.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message}", flush=True)
    print(f"{failed} failed of {len(registry.QUERIES)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
