"""Compare a registered query with its oracle: columns, types, rows and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from leadloom.sources.fixtures import TABLES  # noqa: E402

KINDS = {
    "bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp", "float": "float",
}
DUCK_KINDS = {
    "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "bool",
    "TIMESTAMP": "timestamp", "FLOAT": "float",
}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return x


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message): exact equality of the row multisets."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    mine = _sorted([tuple(_plain(r[c]) for c in cols) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return bool(mine), f"rows only: {len(mine)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return False, f"columns {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = _sorted([tuple(_plain(r[i]) for i in at) for r in cur.fetchall()])
    took = f"spark {t1 - t0:.1f}s oracle {time.time() - t1:.1f}s"
    types = [
        f"{c}: {df.schema[c].dataType.simpleString()} / {kinds[c]}" for c in cols
        if KINDS.get(df.schema[c].dataType.simpleString()) != DUCK_KINDS.get(kinds[c])
    ]
    note = f" types {types}" if types else ""
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} / {len(theirs)} {took}{note}\n   {mine[:2]}\n   {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(mine)} rows differ {took}{note} {cols}\n   " + "\n   ".join(f"{a}\n   {b}" for a, b in bad[:3])
    return not types, f"{len(mine)} rows equal, {took}{note}"


def main(argv):
    import __spark_entry__ as entry
    from leadloom.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = oracle_connection(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
