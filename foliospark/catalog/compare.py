"""Run registered queries beside their oracles and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from foliospark.catalog import ORACLES, QUERIES
from foliospark.plans.session import local_session

DUCK_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    return value


def check(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, otherwise a short reason."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    spark_rows = [tuple(normal(r[c]) for c in columns) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        return None if spark_rows else "no rows"
    result = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})")
    types = {d[0]: str(d[1]) for d in result.description}
    duck_rows = [tuple(normal(v) for v in row) for row in result.fetchall()]
    full = con.execute(ORACLES[name] + " limit 0" if False else f"describe {ORACLES[name]}").fetchall()
    if sorted(r[0] for r in full) != columns:
        return f"columns {columns} / {sorted(r[0] for r in full)}"
    wrong = [
        f"{c}: {t} / {types[c]}" for c, t in df.dtypes if DUCK_TYPES.get(t, t).upper() != types[c].upper()
    ]
    if wrong:
        return "types " + "; ".join(wrong)
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    if not spark_rows:
        return "empty result"
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    for a, b in zip(order(spark_rows), order(duck_rows)):
        if a != b:
            return f"values {columns}\n   spark {str(a)[:900]}\n   duck  {str(b)[:900]}"
    return None


def main() -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            reason = check(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            reason = f"error {str(e)[:600]}"
        bad += reason is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if reason is None else 'FAIL'} {time.time() - t0:6.2f}s {name}{kind} {reason or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
