"""Run registered queries and their SQL side by side (also usable as a script).

    python -m tests.compare SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return str(v)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns and rows agree, whatever their order."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} <> {names}"]
    ours = sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)
    place = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(_cell(r[p]) for p in place) for r in rel.fetchall()), key=repr)
    if ours == theirs:
        return []
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return [f"rows {len(ours)} <> {len(theirs)}; columns {names}"] + [f"  spark {r}" for r in sorted(a - b)[:4]] + [f"  sql   {r}" for r in sorted(b - a)[:4]]


def kinds(df, con, sql: str) -> list[str]:
    """Column types that would not compare as equal."""
    same = {
        "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float",
    }
    rel = con.sql(sql)
    spark_types = dict(df.dtypes)
    return [
        f"type of {n}: spark {spark_types[n]} sql {t}"
        for n, t in zip(rel.columns, rel.types)
        if spark_types.get(n) != same.get(str(t))
    ]


def main(argv: list[str]) -> None:
    import __spark_entry__ as entry
    from tests.session import make_session

    sf, prefixes = argv[0], argv[1:]
    spark = make_session()
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = query(spark, sf)
            if name not in sqls:
                found = []
                note = f"rows {df.count()} (no sql)"
            else:
                found = differences(df, con, sqls[name]) + kinds(df, con, sqls[name])
                note = "ok" if not found else "DIFFERENT"
        except Exception as error:  # report and go on with the next query
            found, note = [str(error)[:600]], "ERROR"
        bad += bool(found)
        print(f"{name}: {note} {time.time() - started:.1f}s", *found, sep="\n   " if found else " ", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
