"""Run registered queries beside their SQL in DuckDB and compare schema, rows and values.

    python -m tests.compare [folder] [name ...]

COMPARE_CONF="key=value,..." adds session options: results must not depend on partitioning, join
strategy or adaptive execution.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _family(name: str) -> str:
    name = name.lower()
    for prefix, family in (
        ("tinyint", "int8"), ("smallint", "int16"), ("integer", "int32"), ("bigint", "int64"),
        ("hugeint", "int128"), ("int", "int32"), ("long", "int64"), ("float", "float"),
        ("double", "double"), ("varchar", "string"), ("string", "string"), ("boolean", "bool"),
        ("timestamp", "timestamp"), ("date", "date"), ("decimal", "decimal"),
    ):
        if name.startswith(prefix):
            return family
    return name


def _normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "NULL" if value is None else str(value)


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    names = sorted(frame.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} != {sorted(relation.columns)}"
    mine = dict(zip(frame.columns, [_family(f.dataType.simpleString()) for f in frame.schema.fields]))
    theirs = dict(zip(relation.columns, [_family(str(x)) for x in relation.types]))
    if mine != theirs:
        return f"types { {k: (mine[k], theirs[k]) for k in mine if mine[k] != theirs[k]} }"
    order = [relation.columns.index(n) for n in names]
    expected = sorted(tuple(_normal(r[i]) for i in order) for r in relation.fetchall())
    actual = sorted(tuple(_normal(r[n]) for n in names) for r in frame.collect())
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        a, e = wrong[0]
        return f"{len(wrong)} of {len(actual)} rows differ: spark {dict(zip(names, a))} sql {dict(zip(names, e))}"
    return None if actual else "no rows on either side"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tallyline.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    options = dict(pair.split("=", 1) for pair in os.environ.get("COMPARE_CONF", "").split(",") if pair)
    spark = build_session("compare", "local[8]", 8, {"spark.driver.memory": "8g", **options})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = argv[1:] or list(queries)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                problem = difference(frame, con, oracles[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # reported, not hidden: the run goes on to the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if name in oracles else ' (rows)'} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
