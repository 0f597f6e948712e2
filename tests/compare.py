"""Run registered queries and their DuckDB oracles side by side and compare every value."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(rows, order):
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                           for v in r))


def compare(df, sql: str, con) -> list[str]:
    """Differences between a Spark result and an oracle result; empty when equal."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    cols = sorted(names)
    a = rows_of(got, [df.columns.index(c) for c in cols])
    b = rows_of(want, [names.index(c) for c in cols])
    problems = []
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if not a:
        problems.append("no rows")
    for x, y in zip(a, b):
        if [type(v) for v in x] != [type(v) for v in y] or x != y:
            problems.append(f"{dict(zip(cols, x))} vs {dict(zip(cols, y))}")
            if len(problems) > 3:
                break
    return problems


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems = compare(df, oracles[name], con)
                note = "equal"
            else:
                n = df.count()
                problems, note = ([] if n else ["no rows"]), f"{n} rows, no oracle"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        took = time.time() - start
        if problems:
            failed += 1
            print(f"FAIL {name} {took:.1f}s")
            for p in problems:
                print("   ", p[:900])
        else:
            print(f"ok   {name} {took:.1f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
