"""Compare every registered query with its SQL statement: ``python tests/compare.py 0.01 [names]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tessella.scale import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "quantize"):
        return round(float(value), 5)
    return value


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, folder):
    df = entry.queries()[name](spark, folder)
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", spent, len(got), ""
    start = time.time()
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    detail = f"sql {time.time() - start:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", spent, len(got), f"{sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return "ok", spent, len(got), detail
    a, b = set(map(repr, got)), set(map(repr, want))
    return "DIFF", spent, len(got), f"{len(want)} sql rows; only spark {len(a - b)}: {sorted(a - b)[:2]}; only sql {len(b - a)}: {sorted(b - a)[:2]}"


if __name__ == "__main__":
    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            verdict, spent, n, detail = compare(spark, con, name, folder)
            print(f"{verdict:9s} {name:26s} {time.time() - start:6.1f}s rows={n} {detail[:900]}", flush=True)
        except Exception as error:  # keep going, report at the end of the line
            print(f"ERROR     {name:26s} {str(error)[:700]}", flush=True)
