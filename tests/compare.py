"""Side-by-side check of the registered queries against their SQL.

    python tests/compare.py SF_DIR [name-prefix ...]      (environment: BLOCK_ROWS and HOT_ROWS force small blocks and the large-group way)
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(root: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def rows_of(table) -> list[tuple]:
    data = table.to_pydict()
    names = sorted(data)
    return names, sorted((tuple(cell(data[n][i]) for n in names) for i in range(table.num_rows)), key=repr)


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def kind(arrow_type) -> str:
    text = str(arrow_type)
    for old, new in (("large_string", "string"), ("int32", "int"), ("int64", "int"), ("int16", "int"), ("int8", "int")):
        text = text.replace(old, new)
    return text


def compare(spark_table, duck_table) -> str:
    a, b = rows_of(spark_table), rows_of(duck_table)
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}"
    kinds = {
        n: (kind(spark_table.schema.field(n).type), kind(duck_table.schema.field(n).type))
        for n in a[0]
        if kind(spark_table.schema.field(n).type) != kind(duck_table.schema.field(n).type)
    }
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} vs {len(b[1])} {kinds or ''}"
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if diff:
        return f"{len(diff)} of {len(a[1])} rows differ, e.g. {a[0]} {diff[0][0]} vs {diff[0][1]} {kinds or ''}"
    return f"type {kinds}" if kinds else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from kinelake.session import BLOCK_ROWS_CONF, HOT_ROWS_CONF, build_session

    root, prefixes = sys.argv[1], sys.argv[2:]
    extra = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    if os.environ.get("BLOCK_ROWS"):
        extra[BLOCK_ROWS_CONF] = os.environ["BLOCK_ROWS"]
    if os.environ.get("HOT_ROWS"):
        extra[HOT_ROWS_CONF] = os.environ["HOT_ROWS"]
    spark = build_session("compare", "local[8]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(root), oracle_sql(), 0
    for name, plan in queries().items():
        if prefixes and not any(name.split("_")[0] == p or name.rstrip("_").startswith(p) and p.isalpha() for p in prefixes):
            continue
        start = time.time()
        try:
            table = plan(spark, root).toArrow()
            took = time.time() - start
            if name in oracle:
                problem = compare(table, con.sql(oracle[name]).to_arrow_table())
            else:
                problem = "" if table.num_rows else "no rows"
        except Exception as error:  # noqa: BLE001
            took, problem, table = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}", None
        bad += bool(problem)
        rows = table.num_rows if table is not None else "-"
        print(f"{'BAD ' if problem else 'ok  '}{name:34s}{rows!s:>8} {took:6.1f}s {'' if name in oracle else '(rows)'} {problem}",
              flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
