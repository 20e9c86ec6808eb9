"""Side-by-side comparison of registered queries with their DuckDB statements."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _rows(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = [str(field.type).replace("large_", "").replace("string_view", "string") for field in table.schema]
    rows = list(zip(*[column.to_pylist() for column in table.columns])) if names else []
    return names, kinds, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the DuckDB result; empty when they agree exactly."""
    names, kinds, rows = _rows(spark_df.toArrow())
    o_names, o_kinds, o_rows = _rows(con.execute(sql).to_arrow_table())
    problems = []
    if names != o_names:
        problems.append(f"columns {names} != {o_names}")
    elif kinds != o_kinds:
        problems.append(f"types {list(zip(names, kinds))} != {o_kinds}")
    if len(rows) != len(o_rows):
        problems.append(f"rows {len(rows)} != {len(o_rows)}")
    if not problems:
        bad = [(r, o) for r, o in zip(rows, o_rows) if not all(_same(a, b) for a, b in zip(r, o))]
        problems += [f"{len(bad)} of {len(rows)} rows differ, e.g. {pair}" for pair in bad[:3]]
    return problems


def main(argv: list[str]) -> int:
    from termloom.catalog.registry import builders, oracles
    from termloom.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir = argv.pop(0)
    steps = tempfile.mkdtemp(prefix="termloom-")
    spark = build_session(master="local[8]", **{"spark.checkpoint.dir": steps, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracles()
    failed = []
    for name, build in builders().items():
        if argv and not any(name.startswith(prefix) for prefix in argv):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problems = compare(df, con, sqls[name]) if name in sqls else []
            n = "" if name in sqls else f"rows-only {df.count()}"
        except Exception as error:  # reported, not hidden
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.1f}s {n}", flush=True)
        for problem in problems:
            print("     ", problem[:2000])
        if problems:
            failed.append(name)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
