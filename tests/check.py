"""Command line check: python -m tests.check [sf_dir] [name prefix ...]"""

from __future__ import annotations

import sys
import time

from __spark_entry__ import oracle_sql, queries
from bedtrace.session import CELL_ROWS_CONF, local_session, release
from tests.oracle import compare, connect


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    cell = None
    args = sys.argv[2:]
    if args and args[0].startswith("cell="):
        cell, args = args[0][5:], args[1:]
    spark = local_session(8, shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    if cell:
        spark.conf.set(CELL_ROWS_CONF, cell)
    con = connect(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if "sql" in args and name not in oracles:
            continue
        if args and args != ["sql"] and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = compare(name, df, oracles[name], con)
                label = "ok" if not problems else "DIFF"
            else:
                problems, label = [], f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            problems, label = [str(e)[:1500]], "ERROR"
        failed += bool(problems)
        release(spark)
        print(f"{label:6s} {name} {time.time() - t:.1f}s", flush=True)
        for p in problems[:4]:
            print("      ", p)
    print("failed:", failed)


if __name__ == "__main__":
    main()
