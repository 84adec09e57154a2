"""Compare the named queries (or all) with their SQL: python tests/check_queries.py [sf] [name…]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from driftgrid.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name in names:
        t, spent = time.time(), 0.0
        try:
            df = entry.queries()[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            spent = time.time() - t
            sql = entry.oracle_sql().get(name)
            problem = oracle.compare(df, con, sql) if sql else f"no SQL, {df.count()} rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem) and not problem.startswith("no SQL")
        print(f"{name:32s} {spent:6.2f}s {time.time() - t:6.2f}s  {problem or 'ok'}", flush=True)
    print("bad:", bad)
