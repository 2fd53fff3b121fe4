"""Run every registered query against its SQL and print what differs.

    python tests/check_all.py [sf_dir] [name ...]
"""
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problem = difference(df, con, sqls[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32} {time.time() - start:6.2f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} differ of {len(names or queries)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
