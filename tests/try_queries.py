"""Run some queries against their SQL: python tests/try_queries.py SF [name-prefix ...]"""
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from rulemill.session import build_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = sys.argv[2:]
    spark = build_session("try", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = differences(spark, con, run, oracle[name], sf_dir)
            else:
                problem = None if run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {took:6.2f}s {name} {problem or ''}", flush=True)
        bad += problem is not None
    print("failures:", bad)
