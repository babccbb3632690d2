"""Run registered queries against their SQL: python tests/check_all.py [sf_dir] [name ...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402
from gleanery.session import build_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.driver.memory": "8g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry_point.oracle_sql()
    bad = 0
    for name, query in entry_point.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            rows = query(spark, sf_dir).toArrow()
            took = time.time() - began
            problem = None
            if name in oracles:
                began = time.time()
                problem = differences(rows, con.sql(oracles[name]).to_arrow_table())
            duck = time.time() - began
            print(f"{'ok ' if problem is None else 'BAD'} {name:24} rows={rows.num_rows:<8} "
                  f"spark={took:.2f}s sql={duck:.2f}s {problem or ''}", flush=True)
        except Exception:
            problem = "error"
            print(f"BAD {name}\n{traceback.format_exc()[-2500:]}", flush=True)
        bad += problem is not None
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
