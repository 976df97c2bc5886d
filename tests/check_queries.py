"""Run registered queries against their SQL: `python -m tests.check_queries [folder] [name ...]`."""

import sys
import time

from millrace.session import build_session
from queries import ORACLES, QUERIES
from tests.compare import connect, difference


def main(folder: str, names: list[str]) -> int:
    extra = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
             "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            found = difference(df, con, ORACLES[name]) if name in ORACLES else f"{df.count()} rows, no SQL"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:900]}"
        failed += found is not None
        print(f"{time.time() - start:6.2f}s {name}: {found or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]), 1))
