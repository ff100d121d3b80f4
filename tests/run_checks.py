"""python tests/run_checks.py [folder] [name part ...]: time and compare registered queries."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from halyard.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from halyard.session import build_session  # noqa: E402
from tests.checking import compare, connect  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
parts = sys.argv[2:]
load_all()
spark = build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = 0
for name, build in QUERIES.items():
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        df = build(spark, folder)
        if name in ORACLES:
            problem = compare(df, con, ORACLES[name])
        else:
            n = len(df.collect())
            problem = None if n else "no rows"
    except Exception as error:  # report and go on
        problem = f"{type(error).__name__}: {str(error)[:600]}"
        if "-v" in parts:
            traceback.print_exc()
    bad += problem is not None
    kind = "sql " if name in ORACLES else "rows"
    print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
print(f"{bad} failing of {len(QUERIES)}; {len(ORACLES)} with SQL")
