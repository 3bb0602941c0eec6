"""python tests/run_oracle.py [sf] [name...]: every query against its SQL, with times."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import __spark_entry__ as e
from oracle import connect, differ

from tideline.session import session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    d = f"/root/testdata/{sf}"
    spark = session(8, **{"spark.ui.showConsoleProgress": "false"})
    con, qs, sqls, bad = connect(d), e.queries(), e.oracle_sql(), 0
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            if name in sqls:
                why = differ(qs[name](spark, d), con, sqls[name])
            else:
                why = "" if qs[name](spark, d).count() >= 0 else "no rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - t:.1f}s{'' if name in sqls else ' (no SQL)'} {why}", flush=True)
    print("failed:", bad)
