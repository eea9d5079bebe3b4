"""python tests/run_catalog.py [sf] [name ...]: run registered queries against DuckDB."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, duck  # noqa: E402
from tests.conftest import make_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
names = sys.argv[2:]
spark = make_session()
sf_dir = f"/root/testdata/sf{sf}"
con = duck(sf_dir)
q, o = entry.queries(), entry.oracle_sql()
bad = 0
for name in q:
    if names and not any(name.startswith(n) for n in names):
        continue
    t = time.time()
    try:
        df = q[name](spark, sf_dir)
        if name in o:
            why = compare(df, con, o[name])
        else:
            why = None
            print(f"   {name}: {df.count()} rows, no oracle")
    except Exception as e:  # noqa: BLE001
        why = f"{type(e).__name__}: {str(e)[:600]}"
    bad += why is not None
    print(f"{'ok ' if why is None else 'BAD'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    spark.catalog.clearCache()
print("bad:", bad)
