"""python tests/check.py [prefix ...] [--sf 0.01]: run and compare registered queries."""

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402

import __spark_entry__ as registered  # noqa: E402
from tidemark.session import local_session  # noqa: E402

ap = argparse.ArgumentParser()
ap.add_argument("prefix", nargs="*")
ap.add_argument("--sf", default="0.01")
a = ap.parse_args()
sf = f"/root/testdata/sf{a.sf}"
spark, con = local_session(), harness.duck(sf)
qs, os_ = registered.queries(), registered.oracle_sql()
bad, start = 0, time.time()
for name in sorted(qs):
    if a.prefix and not any(name.startswith(p) for p in a.prefix):
        continue
    try:
        r = harness.compare(spark, con, sf, name, qs[name], os_.get(name))
    except Exception as exc:  # noqa: BLE001
        bad += 1
        print(f"ERR  {name}: {str(exc)[:700]}", flush=True)
        if "-v" in os.environ.get("CHECK", ""):
            traceback.print_exc()
        continue
    bad += not r["ok"]
    tag = "ok  " if r["ok"] else "BAD "
    if os_.get(name) is None:
        tag = "rows"
    if not r["ok"] or r["seconds"] > 4 or r["rows"] == 0 or os.environ.get("CHECK"):
        print(f"{tag} {name} rows={r['rows']} spark={r['seconds']:.2f}s duck={r.get('duck', 0):.2f}s {r['why'][:1500]}", flush=True)
print(f"done, {bad} bad, {time.time() - start:.0f}s")
