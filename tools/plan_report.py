"""Write PLANS.md: physical-plan facts of every registered query.

    python tools/plan_report.py [--sf /root/testdata/sf0.01]

For each key: shuffle exchanges (hash / range / round-robin), broadcast
exchanges, single-partition exchanges, Python stages (Arrow UDF or
mapInPandas) and whether a scan carries pushed filters.  Counted on the
initial adaptive plan (before runtime re-planning).
"""

from __future__ import annotations

import argparse
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def facts(plan: str) -> dict[str, int | str]:
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "round-robin": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "python": len(re.findall(r"ArrowEvalPython|MapInPandas|MapInArrow|BatchEvalPython", plan)),
        "pushed": "yes" if re.search(r"PushedFilters: \[[^\]]+\]", plan) else "",
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--master", default="local[8]")
    args = ap.parse_args()

    from revel.plans.catalog import QUERIES
    from revel.session import get_session

    spark = get_session(args.master, shuffle_partitions=8, driver_memory="8g")
    rows = []
    for key, fn in sorted(QUERIES.items()):
        try:
            df = fn(spark, args.sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
            rows.append((key, facts(plan)))
        except Exception as exc:  # noqa: BLE001
            rows.append((key, {"error": type(exc).__name__}))
    cols = ["hash", "range", "round-robin", "broadcast", "single", "python", "pushed"]
    out = ["# PLANS", "",
           f"Physical-plan facts of every registered query (initial adaptive plan at {os.path.basename(args.sf)}; "
           "generated by `tools/plan_report.py`). Checkpointed and materialised inputs appear as "
           "scans, so work done before them is not counted here. `single` counts "
           "single-partition exchanges: they occur only on results already reduced to a few rows "
           "(a global aggregate's final merge, a top-k of the vocabulary).", "",
           "| key | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for key, f in rows:
        out.append(f"| `{key}` | " + " | ".join(str(f.get(c, f.get("error", ""))) for c in cols) + " |")
    with open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
