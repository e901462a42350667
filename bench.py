"""Benchmark: time every registered query at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list of name substrings), BENCH_BUDGET_SEC
(default 3000: queries not started within the budget are listed under
"skipped", never silently dropped).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
The enriched fact is built once (timed as ``fact_build``); each query is then
executed end to end into Spark's no-op sink (full plan, nothing collected).
Relational queries (those with an SQL oracle) run first, model queries last.
If the process is terminated, the results gathered so far are printed.
"""
from __future__ import annotations

import json
import os
import re
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STATE: dict = {"timings": {}, "errors": {}, "skipped": [], "printed": False}


def emit(sf_dir: str, cpus: int) -> None:
    if STATE["printed"]:
        return
    STATE["printed"] = True
    t = STATE["timings"]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(t.values()), 3), "unit": "sec",
                      "queries": t, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "n_queries": max(len(t) - 1, 0), "errors": STATE["errors"],
                      "skipped": STATE["skipped"]}), flush=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [s for s in os.environ.get("BENCH_QUERIES", "").split(",") if s]
    budget = float(os.environ.get("BENCH_BUDGET_SEC", "3000"))

    def on_term(signum, frame):
        emit(sf_dir, cpus)
        sys.exit(1)
    signal.signal(signal.SIGTERM, on_term)

    from marketlens.operators.fact import enriched
    from marketlens.plans.registry import all_queries
    from marketlens.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="marketlens-bench")
    start = time.time()
    enriched(spark, sf_dir).count()
    STATE["timings"]["fact_build"] = round(time.time() - start, 3)
    queries = sorted(all_queries().items(), key=lambda kv: (kv[1].sql is None, kv[0]))
    for name, q in queries:
        if only and not any(s in name for s in only):
            continue
        if time.time() - start > budget:
            STATE["skipped"].append(name)
            continue
        t = time.time()
        try:
            q.fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            STATE["timings"][name] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            STATE["errors"][name] = f"{type(e).__name__}: {str(e)[:200]}"
    emit(sf_dir, cpus)
    spark.stop()


if __name__ == "__main__":
    main()
