"""Benchmark: time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit", "queries", "sf", ...}.
Each query is one Spark plan from the parquet scan to a `noop` sink (every row is produced,
nothing is collected), timed after one untimed warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

HEADLINE = [
    # clean: derive + parse + merchant normalisation + fingerprint
    "clean_transactions",
    # categorise: in-batch dedup + code lookup + keyword cascade
    "row_category",
    # load: two loads, first-writer merchants, anti-join on the fingerprint
    "incremental_load",
    # dashboard: denormalised view, roll-ups, KPIs, budget variance, audits
    "full_view",
    "spend_by_category",
    "monthly_trend",
    "daily_spend",
    "top_merchants",
    "category_share",
    "kpis",
    "income_vs_spend",
    "budget_variance",
    "transfers_by_code",
    "quality_ratios",
    # code-description rules over whole document texts
    "code_classification",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus if cpus != "*" else "8"))
    spark = local_session(cpus, shuffle_partitions=partitions, app="ledgerlens-bench")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("full_view")  # warm-up (JIT of the cleaning, dedup and view code), not timed
    times = {name: round(run(name), 3) for name in HEADLINE}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "master": f"local[{cpus}]",
        "shuffle_partitions": partitions,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
