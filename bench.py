"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, nothing
collected to the driver). Session start and one warm-up query are excluded. With
BENCH_WARM=1 a second pass records steady-state times under "warm".
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "embedding_drift",
    "ks_two_sample",
    "roc_auc",
    "roc_curve",
    "classification_report",
    "log_loss",
    "exact_split",
    "holdback_random",
    "class_distribution",
    "text_statistics",
    "clean_text",
    "term_stats",
    "top_vocabulary",
    "tfidf_weights",
    "gate_register",
    "champion_vs_candidate",
    "metric_latest",
    "windowed_metrics",
    "dataset_fingerprint",
    "train_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from vigil.plans import catalog
    from vigil.session import local_session

    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    # warm-up (JIT, file listing caches), not timed
    catalog.QUERIES["latest_window"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    times: dict[str, float] = {}
    for name in only or HEADLINE:
        times[name] = run(name)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    warm: dict[str, float] = {}
    if os.environ.get("BENCH_WARM") == "1":  # optional second pass: steady-state times
        for name in only or HEADLINE:
            warm[name] = run(name)
            print(f"# warm {name}: {warm[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        **({"warm": warm, "warm_total": round(sum(warm.values()), 3)} if warm else {}),
    }))


if __name__ == "__main__":
    main()
