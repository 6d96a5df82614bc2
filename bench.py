"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is collected to the driver).  One warm-up pass runs first so JIT and
file listing are not charged to a query; then three timed passes, and the
reported time of a query is the median of the three (single passes on a
shared machine vary by up to 1.5x).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from botqa.plans import QUERIES, run_query  # noqa: E402
from botqa.session import get_session  # noqa: E402

HEADLINE = [
    "run_report",                 # flagship: stats + breakdown + grade + verdict per run
    "A03_panel_verdict",          # majority vote of the judge panel
    "P04_result_assembly",        # rules + panel -> results
    "S07_judge_reply_parse",      # JSON reply parsing
    "A09_vocabulary",             # word counts / top-k per company
    "A10_topics",
    "A14_emotional_tone",
    "A17_conversation_insights",  # all eight extractions joined
    "A20_episodic_memory",        # results x scenarios join + aggregate
    "L01_regression_library",     # dedupe by input
    "A22_persona_effectiveness",  # distributed prefix sum
    "SRC03_current_runs",         # run log state
    "K02_fix_order",
    "A27_fix_report",
    "C02_density_clusters",       # density clustering of failure embeddings
    "KB01_page_documents",        # HTML -> documents
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="botqa-bench")
    names = [q for q in HEADLINE if q in QUERIES]
    samples: dict[str, list[float]] = {name: [] for name in names}
    for rep in range(4):                      # pass 0 is the warm-up
        for name in names:
            t0 = time.perf_counter()
            run_query(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
            if rep:
                samples[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
