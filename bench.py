"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from radiolake.plans import load_all
from radiolake.plans.catalog import QUERIES
from radiolake.session import local_session

HEADLINE = [
    "calls_per_channel",
    "ded1_all_protocols",
    "ded7_scan_windows",
    "ses1_dmr_calls",
    "ses3_nxdn_calls",
    "ses5_tetra_sessions",
    "ses7_superframes",
    "act4_hysteresis_detector",
    "act8_epochs",
    "act10_thresholds",
    "act15_window_power",
    "act18_rebatch",
    "spc1_welch_psd",
    "spc10_blind_search",
    "spc18_training_hits",
    "trk2_track_events",
    "evd1_probe_evidence",
    "evd9_sweep_summary",
    "bst3_classify_bursts",
    "rpt1_frame_quality",
    "rpt8_interval_trends",
    "cmp3_sample_verdicts",
    "prj10_line_dmr",
    "prj14_nxdn_layer3",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    wanted = sys.argv[1:] or HEADLINE
    # the first query pays for start-up of the JVM and the Python workers
    QUERIES["act1_chunk_power"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
