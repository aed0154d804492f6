"""Headline jobs on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import all_queries  # noqa: E402
from tideline import build_session  # noqa: E402

JOBS = {
    "b1_increase_24h_by_label": "entry_recorded_increase",
    "b2_rate_6h_15m": "r3_rate",
    "b3_histogram_quantile": "g9_histogram_quantile",
    "b4_interval_touch": "j12_interval_touch",
    "b5_parse_freshness": "q6_parse_freshness",
    "b6_alert_states": "x2_alert_states",
    "b7_instant_lookup": "r2_instant",
    "b8_sum_over_time_24h": "r7_sum_over_time_day",
    "b9_availability": "g13_availability",
    "b10_quantile_by": "g7_quantile_by",
    "b11_increase_24h_odd_step": "r15_increase_step_61s",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tideline-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    wanted = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else list(JOBS)
    queries[JOBS[wanted[0]]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent = {}
    for job in wanted:
        start = time.perf_counter()
        queries[JOBS[job]](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[job] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
