"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetloom.plans import load_all  # noqa: E402
from packetloom.plans.registry import QUERIES  # noqa: E402
from packetloom.session import build  # noqa: E402

HEADLINE = ["beh1_heuristic_window_risk", "win3_packet_window_stats", "win9_flow_window_features", "cln1_packet_dedup", "cln3_retransmission_detect",
            "flw2_build_flows", "flw4_tcp_session_track", "flw9_flow_summary", "beh3_beaconing", "beh4_periodicity", "beh10_entity_baseline", "gra1_graph_snapshot",
            "ent1_entity_history", "pat1_horizontal_scan", "fc3_forecast_cases", "ev1_confusion_metrics"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    took = {}
    for name in names:
        runs = []
        for i in range(repeat + 1):
            spark.catalog.clearCache()  # every run starts from the files
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    packets = spark.read.parquet(f"{sf}/events.parquet").count()
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                      "packets_per_second_risk_pipeline": round(packets / took["beh1_heuristic_window_risk"]) if "beh1_heuristic_window_risk" in took else None}))


if __name__ == "__main__":
    main()
