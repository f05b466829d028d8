"""Time the headline queries and print one JSON line: seconds per query, and tracks per second."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stavework.catalog import all_queries  # noqa: E402
from stavework.session import build_session  # noqa: E402

HEADLINE = [
    "evaluate_job", "param_sweep_loo", "choose_pattern", "permutation_test", "fill_gaps", "span_beat_snap",
    "decide_tonic", "fill_silent_bars", "span_rms_ratio", "novelty", "event_placement", "compare_job", "resolve_credits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    tracks = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    songs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    per_second = {n: round({"evaluate_job": tracks, "param_sweep_loo": songs}[n] / times[n], 1) for n in ("evaluate_job", "param_sweep_loo") if n in times}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "tracks": tracks, "tracks_per_sec": per_second,
    }))
    spark.stop()


main()
