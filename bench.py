"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mdq.plans import inputs, load_all
from mdq.session import local_session

HEADLINE = [
    "factor_momentum", "factor_volatility", "factor_kurtosis", "factor_market_beta", "factor_max_drawdown", "factor_relative_strength",
    "daily_enrichment", "tail_risk", "overnight_edge", "market_regimes", "dilution_combined", "slippage_by_order_size", "score_expressions",
    "walk_forward_results", "fitness_sharpe", "wilder_atr_adx", "pattern_strict_twin", "levels_volume_profile", "outcomes_first_barrier",
    "trade_summary_grid", "join_asof_backward", "join_nearest_date", "pareto_front_large", "niche_count_and_novelty", "headline_sentiment",
    "post_entries", "stream_tumbling_bars", "setup_scores", "shuffle_control", "stream_last_versions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    queries, _ = load_all()
    times: dict[str, float] = {}

    def clock(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    for name in ("daily", "panel", "bars"):
        clock(f"stage_{name}", lambda n=name: getattr(inputs, n)(spark, sf_dir))
    for name in HEADLINE:
        clock(name, lambda n=name: queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
