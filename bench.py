"""Times the headline queries and prints one JSON line.

Every query starts from the raw tables' stage it needs. Stages are stored tables
(as in the daily job); building each of them is timed on its own, as are the
queries over them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barquet.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

STAGES = ("raw_bars", "index_bars", "fundamentals", "features", "signals", "price_action",
          "timeframes", "regime", "environment", "trades")
HEADLINE = (
    "screen_flagship", "feature_table", "ema", "volatility", "composite_score",
    "price_action_signal", "timeframe_signal", "relative_strength", "regime_table",
    "regime_gate", "sector_momentum", "confidence_model", "backtest_ready",
    "strategy_trades", "performance", "equity_curve", "scanner", "preset_ranking",
    "named_screens", "quality_log", "valid_candles", "without_volume_spikes",
    "incremental_append", "sink_rebuild", "ml_labelled", "ml_scores", "daily_tables",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from verification import QUERIES
    from verification.stages import Stages

    cores = int(CPUS)
    spark = build_session("bench", f"local[{cores}]", shuffle_partitions=cores * 2)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine
    times: dict[str, float] = {}
    stages = Stages(spark, SF_DIR)
    for name in STAGES:
        t0 = time.perf_counter()
        getattr(stages, name)()
        times[f"build_{name}"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        consume(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total,
                      "unit": "sec", "queries": times, "sf": Path(SF_DIR).name}))
    spark.stop()


if __name__ == "__main__":
    main()
