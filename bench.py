"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "derived_bars",
    "rolling_returns",
    "relative_volume",
    "history_percentile",
    "relative_strength",
    "scored_edges",
    "beta_adjusted_strength",
    "basket_zscore",
    "divergence_flags",
    "daily_ic_ordinal",
    "pooled_percentile",
    "walk_forward_observations",
    "walk_forward_performance",
    "volume_backtest_pooled",
    "confirmation_backtest_daily",
    "theme_backtest",
    "insider_activity",
    "insider_backtest",
    "form4_trades",
    "concentrations",
    "dependent_scan",
    "supplier_strength",
]


def main() -> None:
    from crosstide.catalog import ENTRIES
    from crosstide.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["derived_bars"].run(spark, sf_dir).limit(1).collect()  # start the JVM side outside the timings
    times = {}
    for name in names:
        start = time.time()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
