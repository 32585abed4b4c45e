"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans import all_queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_daily_forecast",
    "agg_02_resample_15min",
    "agg_09_describe",
    "agg_11_target_stats",
    "agg_12_iqr_outliers",
    "agg_12_iqr_outliers_sorted",
    "agg_16_correlation_matrix",
    "joi_01_join_external",
    "joi_03_holiday_flag",
    "src_06_pre_aggregate",
    "fil_01_ffill",
    "fil_01_ffill_per_series",
    "fil_06_interpolate",
    "win_01_lag",
    "win_02_rolling_mean",
    "win_04_trend",
    "win_07_holdout_split",
    "win_08_keep_last",
    "win_11_acf",
    "win_11_seasonality",
    "win_12_trend_concordance",
    "fea_01_create_features",
    "fea_02_apply_features",
    "prf_01_profile_columns",
    "prf_04_infer_frequency",
    "prf_08_wizard_analysis",
    "mdl_02_linear",
    "mdl_03_boosted",
    "mdl_04_seasonal",
    "mdl_06_evaluate_models",
    "dia_05_health_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    known = all_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
