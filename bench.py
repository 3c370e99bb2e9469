"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Each query runs to completion
into a sink that discards rows, after one untimed query that starts the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plotfield.queries import QUERIES  # noqa: E402
from plotfield.session import build_session  # noqa: E402

HEADLINE = [
    "treatment_mean_se", "mean_se_nonnull", "pooled_se", "across_summary", "season_mean_se",
    "daily_mean_se", "entity_daily_mean", "box_stats", "exact_quantiles", "zscore",
    "contingency", "proportion_se", "longer", "wider", "wide_sensor_sheet", "inner_join",
    "anti_join_nullsafe", "member_flag", "complete_grid", "first_seen",
    "earliest_rows", "revive_earlier", "cohort_members", "cohort_counts_complete",
    "survival_summary", "establishment", "welch_t", "ols_simple", "anova_type1",
    "anova_type3", "moisture_anova", "pairwise", "glm_quasipoisson_factorial",
    "path_effects", "lmm_wald", "glmm_binomial",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "plotfield-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("treatment_mean_se")
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
