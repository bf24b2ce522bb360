"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import REGISTRY  # noqa: E402
from catalog.tables import Tables  # noqa: E402
from tallyweir.session import build_session  # noqa: E402

HEADLINE = (
    "abundance_by_season",
    "abundance_with_transfers",
    "weekly_mark_summary_by_site",
    "daily_marks_recovered",
    "release_recovery_matrix",
    "automatic_pools",
    "candidate_stratified_fits",
    "net_releases_by_code",
    "final_tag_table",
    "daily_adult_series",
    "season_effort",
    "tagging_cap_scenarios",
    "yearly_abundance",
    "reduced_effort_abundance",
    "condition_distribution",
    "exact_quantiles_by_group",
    "box_summary_by_age",
    "age_length_key",
    "expected_ages_of_unaged",
    "weight_length_regression",
    "length_by_age_model",
    "condition_over_season",
    "thirty_bin_histogram",
    "mortality_table",
    "species_by_site",
    "row_ids",
    "left_join_one_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    Tables(spark, folder).fish.groupBy("site").count().collect()  # start the executor threads and the reader
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale,
    }))


if __name__ == "__main__":
    main()
