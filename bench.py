"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each the median of three runs after a first; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from pulsespark.plans.registry import QUERIES

HEADLINE = (
    "hourly_dense_sequence", "peak_heads", "breakout_extent", "influence_windows", "tagged_tracks", "track_playlists", "co_playlist_partners", "genre_lookup",
    "top_tags", "tfidf_top", "bigrams", "frequent_pairs", "association_rules", "rank_share_pivot", "power_law_fit", "classify_tags", "dbscan",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name], first[name] = round(median(runs[1:]), 3), round(runs[0], 3)
    print(json.dumps({"metric": "total seconds of the headline queries, median of three warm runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first_runs": first, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
