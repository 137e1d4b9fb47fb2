"""Headline queries on local cores; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from canopyframe.plans import QUERIES  # noqa: E402
from canopyframe.session import local_session  # noqa: E402

HEADLINE = ("c01_zonal_join", "c02_tile_join", "c06_voronoi_crowns", "c10_greedy_merge", "d01_canopy_height_model",
            "d04_treetops", "d10_plot_footprint_metrics", "d11_cell_metrics", "c05_k_nearest", "c17_point_in_polygon")

RUNS = 3  # the median counts


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["c02_tile_join"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not a query's time
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            t = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
