"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cytolake.runtime import build_session  # noqa: E402
from workloads import QUERIES  # noqa: E402

HEADLINES = [
    "agg3_inside_counts",
    "win3_border_band",
    "itr1_connected_regions",
    "agg4_population_counts",
    "agg6_distribution_summary",
    "agg8_morphology_populations",
    "jn4_nearest_exact",
    "jn5_nearest_box_search",
    "agg9_distance_summary",
    "tissue_features_default",
    "src1_read_cells",
    "agg24_correlation",
    "fs2_mann_whitney",
    "agg29_roc_auc",
    "agg18_class_panoptic_quality",
    "agg20_confusion_matrix",
    "agg22_majority_class",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
