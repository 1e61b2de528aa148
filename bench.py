"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Each query runs once to warm up generated code, then once for the clock; the
result is fully computed by a no-op write. Names on the command line replace
the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from voxelsheet.registry import load_all
from voxelsheet.session import session

HEADLINE = [
    "gather_nearest", "gather_bricks", "gather_trilinear", "gather_trilinear_bricks", "gather_default_shape_all", "label_patch_rgb", "oblique_slice", "request_blocks",
    "on_surface", "ambiguous_filter", "undersample", "oversample", "shuffled_batches",
    "confusion", "metric_rollup", "ranked_auc", "pooled_scores", "f1_sweep", "stamp_last_write", "face_merge", "summary_metrics",
    "slice_stats", "global_stats", "gaussian_blur", "window_rescale", "auto_window", "running_extremes", "mutual_information", "pearson_top_k", "slab_merge", "downsample_volume",
    "patch_extract", "patch_stitch", "rot90_flip", "tta_average", "standardize",
    "job_name_parse", "prediction_catalog", "asof_prediction", "report_values", "global_index", "surface_map_roundtrip", "stream_extremes", "kfold_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
