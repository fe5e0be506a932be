"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cubeframe.plans.queries import QUERIES

NAMES = ["masked_mosaic_ndvi", "calendar_median_mosaic", "gap_interpolate", "catalog_upsert", "dedupe_reprocessed", "download_shortfall", "job_status_left", "spatial_bbox_join", "first_valid_merge", "flatten_pixels", "linear_infer", "class_phenology", "major_classes_topk", "tile_sharing"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(2):  # the first run compiles
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline queries, wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
