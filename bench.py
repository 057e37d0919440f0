"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake import queries
from cartolake.operators import cluster, density, tiles


def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hierarchical_clusters(queries.points(spark, sf_dir), 0, 8, 40.0)


def kernel_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.kernel_density(queries.points(spark, sf_dir), (-180, -85, 180, 85), 512, 512, radius=20.0, weight="weight")


def rollup_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.rollup(queries.points(spark, sf_dir), range(13), weight="weight")


HEADLINE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "styled_tiles": queries.styled_tiles,
    "layers_union": queries.layers_union,
    "expr_math_guarded": queries.expr_math_guarded,
    "rules_cascade": queries.rules_cascade,
    "tile_rollup_z0_z12": rollup_12,
    "cluster_grid": queries.cluster_grid,
    "cluster_hierarchical_z0_z8": hierarchical,
    "kernel_density_512": kernel_512,
    "trajectory_interp": queries.trajectory_interp,
    "keyframes": queries.keyframes,
    "class_quantile": queries.class_quantile,
    "geom_measures": queries.geom_measures,
    "sparse_points_raster": queries.sparse_points_raster,
    "polygon_fill": queries.polygon_fill,
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(1000).agg(F.sum("id")).collect()
    times = {}
    for name, f in HEADLINE.items():
        run(f)  # compiles and fills the file cache
        start = time.time()
        run(f)
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
