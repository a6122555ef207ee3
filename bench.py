"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from themeloom.plans import QUERIES

HEADLINE = [
    "any_theme_by_dim",
    "high_loading",
    "recode_theme",
    "join_registry",
    "registry_union",
    "crosstab_share",
    "crosstab_count",
    "grant_rate",
    "theme_summary",
    "kde_by_group",
    "boxplot_stats",
    "theme_network",
    "theme_degree",
    "multi_theme_firms",
    "doc_term_counts",
    "trim_vocabulary",
    "tf_idf",
    "doc_vectors",
    "semantic_coherence",
    "heldout_likelihood",
    "residual_dispersion",
    "roc_points",
    "auc",
    "confusion_stats",
    "pca_variance",
    "topic_fit",
    "coef_table",
    "clf_logit",
    "clf_rf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="themeloom-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Code is loaded and compiled on the smallest tables, with joins, shuffles and stored stages.
    for name in ("any_theme_by_dim", "theme_network", "tf_idf"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
