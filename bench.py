"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["revenue_by_nation", "agg_numeric", "scan_filter_project", "join_equi", "join_anti", "topk", "agg_count_unique", "agg_latest_by", "graph_expansion_2", "graph_pagerank", "graph_connected_components", "graph_triangles", "recursion_transitive_closure", "recursion_min_hops", "knn_cosine", "fts_tf_idf", "asof_scan"]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tesserae.queries import QUERIES

    seconds = {}
    for name in HEADLINE:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # code is compiled, files are seen
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name}))


if __name__ == "__main__":
    main()
