"""Times the headline graph queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Sources and merging, access, scalars, joins, aggregations, patterns, questions, communities and exports.
HEADLINE = (
    "merge_nodes_last_wins", "merge_edges_last_wins", "graph_counts", "degree", "raw_degree", "infer_types", "external_types", "god_nodes", "god_node_details",
    "inheritance_trees", "surprising_connections", "command_pattern", "builder_factory", "observer_pattern", "strategy_pairs", "enums", "key_files", "runtime_deps",
    "directory_deps", "directory_stats", "cohesion", "modularity", "community_labels", "components", "bfs_depth2", "token_budget", "shortest_path_len",
    "explain_node", "word_count", "classify_files", "cypher_lines",
)


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf_dir = os.environ.get("BENCH_CPUS", str(os.cpu_count())), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomgraph.plans.catalogue import QUERIES

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("word_count")  # warms the JVM up; the first query of the graph makes it
    times = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline graph queries, total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
