"""Command line: snapshot of a Python tree; weights and PageRank, paths, listings and Graphviz text of a typed graph."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession, functions as F


def snapshot(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import extract
    from .sources.files import python_files

    if not os.path.isdir(a.source):
        raise SystemExit(f"source is not a directory: {a.source}")
    files = python_files(spark, a.source)
    if files.isEmpty():
        raise SystemExit(f"no Python files in {a.source}")
    doc = extract.document(*extract.snapshot(files, a.tenant, a.repo, a.commit), a.tenant, a.repo, a.commit)
    with open(a.output, "w") as out:
        json.dump(doc, out, indent=2, sort_keys=True)
    print(json.dumps({"output": a.output, "graph_version": doc["graph_version"], "schema_hash": doc["schema_hash"],
                      "snapshot_hash": extract.snapshot_hash(doc), "nodes": len(doc["nodes"]), "edges": len(doc["edges"])}))


def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import importance, listings, paths, weights
    from .operators.pagerank import pagerank
    from .sources import dot, kg_json

    nodes, edges = kg_json.read_graph(spark, a.graph)
    if a.command == "pagerank":
        kg_json.write_lines(pagerank(nodes, edges), a.output)
    elif a.command == "weights":
        files = spark.read.parquet(a.files) if a.files else spark.createDataFrame([], "file_path string, content string")
        kg_json.write_lines(kg_json.with_weights(nodes, weights.node_weights(nodes, edges, files)), a.output)
    elif a.command == "importance":
        flat = nodes.select("id", "type", "weights.*")
        score = importance.metric_score("callee_count", "caller_count", "reference_count", "function_count", "struct_count")
        kg_json.write_lines(kg_json.with_importance(nodes, importance.staged_importance(flat, edges, score)), a.output)
    elif a.command == "tagging":
        flat = nodes.where("type = 'function'").select("id", F.coalesce("weights.tags", importance.keyword_tags(F.coalesce("data.function_name", "data.name", "id"))).alias("tags"), "weights.callee_count")
        found = paths.longest_sample(paths.long_paths(*paths.core_call_graph(flat, edges)))
        kg_json.write_lines(found, f"{a.output}/paths")
        kg_json.write_lines(paths.common_subpaths(found), f"{a.output}/common_paths")
        kg_json.write_lines(flat.select("id", "tags"), f"{a.output}/tags")
    elif a.command == "callgraph":
        kg_json.write_lines(listings.call_listing(edges), a.output)
    else:
        dot.write_dot(nodes, edges, a.output)


def main() -> None:
    parser = argparse.ArgumentParser(prog="weftgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("snapshot")
    for name in ("tenant", "repo", "commit", "source", "output"):
        own.add_argument(f"--{name}", required=True)
    for name in ("pagerank", "weights", "importance", "tagging", "callgraph", "dot"):
        p = commands.add_parser(name)
        p.add_argument("--graph", required=True)
        p.add_argument("--files")
        p.add_argument("--output", required=True)
    a = parser.parse_args()
    spark = SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    (snapshot if a.command == "snapshot" else graph)(spark, a)


if __name__ == "__main__":
    main()
