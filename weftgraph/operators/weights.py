"""Structural weights of typed nodes: one grouped pass over edges or members for each kind, never nodes times edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..sources.kg_json import flat
from .pagerank import pagerank

#: Kinds that get weights.
ELIGIBLE = ("package", "struct", "function", "interface", "file")


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("int")


def edge_counts(edges: DataFrame) -> DataFrame:
    """id and what its edges say: calls in and out without loops, recursion, instances, methods, references, imports.

    Both directions of the edges go through one aggregation, so there is a single shuffle.
    """
    loop = F.col("source_id") == F.col("target_id")
    out = edges.select(F.col("source_id").alias("id"), F.lit(True).alias("out"), "relation_type", loop.alias("loop"))
    inn = edges.select(F.col("target_id").alias("id"), F.lit(False).alias("out"), "relation_type", loop.alias("loop"))
    kind, outward, is_loop = F.col("relation_type"), F.col("out"), F.col("loop")
    return out.unionByName(inn).groupBy("id").agg(
        _count(~outward & (kind == "calls") & ~is_loop).alias("callee_count"),
        _count(outward & (kind == "calls") & ~is_loop).alias("caller_count"),
        F.coalesce(F.bool_or((kind == "calls") & is_loop), F.lit(False)).alias("self_recursive_func"),
        _count(outward & (kind == "instantiates")).alias("instantiated_by_function"),
        _count(~outward & (kind == "instantiates")).alias("total_instance_count"),
        _count(outward & (kind == "has_method")).alias("method_count"),
        _count(~outward & (kind == "references")).alias("reference_count"),
        _count(outward & (kind == "has_import")).alias("import_count"),
    )


def _with_counts(nodes: DataFrame, edges: DataFrame, *names: str) -> DataFrame:
    counted = nodes.join(edge_counts(edges).select("id", *names), "id", "left")
    return counted.withColumns({n: F.coalesce(n, F.lit(False) if n == "self_recursive_func" else F.lit(0)) for n in names})


def function_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, line, line_end."""
    names = ("callee_count", "caller_count", "self_recursive_func", "instantiated_by_function")
    return _with_counts(nodes, edges, *names).select("id", text.line_span("line", "line_end").alias("code_line_count"), *names)


def struct_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, fields, line, line_end."""
    names = ("method_count", "reference_count", "total_instance_count")
    return _with_counts(nodes, edges, *names).select(
        "id", text.line_span("line", "line_end").alias("code_line_count"),
        F.coalesce(F.size("fields"), F.lit(0)).alias("field_count"), *names,
    )


def interface_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, methods."""
    return _with_counts(nodes, edges, "reference_count").select(
        "id", F.coalesce(F.size("methods"), F.lit(0)).alias("method_count"), "reference_count"
    )


def file_weights(files: DataFrame, members: DataFrame) -> DataFrame:
    """files: id, file_path, content; members: type, file_path."""
    counted = members.groupBy("file_path").agg(
        *(_count(F.col("type") == k).alias(f"{k}_count") for k in ("struct", "function", "interface"))
    )
    return files.join(counted, "file_path", "left").select(
        "id", text.line_count("content").alias("code_line_count"),
        *(F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}_count") for k in ("struct", "function", "interface")),
    )


def prefix_pairs(packages: DataFrame) -> DataFrame:
    """id, other: packages whose folder string starts with this one's, /a/b with /a/bc too.

    Every prefix of a folder is one row, so pairs meet in an equi join: paths are short, packages are many.
    """
    longer = packages.select(
        F.col("id").alias("other"), F.col("file_path").alias("_path"),
        F.explode(F.sequence(F.lit(1), F.length("file_path"))).alias("_n"),
    ).select("other", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("_prefix"))
    return packages.select("id", "file_path").join(longer, (F.col("file_path") == F.col("_prefix")) & (F.col("file_path") != F.col("_path"))).select("id", "other")


def package_weights(packages: DataFrame, members: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """packages: id, package_name, file_path (folder); members: type, package_name; files: file_path, content.

    Members count by package name, so packages of one name in different folders share them.  `main` gets none.
    """
    packages = packages.where("package_name <> 'main'")
    counted = members.groupBy("package_name").agg(
        *(_count(F.col("type") == k).alias(f"{k}_count") for k in ("struct", "function", "interface"))
    )
    own = F.regexp_replace("file_path", "/[^/]*$", "")
    lines = F.when(~F.contains("file_path", F.lit("_test.go")), text.line_count("content")).otherwise(0)
    sources = files.where(F.col("file_path").endswith(".go")).groupBy(own.alias("_folder")).agg(
        F.count("*").cast("int").alias("go_files_count"), F.sum(lines).cast("int").alias("code_line_count")
    )
    below = prefix_pairs(packages).groupBy("id").agg(F.count("*").cast("int").alias("subpackage_count"))
    names = ("struct_count", "function_count", "interface_count", "go_files_count", "code_line_count", "import_count", "subpackage_count")
    joined = (
        packages.join(counted, "package_name", "left").join(sources, packages["file_path"] == sources["_folder"], "left")
        .join(below, "id", "left").join(edge_counts(edges).select("id", "import_count"), "id", "left")
    )
    return joined.select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def node_weights(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """id, type and one `weights` struct for every eligible node of a typed graph, PageRank included."""
    place = flat(nodes).drop("weights").withColumns({"line": F.col("location.line"), "line_end": F.col("location.lineEnd")})
    of = lambda kind: place.where(F.col("type") == kind)
    folder = of("package").select("id", "package_name", F.col("location.file_path").alias("file_path"))
    members = place.where(F.col("type").isin("struct", "function", "interface"))
    by_file = members.select("type", F.regexp_extract("id", "([^:]*)$", 1).alias("file_path"))
    parts = (
        function_weights(of("function"), edges), struct_weights(of("struct"), edges), interface_weights(of("interface"), edges),
        file_weights(of("file").drop("content").join(files.select("file_path", "content"), "file_path"), by_file),
        package_weights(folder, members, files, edges),
    )
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    ranks = pagerank(nodes, edges)
    eligible = nodes.where(F.col("type").isin(*ELIGIBLE)).select("id", "type")
    joined = eligible.join(out, "id", "left").join(ranks, "id", "left")
    return joined.select("id", "type", F.struct(*(c for c in joined.columns if c not in ("id", "type"))).alias("weights"))
