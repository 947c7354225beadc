"""Listings of a typed graph: packages, and the files, functions, structs, interfaces and subpackages of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..sources.kg_json import flat


def _flat(nodes: DataFrame) -> DataFrame:
    return flat(nodes).withColumnRenamed("weights", "w")


def _n(name: str):
    return F.coalesce(F.col(f"w.{name}"), F.lit(0)).alias(name)


def list_packages(nodes: DataFrame) -> DataFrame:
    names = ("go_files_count", "struct_count", "interface_count", "function_count", "subpackage_count")
    return _flat(nodes).where("type = 'package'").select("id", "package_name", *map(_n, names))


def list_package_files(nodes: DataFrame, package_id: str) -> DataFrame:
    rows = _flat(nodes).where((F.col("type") == "file") & (F.col("package_id") == package_id))
    return rows.select("id", "file_path", *map(_n, ("code_line_count", "struct_count", "function_count", "interface_count")))


def in_package(nodes: DataFrame, package_id: str, kind: str) -> DataFrame:
    """Nodes of a kind by the package's name; an id that is no package serves as the name itself."""
    rows = _flat(nodes)
    named = rows.where((F.col("id") == package_id) & (F.col("type") == "package")).select("package_name").limit(1).collect()
    return rows.where((F.col("type") == kind) & (F.col("package_name") == (named[0][0] if named else package_id)))


def list_package_functions(nodes: DataFrame, package_id: str) -> DataFrame:
    signature = F.concat(F.coalesce("function_name", "name"), F.lit("("), F.coalesce("params", F.lit("")), F.lit(") "), F.coalesce("returns", F.lit("")))
    rows = in_package(nodes, package_id, "function")
    return rows.select("id", F.rtrim(signature).alias("signature"), *map(_n, ("importance", "callee_count", "caller_count")), "location", F.count("*").over(_all()).alias("total"))


def list_package_structs(nodes: DataFrame, package_id: str) -> DataFrame:
    rows = in_package(nodes, package_id, "struct")
    generic = F.coalesce("is_generic", F.lit(False)).alias("is_generic")
    counts = map(_n, ("importance", "field_count", "method_count", "reference_count", "total_instance_count"))
    return rows.select("id", F.coalesce("struct_name", "name").alias("name"), generic, *counts, "location", F.count("*").over(_all()).alias("total"))


def list_package_interfaces(nodes: DataFrame, package_id: str) -> DataFrame:
    """Methods are listed by their signatures."""
    rows = in_package(nodes, package_id, "interface")
    return rows.select("id", F.coalesce("interface_name", "name").alias("name"), F.coalesce("methods", F.array()).alias("methods"), "location")


def list_subpackages(nodes: DataFrame, package_id: str) -> DataFrame:
    rows = _flat(nodes).where("type = 'package'").select("id", "package_name", F.col("location.file_path").alias("path"))
    parent = rows.where(F.col("id") == package_id).select(F.col("package_name").alias("p_name"), F.col("path").alias("p_path")).limit(1).collect()
    if not parent:
        return rows.limit(0)
    below = text.is_subpackage(F.lit(parent[0].p_path), "path", F.lit(parent[0].p_name))
    return rows.where((F.col("id") != package_id) & below)


def _all():
    from pyspark.sql import Window as W

    return W.partitionBy("package_name")


def call_listing(edges: DataFrame) -> DataFrame:
    """caller, callee, relation: what the call-graph command prints; one row a pair, whichever relation came first."""
    kinds = edges.where(F.col("relation_type").isin("calls", "instantiates"))
    return kinds.groupBy(F.col("source_id").alias("caller"), F.col("target_id").alias("callee")).agg(F.min("relation_type").alias("relation"))


def resolve_calls(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_type, target_id, relation_type of call facts (caller_id, function_id, interface_id,
    relation_type): the function where it exists, else the interface method; one row a pair of ends."""
    known = nodes.select("id", "type")
    fn, it = known.alias("fn"), known.alias("it")
    joined = (
        facts.join(fn, F.col("function_id") == F.col("fn.id"), "left").join(it, F.col("interface_id") == F.col("it.id"), "left")
        .withColumn("target_id", F.coalesce("fn.id", "it.id")).where("target_id is not null")
        .withColumn("target_type", F.when(F.col("fn.id").isNotNull(), F.col("fn.type")).otherwise(F.lit("interface_function")))
    )
    return joined.groupBy(F.col("caller_id").alias("source_id"), "target_id").agg(
        F.min(F.struct("relation_type", "target_type")).alias("m")
    ).select("source_id", "m.target_type", "target_id", "m.relation_type")


def nearest(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each wanted (key, name, file_path, package_name) the best candidate (name, id, file_path, package_name, seq):
    in package main by path distance, else of the same package, else the first."""
    c = candidates.select("name", F.col("id").alias("c_id"), F.col("file_path").alias("c_path"), F.col("package_name").alias("c_package"), "seq")
    main = F.col("package_name") == "main"
    rank = F.when(main, 0).when(F.col("package_name") == F.col("c_package"), 0).otherwise(1)
    distance = F.when(main, text.path_distance("file_path", "c_path")).otherwise(0)
    return wanted.join(c, "name").groupBy("key").agg(F.min_by("c_id", F.struct(rank, distance, F.col("seq"))).alias("id"))
