"""The typed graph as JSON: {nodes: [{id, type, data, weights}], edges: [...]}; read, write, merge results back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

LOCATION = "location struct<file_path:string,line:int,lineEnd:int>"
DATA = (
    "data struct<package_name:string,package_id:string,name:string,file_path:string,parent_struct:string,"
    f"struct_name:string,function_name:string,interface_name:string,params:string,returns:string,code:string,type:string,"
    f"is_generic:boolean,fields:array<string>,methods:array<string>,{LOCATION.replace(' ', ':', 1)}>"
)
WEIGHTS = (
    "weights struct<code_line_count:int,go_files_count:int,struct_count:int,interface_count:int,function_count:int,"
    "import_count:int,subpackage_count:int,main_func_and_struct_names:array<string>,field_count:int,method_count:int,"
    "total_instance_count:int,reference_count:int,callee_count:int,caller_count:int,instantiated_by_function:int,"
    "self_recursive_func:boolean,importance:int,page_rank_score:double,tags:array<string>>"
)
NODE = f"struct<id:string,type:string,{DATA.replace(' ', ':', 1)},{WEIGHTS.replace(' ', ':', 1)}>"
EDGE = "struct<source_type:string,source_id:string,target_type:string,target_id:string,relation_type:string>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of one graph file or a folder of them.  A file is one JSON document, so files are the unit of
    parallelism; the Parquet written by write_tables() is the form for large graphs."""
    raw = spark.read.schema(f"nodes array<{NODE}>, edges array<{EDGE}>").option("multiLine", True).json(path)
    return raw.select(F.inline("nodes")), raw.select(F.inline("edges"))


def flat(nodes: DataFrame) -> DataFrame:
    """id, type and the fields of data, whose own type is data_type."""
    fields = [c for c in nodes.select("data.*").columns if c != "type"]
    return nodes.select("id", "type", *(f"data.{c}" for c in fields), F.col("data.type").alias("data_type"), "weights")


def write_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.orderBy("id"), edges.orderBy("source_id", "target_id", "relation_type")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON document for tools that read one: rows stream through the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        for k, (name, df) in enumerate(zip(("nodes", "edges"), canonical(nodes, edges))):
            out.write(("{" if not k else ",") + f'\n"{name}": [')
            for i, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
                out.write((",\n" if i else "\n") + row.j)
            out.write("\n]")
        out.write("\n}\n")


def write_lines(df: DataFrame, path: str) -> None:
    """Results such as paths, common paths and tags: JSON lines, written in parallel."""
    df.write.mode("overwrite").json(path)


def with_weights(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Every node, with its new weights where it has some."""
    return nodes.drop("weights").join(weights.select("id", "weights"), "id", "left")


def with_importance(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """weights.importance replaced where scores (id, importance) have a value."""
    new = scores.select("id", F.col("importance").alias("_new"))
    joined = nodes.join(new, "id", "left")
    filled = F.col("weights").withField("importance", F.coalesce("_new", "weights.importance"))
    bare = F.from_json(F.to_json(F.struct(F.col("_new").alias("importance"))), WEIGHTS.split(" ", 1)[1])
    kept = F.when(F.col("weights").isNotNull(), filled).when(F.col("_new").isNotNull(), bare)
    return joined.withColumn("weights", kept).drop("_new")


def with_tags(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """weights.tags replaced where tags (id, tags) have a value."""
    joined = nodes.join(tags.select("id", F.col("tags").alias("_new")), "id", "left")
    return joined.withColumn("weights", F.col("weights").withField("tags", F.coalesce("_new", "weights.tags"))).drop("_new")


def load_rows(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    """Graph frames from a small in-memory document (tests, requests)."""
    line = spark.createDataFrame([(json.dumps(document),)], "j string")
    both = line.select(F.from_json("j", f"nodes array<{NODE}>, edges array<{EDGE}>").alias("g"))
    return both.select(F.inline("g.nodes")), both.select(F.inline("g.edges"))
