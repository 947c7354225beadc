"""Graphviz text of a typed graph: one cluster a package with its files, types, functions and variables, then edges.

Lines are built and ordered inside Spark, one row a package; only the finished text leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text

# Fixed value: characters of a record label before it goes on in another part.
PART = 16_000


def parts(rows: DataFrame, keys: list[str], order: str, label: Column, most: int = PART) -> DataFrame:
    """keys, part, label: numbered labels of each group, packed in order into parts of at most `most` characters.

    A part's length starts again at zero, so it is a fold over the group's sorted labels, not a running sum.
    """
    number = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    one = rows.withColumn("_n", number).withColumn("_l", F.concat(F.lit("<f"), F.col("_n"), F.lit("> "), label))
    every = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"])
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc, line):
        long = F.length(acc["now"]) + F.length(line) + 1 > most
        joined = F.when(acc["now"] == "", line).otherwise(F.concat(acc["now"], F.lit("|"), line))
        return F.when(long & (acc["now"] != ""), F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), line.alias("now"))).otherwise(
            F.struct(acc["done"].alias("done"), joined.alias("now")))

    packed = F.aggregate(every, empty, add, lambda acc: F.array_append(acc["done"], acc["now"]))
    return one.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.posexplode("_p").alias("part", "label"))


def _flat(nodes: DataFrame) -> DataFrame:
    name = F.coalesce("data.struct_name", "data.function_name", "data.interface_name", "data.name", "data.file_path", "id")
    return nodes.select("id", "type", F.coalesce("data.package_name", F.lit("")).alias("package"), name.alias("name"),
                        "data.parent_struct", "data.fields", "data.params", "data.file_path")


def record_lines(nodes: DataFrame) -> DataFrame:
    """package, line of the records of a package: files, global functions, variables, and one for each type."""
    rows = _flat(nodes)
    out = None
    for kind, own in (("file", rows.where("type = 'file'")), ("function", rows.where("type = 'function' and coalesce(parent_struct, '') = ''")), ("variable", rows.where("type = 'variable'"))):
        label = F.concat(text.dot_params("name"), F.when(F.lit(kind == "function"), F.concat(F.lit("("), text.dot_params(F.coalesce("params", F.lit(""))), F.lit(")"))).otherwise(F.lit("")))
        packed = parts(own, ["package"], "name", label)
        node = F.concat(text.dot_id("package"), F.lit(f"_{kind}s_"), F.col("part"))
        line = F.concat(node, F.lit(' [shape=record,label="{'), F.col("label"), F.lit('}"];'))
        chained = F.when(F.col("part") > 0, F.concat(text.dot_id("package"), F.lit(f"_{kind}s_"), F.col("part") - 1, F.lit(" -> "), node, F.lit(" [style=invis];")))
        lines = packed.select("package", F.explode(F.array_compact(F.array(line, chained))).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    types = rows.where("type in ('struct', 'interface', 'enum')")
    methods = rows.where("type = 'function' and coalesce(parent_struct, '') <> ''").groupBy("package", F.col("parent_struct").alias("name")).agg(
        F.array_sort(F.collect_list("name")).alias("methods"))
    mark = lambda letter: lambda x, i: F.concat(F.lit(f"<{letter}"), i + 1, F.lit("> "), x)
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")), mark("fd"))
    own = F.transform(F.coalesce("methods", F.array().cast("array<string>")), mark("m"))
    record = F.concat(text.dot_id("id"), F.lit(' [shape=record,label="{'), F.array_join(F.concat(F.array("name"), fields, own), "|"), F.lit('}"];'))
    return out.unionByName(types.join(methods, ["package", "name"], "left").select("package", record.alias("line")))


def edge_lines(edges: DataFrame, kinds=("extends", "references", "calls")) -> DataFrame:
    own = edges.where(F.col("relation_type").isin(*kinds))
    return own.select(F.concat(text.dot_id("source_id"), F.lit(" -> "), text.dot_id("target_id"), F.lit(' [label="'), F.col("relation_type"), F.lit('"];')).alias("line")).distinct()


def held_lines(nodes: DataFrame) -> DataFrame:
    """Edges from files to the functions and types that they hold."""
    rows = _flat(nodes)
    files = rows.where("type = 'file'").select(F.col("id").alias("f"), "package", "file_path")
    held = rows.where("type in ('function', 'struct')").select("id", "package", "file_path")
    return files.join(held, ["package", "file_path"]).select(F.concat(text.dot_id("f"), F.lit(" -> "), text.dot_id("id"), F.lit(' [label="has"];')).alias("line"))


def clusters(nodes: DataFrame) -> DataFrame:
    """package, dot: the finished cluster of each package."""
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n    ")
    grouped = record_lines(nodes).groupBy("package").agg(body.alias("b"))
    return grouped.select("package", F.concat(F.lit("  subgraph cluster_"), text.dot_id("package"), F.lit(' {\n    label="'), F.col("package"), F.lit('";\n    '), F.col("b"), F.lit("\n  }")).alias("dot"))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One Graphviz file; lines stream through the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("digraph G {\n")
        for row in clusters(nodes).orderBy("package").toLocalIterator():
            out.write(row.dot + "\n")
        for row in edge_lines(edges).unionByName(held_lines(nodes)).orderBy("line").toLocalIterator():
            out.write("  " + row.line + "\n")
        out.write("}\n")
