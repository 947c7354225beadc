"""The typed graph of Go sources from facts: nodes by kind, and edges by equi joins on names within packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, text
from ..functions.lineage import cut
from ..sources.brace_facts import go_facts


def _id(kind: str, name, path="file_path"):
    return ids.typed_id(F.lit(kind), name, path)


def typed_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, name, package_name, file_path, owner, detail, line, line_end) and edges (source_type, source_id,
    target_type, target_id, relation_type) of Go files (file_path, content)."""
    facts = cut(go_facts(files))
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    full = F.when(F.col("owner") != "", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    package = facts.select(_id("package", F.col("package_name"), folder).alias("id"), F.lit("package").alias("type"), F.col("package_name").alias("name"), "package_name", folder.alias("file_path")).distinct()
    file = facts.select(_id("file", F.element_at(F.split("file_path", "/"), -1)).alias("id"), F.lit("file").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "package_name", "file_path").distinct()
    kinds = {"struct": "struct", "type": "struct", "interface": "interface", "function": "function", "field": "field", "variable": "variable", "enum": "enum", "method_spec": "interface_func", "import": "import"}
    own = None
    for fact, kind in kinds.items():
        name = F.col("name") if fact in ("struct", "type", "interface", "import") else full
        part = facts.where(F.col("fact") == fact).select(_id(kind, name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), "package_name", "file_path", "owner", F.col("type").alias("value"), "detail", "line", "line_end")
        own = part if own is None else own.unionByName(part)
    nodes = package.unionByName(file).unionByName(own, allowMissingColumns=True).dropDuplicates(["id", "line"])
    known = cut(nodes.select("id", "type", "name", "package_name", "file_path", "owner", "value"))
    of = lambda *t: known.where(F.col("type").isin(*t))
    package_of = _id("package", F.col("package_name"), folder)
    edge = lambda df, st, s, tt, t, r: df.select(
        (F.lit(st) if isinstance(st, str) else st).alias("source_type"), s.alias("source_id"), (F.lit(tt) if isinstance(tt, str) else tt).alias("target_type"), t.alias("target_id"), F.lit(r).alias("relation_type"))
    parts = [
        edge(of("struct"), "package", package_of, "struct", F.col("id"), "has_struct"),
        edge(of("interface"), "package", package_of, "interface", F.col("id"), "has_interface"),
        # an import is one node for all files that have it, so its edges come from the facts
        edge(facts.where("fact = 'import'"), "file", _id("file", F.element_at(F.split("file_path", "/"), -1)), "import", _id("import", F.col("name")), "has_import"),
        edge(of("function").where("owner = ''"), "package", package_of, "function", F.col("id"), "has_function"),
        edge(of("enum"), "package", package_of, "enum", F.col("id"), "has_value"),
    ]
    types = of("struct", "interface").select(F.col("id").alias("t_id"), F.col("type").alias("t_type"), F.col("name").alias("t_name"), F.col("package_name").alias("t_package")).dropDuplicates(["t_package", "t_name"])
    owned = of("field", "function", "interface_func").where("owner <> ''").join(types, (F.col("owner") == F.col("t_name")) & (F.col("package_name") == F.col("t_package")))
    parts += [
        edge(owned.where("type = 'field'"), F.col("t_type"), F.col("t_id"), "field", F.col("id"), "has_field"),
        edge(owned.where("type <> 'field'"), F.col("t_type"), F.col("t_id"), F.col("type"), F.col("id"), "has_method"),
    ]
    refers = of("field", "variable").withColumn("_r", F.explode(text.referenced_types("value"))).withColumn("_r", F.element_at(F.split("_r", r"\."), -1))
    parts.append(edge(refers.join(types, (F.col("_r") == F.col("t_name")) & (F.col("package_name") == F.col("t_package"))), F.col("type"), F.col("id"), F.col("t_type"), F.col("t_id"), "references"))
    embeds = facts.where("fact = 'embed'").select("owner", F.element_at(F.split("name", r"\."), -1).alias("_r"), "package_name")
    child = types.select(F.col("t_id").alias("c_id"), F.col("t_type").alias("c_type"), F.col("t_name").alias("c_name"), F.col("t_package").alias("c_package"))
    joined = embeds.join(child, (F.col("owner") == F.col("c_name")) & (F.col("package_name") == F.col("c_package"))).join(types, (F.col("_r") == F.col("t_name")) & (F.col("package_name") == F.col("t_package")))
    parts.append(edge(joined, F.col("c_type"), F.col("c_id"), F.col("t_type"), F.col("t_id"), "extends"))
    callers = of("function").select(F.col("id").alias("s_id"), F.col("name").alias("s_name"), F.col("file_path").alias("s_file"))
    made = facts.where("fact in ('call', 'literal')").withColumn("_last", F.element_at(F.split("name", r"\."), -1))
    made = made.join(callers, (F.col("owner") == F.col("s_name")) & (F.col("file_path") == F.col("s_file")))
    target = of("function").select(F.col("id").alias("f_id"), F.element_at(F.split("name", r"\."), -1).alias("f_last"), F.col("package_name").alias("f_package"), F.col("owner").alias("f_owner"))
    plain = (F.col("_last") == F.col("f_last")) & ((F.col("package_name") == F.col("f_package")) | F.contains("name", F.concat("f_package", F.lit("."))))
    calls = made.where("fact = 'call'").join(target, plain).groupBy("s_id", "name", "_last").agg(F.min("f_id").alias("f_id"))
    parts += [
        edge(calls, "function", F.col("s_id"), "function", F.col("f_id"), "calls"),
        edge(made.where("fact = 'literal'").join(types, F.col("_last") == F.col("t_name")).groupBy("s_id", "_last").agg(F.min("t_id").alias("t_id")), "function", F.col("s_id"), "struct", F.col("t_id"), "instantiates"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one edge a pair of ends and type; of calls and literals one a pair
    kind = F.when(F.col("relation_type").isin("calls", "instantiates"), "call").otherwise(F.col("relation_type"))
    edges = out.withColumn("_k", kind).groupBy("source_id", "target_id", "_k").agg(F.min(F.struct("relation_type", "source_type", "target_type")).alias("m"))
    return nodes, edges.select("m.source_type", "source_id", "m.target_type", "target_id", "m.relation_type")
