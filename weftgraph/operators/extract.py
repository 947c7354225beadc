"""From facts to a snapshot: entities become nodes, names are resolved by joins in ranks, relations become edges."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ids, rules
from ..functions.lineage import cut, stored
from ..sources.python_facts import facts as read_facts

# Phases in the order in which a pair's first relation stays.
PHASES = {"INHERITS": 1, "INSTANTIATES": 2, "CALLS": 3, "GLOBAL": 4, "USES": 6}
#: So many names at most are broadcast.
FEW = 100_000


def entities(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("fact") == "entity")
    full = F.concat_ws(".", F.nullif(F.replace("parent_name", F.lit("/"), F.lit(".")), F.lit("")), F.col("name"))
    return rows.select(
        "file_path", "seq", "kind", "name", "parent_name", full.alias("qualified"),
        ids.entity_key("kind", "file_path", "parent_name", "name").alias("key"), "description", "complexity", "is_exported", "list",
    )


def nodes(facts: DataFrame, tenant: str, repo: str, commit: str) -> DataFrame:
    """The envelope of files and entities; redefined names keep all their rows."""
    of = [F.lit(x) for x in (tenant, repo, commit)]
    meta = "description string, size bigint, file_type string, complexity int, is_exported boolean, modifiers array<string>"

    def rows(df, kind, name, parent, **fields):
        path = ids.symbol_path("file_path", parent, name)
        struct = F.struct(*((fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ") for x in meta.split(", "))))
        return df.select(
            ids.node_id(*of, kind, path).alias("id"), of[0].alias("tenant_id"), of[1].alias("repo_id"), of[2].alias("commit_sha"), kind.alias("entity_kind"),
            path.alias("symbol_path"), "file_path", name.alias("name"), parent.alias("parent_name"), struct.alias("metadata"),
        )

    files = facts.where(F.col("fact") == "file")
    own = rows(files, F.lit("File"), F.lit(ids.FILE_NAME), F.lit(""), description=F.col("description"), size=F.length("content"), file_type=F.lit("python"))
    more = rows(entities(facts), F.col("kind"), F.col("name"), F.col("parent_name"), description=F.col("description"), complexity=F.col("complexity"), is_exported=F.col("is_exported"), modifiers=F.coalesce("list", F.array()))
    return own.unionByName(more)


def resolved(wanted: DataFrame, known: DataFrame, own: bool = True) -> DataFrame:
    """wanted (id, fact, file_path, chain, via, module) with the best entity for its chain: t_*.  Without own, names that
    no entity of the same file has: file_path is not read then.

    In ranks: the same file; the module that the first part was imported from, as a name in it or as the module itself; the
    qualified name anywhere; for a plain name the last function of that name if it is called, else the first entity of
    that name; for a dotted one a method that a single class has.  Every rank is an equi join, and those that look
    anywhere join one entity a name, so common names do not multiply; the first entity by file and place wins a rank.
    """
    e = known.select(F.col("file_path").alias("t_file"), F.col("seq").alias("t_seq"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"),
                     F.col("parent_name").alias("t_parent"), F.col("qualified").alias("t_qualified"), F.col("key").alias("t_key"))
    whole, place = F.struct(*e.columns), F.struct("t_file", "t_seq")
    one = lambda df, by, pick: df.groupBy(F.col(by).alias("_name")).agg(pick(whole, place).alias("one")).select("_name", "one.*")
    plain = ~F.contains("chain", F.lit("."))
    tail = F.element_at(F.split("chain", r"\."), -1)
    last = F.element_at(F.split("module", "/"), -1)
    rest = F.nullif(F.regexp_replace("chain", r"^[^.]*\.?", ""), F.lit(""))
    # a module's path is the end of its file's, with or without __init__; both meet on the last folder or file name
    path = F.regexp_replace(F.regexp_replace("t_file", r"\.py$", ""), "(^|/)__init__$", "")
    slash = lambda x: F.concat(F.lit("/"), x)
    at = e.withColumn("_path", path).withColumn("_end", F.element_at(F.split("_path", "/"), -1))
    imported = wanted.where("module is not null")
    holder = F.nullif(F.regexp_replace("module", "/?[^/]*$", ""), F.lit(""))
    named = imported.withColumns({"_q": F.concat_ws(".", last, rest), "_holder": holder}).where("_holder is not null").withColumn("_last", F.element_at(F.split("_holder", "/"), -1))
    moduled = imported.withColumns({"_q": rest, "_last": last}).where("_q is not null")
    by_name = named.join(at, (F.col("_q") == F.col("t_qualified")) & (F.col("_last") == F.col("_end"))).where(F.endswith(slash(F.col("_path")), slash(F.col("_holder"))))
    by_module = moduled.join(at, (F.col("_q") == F.col("t_qualified")) & (F.col("_last") == F.col("_end"))).where(F.endswith(slash(F.col("_path")), slash(F.col("module"))))
    single = e.where("t_kind = 'Method' and t_parent <> ''").groupBy(F.col("t_name").alias("_name")).agg(F.countDistinct("t_parent").alias("k"), F.min_by(whole, place).alias("one")).where("k = 1").select("_name", "one.*")
    functions = one(e.where("t_kind = 'Method' and t_parent = ''"), "t_name", F.max_by)
    ranks = [
        *([wanted.join(e, (F.col("chain") == F.col("t_qualified")) & (F.col("file_path") == F.col("t_file")))] if own else []),
        by_name.drop("_q", "_holder", "_last", "_path", "_end"),
        by_module.drop("_q", "_last", "_path", "_end"),
        wanted.join(one(e, "t_qualified", F.min_by), F.col("chain") == F.col("_name")).where(~(plain & (F.col("fact") == "call"))).drop("_name"),
        wanted.where(plain & (F.col("fact") == "call")).join(functions, F.col("chain") == F.col("_name")).drop("_name"),
        wanted.where(plain).join(one(e, "t_name", F.min_by), F.col("chain") == F.col("_name")).drop("_name"),
        wanted.where(~plain).withColumn("_tail", tail).join(single, F.col("_tail") == F.col("_name")).drop("_tail", "_name"),
    ]
    found = None
    for number, r in enumerate(ranks, 1):
        r = r.withColumn("_rank", F.lit(number))
        found = r if found is None else found.unionByName(r)
    w = W.partitionBy("id").orderBy("_rank", "t_file", "t_seq")
    return found.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_rank")


def elsewhere(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """wanted (fact, chain, module and more) that entities of other files answer, with t_kind and t_key.

    Apart from its own file an answer depends on the name, the module and whether it is a call, so each such name is
    resolved once, however many files hold it, and only entities of these names take part.
    """
    call = F.when(F.col("fact") == "call", "call").otherwise("name")
    asked = cut(wanted.select(call.alias("fact"), "chain", "module").distinct())
    few = (lambda df: F.broadcast(df)) if asked.count() <= FEW else (lambda df: df)
    last = lambda c, cut_at: F.element_at(F.split(c, cut_at), -1)
    names = asked.select(F.explode(F.array(last("chain", r"\."), last("module", "/"))).alias("name")).distinct()
    known = cut(entities(facts).select("file_path", "seq", "kind", "name", "parent_name", "qualified", "key").join(few(names), "name", "left_semi"))
    hits = resolved(asked.select(F.struct("fact", "chain", "module").alias("id"), "fact", "chain", "module"), known, own=False)
    found = few(hits.select(F.col("fact").alias("_call"), F.col("chain").alias("_chain"), F.col("module").alias("_module"), "t_kind", "t_key"))
    same = (call == F.col("_call")) & (F.col("chain") == F.col("_chain")) & F.col("module").eqNullSafe(F.col("_module"))
    return wanted.join(found, same).drop("_call", "_chain", "_module")


def relations(facts: DataFrame) -> DataFrame:
    """source_key, target_key, relation_type, span, metadata fields; one relation a pair, imports apart."""
    own = lambda end: F.when(F.col(f"{end}_kind").isNotNull(), ids.entity_key(f"{end}_kind", "file_path", f"{end}_parent", f"{end}_name"))
    wanted = facts.where(F.col("fact").isin("import", "base", "call", "make", "param")).where("fact = 'import' or s_kind is not null").select(
        "fact", "file_path", "seq", "name", "module", "flag", "line", "col", "list", own("s").alias("source_key"), "t_kind", own("t").alias("t_key"),
        F.when(F.col("fact") == "import", F.col("name")).otherwise(F.regexp_replace("chain", r"\[.*", "")).alias("chain"),
    )
    hits = wanted.where("t_key is not null").unionByName(elsewhere(wanted.where("t_key is null").drop("t_kind", "t_key"), facts))
    kind = (
        F.when(F.col("fact") == "base", "INHERITS").when(F.col("fact") == "make", "INSTANTIATES").when(F.col("fact") == "call", "CALLS").otherwise("USES")
    )
    none = lambda t: F.lit(None).cast(t)
    is_call, is_super = F.col("fact") == "call", (F.col("fact") == "call") & F.col("flag")
    inner = (
        hits.where(F.col("fact") != "import")
        .withColumn("relation_type", kind)
        .where((~F.col("fact").isin("make", "param", "base")) | (F.col("t_kind") == "Class"))
        .select(
            "source_key", F.col("t_key").alias("target_key"), "relation_type", F.col("t_kind").alias("target_kind"), "file_path", "seq",
            F.array("line", "col").alias("span"), none("string").alias("import_symbol"),
            F.when(is_call, F.contains("chain", F.lit("."))).alias("is_method"), F.when(is_call & ~is_super, F.col("list")).alias("resolution_path"),
            F.when(is_super, True).alias("is_super_call"), F.when(is_super, F.col("name")).alias("parent_class"),
            F.when(F.col("fact") == "param", True).alias("is_param_type"),
        )
    )
    seen = facts.where("fact = 'global' and s_kind is not null and t_kind is not null")
    uses = seen.select(
        own("s").alias("source_key"), own("t").alias("target_key"), F.when(F.col("flag"), "MODIFIES").otherwise("USES").alias("relation_type"),
        F.lit("Variable").alias("target_kind"), "file_path", "seq", F.array("line", "col").alias("span"),
    )
    every = inner.withColumn("phase", F.when(F.col("is_param_type"), 6).otherwise(_phase())).unionByName(uses.withColumn("phase", F.lit(PHASES["GLOBAL"])), allowMissingColumns=True)
    single = rules.one_per_pair(every.where("source_key <> target_key"))
    order = W.partitionBy("file_path", "t_key").orderBy("chain")
    imports = (
        hits.where((F.col("fact") == "import") & (F.col("t_kind").isNotNull())).withColumn("_place", F.row_number().over(order)).where("_place = 1")
        .select(ids.file_key(F.col("file_path")).alias("source_key"), F.col("t_key").alias("target_key"), F.lit("IMPORTS").alias("relation_type"),
                F.array("line", "col").alias("span"), F.col("chain").alias("import_symbol"))
    )
    return imports.unionByName(single.drop("phase", "seq", "file_path", "target_kind"), allowMissingColumns=True)


def _phase():
    kind = F.col("relation_type")
    return F.when(kind == "INHERITS", 1).when(kind == "INSTANTIATES", 2).otherwise(3)


def edges(rels: DataFrame, node_rows: DataFrame) -> DataFrame:
    """The envelope of relations whose two ends are nodes."""
    key = F.when(F.col("entity_kind") == "File", ids.file_key("file_path")).otherwise(ids.entity_key("entity_kind", "file_path", "parent_name", "name"))
    known = node_rows.select(key.alias("k"), "id", "tenant_id", "repo_id", "commit_sha").dropDuplicates(["k"])
    ruled = rules.with_rule(rels, F.col("is_super_call"))
    joined = ruled.join(known.withColumnRenamed("id", "source_id"), F.col("source_key") == F.col("k")).drop("k").join(
        known.select("k", F.col("id").alias("target_id")), F.col("target_key") == F.col("k"))
    names = ("import_symbol", "is_method", "resolution_path", "is_super_call", "parent_class", "is_param_type")
    return joined.select(
        ids.edge_id("source_id", "relation_type", "target_id", "rule_id").alias("id"), "tenant_id", "repo_id", "commit_sha", "source_id", "target_id", "relation_type",
        F.struct("extractor_pass", "rule_id", F.col("span").alias("source_span"), "confidence").alias("provenance"), F.struct(*names).alias("metadata"),
    )


def snapshot(files: DataFrame, tenant: str, repo: str, commit: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of Python files (file_path, content)."""
    found = stored(read_facts(files))
    node_rows = nodes(found, tenant, repo, commit)
    return node_rows, edges(relations(found), node_rows)


def document(node_rows: DataFrame, edge_rows: DataFrame, tenant: str, repo: str, commit: str) -> dict:
    """The canonical JSON document of one repository's snapshot; its size is a repository's, so it is built on the driver."""
    node_list = [json.loads(r[0]) for r in node_rows.orderBy("id").select(F.to_json(F.struct("*"))).collect()]
    edge_list = [json.loads(r[0]) for r in edge_rows.orderBy("source_id", "relation_type", "target_id", "id").select(F.to_json(F.struct("*"))).collect()]
    return {"tenant_id": tenant, "repo_id": repo, "commit_sha": commit, "graph_version": ids.GRAPH_VERSION, "schema_hash": ids.SCHEMA_HASH, "nodes": node_list, "edges": edge_list}


def snapshot_hash(doc: dict) -> str:
    bare = {k: v for k, v in doc.items() if k != "generated_at"}
    return hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_digest(df: DataFrame, *order: str) -> DataFrame:
    """A digest of any number of rows, by sums of row hashes: the distributed counterpart of snapshot_hash()."""
    h = F.xxhash64(F.to_json(F.struct("*")))
    return df.agg(F.count("*").alias("rows"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("low"), F.sum(F.pmod(F.shiftright(h, 32), F.lit(1 << 31))).alias("high"))
