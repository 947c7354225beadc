"""The property graph over the star-schema tables: the same envelope as a code graph, from tables instead of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids
from ..functions.rules import with_rule

TENANT, REPO, COMMIT = "t0", "tpch", "c0"
#: kind, table, key column, name column, parent's table and key column.
NODES = (
    ("Repository", "region", "r_regionkey", "r_name", None, None),
    ("Module", "nation", "n_nationkey", "n_name", "region", "n_regionkey"),
    ("File", "customer", "c_custkey", "c_name", "nation", "c_nationkey"),
    ("Method", "orders", "o_orderkey", "o_orderpriority", "customer", "o_custkey"),
    ("Class", "part", "p_partkey", "p_name", None, None),
    ("Interface", "supplier", "s_suppkey", "s_name", None, None),
)
KIND = {table: kind for kind, table, *_ in NODES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(name: str, key) -> F.Column:
    return F.concat(F.lit(name + "/"), ids.col(key).cast("string"))


def node_ref(name: str, key):
    """Node id of a table's row.  Parts hold nothing to sanitize, so ids are plain concatenations."""
    return F.concat(F.lit(f"{TENANT}|{REPO}|{COMMIT}|{KIND[name]}|"), _path(name, key))


def node_code(name: str, key):
    """A table's row as one number, 8 * key + the place of its table in NODES: a short id for joins."""
    return ids.col(key).cast("long") * 8 + [n for _, n, *_ in NODES].index(name)


def node_name(code) -> F.Column:
    """The node id of a code; null stays null."""
    heads = F.array(*(F.lit(f"{TENANT}|{REPO}|{COMMIT}|{kind}|{name}/") for kind, name, *_ in NODES))
    return F.concat(F.get(heads, code.bitwiseAND(F.lit(7)).cast("int")), F.shiftright(code, 3).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, name, key, label, up, up_key in NODES:
        part = table(spark, sf_dir, name).select(
            node_ref(name, key).alias("id"), F.lit(TENANT).alias("tenant_id"), F.lit(REPO).alias("repo_id"),
            F.lit(COMMIT).alias("commit_sha"), F.lit(kind).alias("entity_kind"), _path(name, key).alias("symbol_path"),
            _path(name, key).alias("file_path"), F.col(label).alias("name"),
            (_path(up, up_key) if up else F.lit("")).alias("parent_name"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def relations(spark: SparkSession, sf_dir: str, ref=node_ref, repeats: bool = False) -> DataFrame:
    """source_id, target_id, relation_type; lineitem repeats pairs, edges don't unless repeats are asked for."""

    def edges(frame, a, a_key, b, b_key, kind, unique=False):
        out = frame.select(ref(a, a_key).alias("source_id"), ref(b, b_key).alias("target_id"), F.lit(kind).alias("relation_type"))
        return out.distinct() if unique and not repeats else out

    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem")
    parts = (
        edges(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS"),
        edges(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "CONTAINS"),
        edges(t("orders"), "customer", "o_custkey", "orders", "o_orderkey", "CALLS"),
        edges(items, "orders", "l_orderkey", "part", "l_partkey", "USES", True),
        edges(items, "part", "l_partkey", "supplier", "l_suppkey", "IMPORTS", True),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = with_rule(relations(spark, sf_dir))
    return rel.select(
        ids.clean_edge_id("source_id", "relation_type", "target_id", "rule_id").alias("id"),
        F.lit(TENANT).alias("tenant_id"), F.lit(REPO).alias("repo_id"), F.lit(COMMIT).alias("commit_sha"),
        "source_id", "target_id", "relation_type",
        F.struct("extractor_pass", "rule_id", F.array(F.lit(0), F.lit(0)).alias("source_span"), "confidence").alias("provenance"),
    )
