"""Every query of the engine by name, over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, rules, text
from ..operators import containment, evidence as E, govern, importance, listings, paths, query as Q, schema_rules, traverse as T, weights
from ..operators.pagerank import pagerank
from ..sources import dot, kg_json, tables_graph as G
from ..sources.tables_graph import node_ref, table
from ..streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

ID = "t0|tpch|c0|"
NODES = f"""
gn AS (
  SELECT 'Repository' AS entity_kind, 'region/' || r_regionkey AS symbol_path, r_name AS name, '' AS parent_name FROM region
  UNION ALL SELECT 'Module', 'nation/' || n_nationkey, n_name, 'region/' || n_regionkey FROM nation
  UNION ALL SELECT 'File', 'customer/' || c_custkey, c_name, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'Method', 'orders/' || o_orderkey, o_orderpriority, 'customer/' || o_custkey FROM orders
  UNION ALL SELECT 'Class', 'part/' || p_partkey, p_name, '' FROM part
  UNION ALL SELECT 'Interface', 'supplier/' || s_suppkey, s_name, '' FROM supplier),
nodes AS (SELECT '{ID}' || entity_kind || '|' || symbol_path AS id, entity_kind, symbol_path, symbol_path AS file_path, name, parent_name FROM gn)"""
RELATIONS = f"""
rel AS (
  SELECT '{ID}Repository|region/' || n_regionkey AS source_id, '{ID}Module|nation/' || n_nationkey AS target_id, 'CONTAINS' AS relation_type FROM nation
  UNION ALL SELECT '{ID}Module|nation/' || c_nationkey, '{ID}File|customer/' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT '{ID}File|customer/' || o_custkey, '{ID}Method|orders/' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT '{ID}Method|orders/' || l_orderkey, '{ID}Class|part/' || l_partkey, 'USES' FROM lineitem
  UNION ALL SELECT DISTINCT '{ID}Class|part/' || l_partkey, '{ID}Interface|supplier/' || l_suppkey, 'IMPORTS' FROM lineitem)"""
EDGES = RELATIONS + """,
ruled AS (SELECT *, CASE relation_type WHEN 'CALLS' THEN 'calls.function.dispatch' WHEN 'USES' THEN 'uses.type.reference'
    WHEN 'IMPORTS' THEN 'imports.module.symbol' ELSE 'relation.unknown' END AS rule_id FROM rel),
edges AS (SELECT 'edge|' || substr(sha256(replace(source_id, '|', '_') || '|' || relation_type || '|' || replace(target_id, '|', '_') || '|' || rule_id), 1, 24) AS id, * FROM ruled)"""
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from . import extraction  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# --- the envelope -----------------------------------------------------------------------------------------------

NODE_COLUMNS = ["id", "entity_kind", "symbol_path", "file_path", "name", "parent_name"]
EDGE_COLUMNS = ["id", "source_id", "target_id", "relation_type"]


@_query("graph_nodes", f"{GRAPH} SELECT {', '.join(NODE_COLUMNS)} FROM nodes")
def _graph_nodes(spark, d):
    return G.nodes(spark, d).select(*NODE_COLUMNS)


@_query("graph_edges", f"{GRAPH} SELECT {', '.join(EDGE_COLUMNS)}, rule_id FROM edges")
def _graph_edges(spark, d):
    return G.edges(spark, d).select(*EDGE_COLUMNS, "provenance.rule_id")


_SAN = "regexp_replace(regexp_replace(replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), chr(92), '/'), '/+', '/', 'g'), '[^a-zA-Z0-9_./:-]', '_', 'g')"


@_query("node_ids", f"""SELECT p_partkey, {_SAN.format("p_name || '::' || p_type")} AS symbol_path,
  't0|tpch|c0|Class|' || {_SAN.format("p_name || '::' || p_type")} AS id FROM part""")
def _node_ids(spark, d):
    path = ids.sanitize(F.concat("p_name", F.lit("::"), "p_type"))
    return table(spark, d, "part").select("p_partkey", path.alias("symbol_path"), ids.node_id(F.lit("t0"), F.lit("tpch"), F.lit("c0"), F.lit("Class"), path).alias("id"))


@_query("symbol_paths", f"""SELECT url, {_SAN.format("url")} || '::' || CASE WHEN page_id % 2 = 0 THEN 'a.b.' ELSE '' END || 'page' AS path FROM pages""")
def _symbol_paths(spark, d):
    parent = F.when(F.col("page_id") % 2 == 0, "a/b").otherwise("")
    return table(spark, d, "pages").select("url", ids.symbol_path("url", parent, F.lit("page")).alias("path"))


@_query("document_keys", "SELECT p_partkey, substr(sha256(p_name), 1, 48) AS doc_key, md5(p_name) AS content_hash FROM part")
def _document_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.document_key("p_name").alias("doc_key"), ids.content_hash("p_name").alias("content_hash"))


@_query("path_keys", """WITH s AS (SELECT page_id, html, regexp_replace(html, '[^a-zA-Z0-9_-]', '_', 'g') AS plain FROM pages)
  SELECT page_id, CASE WHEN length(plain) > 240 THEN substr(plain, 1, 225) || '_' || substr(md5(html), 1, 8) || '_trunc' ELSE plain END AS path_key FROM s""")
def _path_keys(spark, d):
    return table(spark, d, "pages").select("page_id", ids.path_key("html").alias("path_key"))


@_query("rule_provenance", f"""{GRAPH} SELECT relation_type, rule_id, count(*) AS n,
  max(CASE relation_type WHEN 'CALLS' THEN 0.9 WHEN 'USES' THEN 0.88 WHEN 'IMPORTS' THEN 0.98 ELSE 0.5 END)::double AS confidence FROM edges GROUP BY 1, 2""")
def _rule_provenance(spark, d):
    rel = rules.with_rule(G.relations(spark, d))
    return rel.groupBy("relation_type", "rule_id").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


# --- pages of entities and relations ----------------------------------------------------------------------------


@_query("find_entities_kind", f"{GRAPH} SELECT {', '.join(NODE_COLUMNS)} FROM nodes WHERE entity_kind = 'Interface' ORDER BY id LIMIT 50")
def _find_entities(spark, d):
    return Q.find_entities(G.nodes(spark, d), entity_kind="Interface").select(*NODE_COLUMNS)


@_query("find_entities_file", f"{GRAPH} SELECT {', '.join(NODE_COLUMNS)} FROM nodes WHERE file_path = 'customer/7' ORDER BY id LIMIT 50")
def _find_entities_file(spark, d):
    return Q.find_entities(G.nodes(spark, d), file_path="customer/7").select(*NODE_COLUMNS)


@_query("find_entities_page2", f"{GRAPH} SELECT {', '.join(NODE_COLUMNS)} FROM nodes WHERE entity_kind = 'Class' ORDER BY id LIMIT 20 OFFSET 20")
def _find_entities_page2(spark, d):
    return Q.find_entities(G.nodes(spark, d), entity_kind="Class", cursor=20, limit=20).select(*NODE_COLUMNS)


@_query("find_entities_after", f"{GRAPH} SELECT {', '.join(NODE_COLUMNS)} FROM nodes WHERE entity_kind = 'Class' AND id > '{ID}Class|part/15' ORDER BY id LIMIT 20")
def _find_entities_after(spark, d):
    classes = T.where_all(G.nodes(spark, d), entity_kind="Class")
    return Q.after(classes, "id", f"{ID}Class|part/15", 20).select(*NODE_COLUMNS)


def _relations(name: str, **equal):
    where = " AND ".join(f"{k} = '{v}'" for k, v in equal.items())

    @_query(name, f"{GRAPH} SELECT {', '.join(EDGE_COLUMNS)} FROM edges WHERE {where} ORDER BY source_id, relation_type, target_id, id LIMIT 50")
    def _find(spark, d):
        return Q.find_relations(G.edges(spark, d), **equal).select(*EDGE_COLUMNS)


_relations("find_relations_type", relation_type="CONTAINS")
_relations("find_relations_source", source_id=f"{ID}Class|part/7")
_relations("find_relations_target", target_id=f"{ID}Interface|supplier/3", relation_type="IMPORTS")


@_query("page_envelope", f"{GRAPH} SELECT count(*) AS total, CASE WHEN 70 < count(*) THEN 70 END::bigint AS next_cursor FROM nodes WHERE entity_kind = 'Class'")
def _page_envelope(spark, d):
    return Q.envelope(T.where_all(G.nodes(spark, d), entity_kind="Class"), 20, 50)


@_query("explain_relation", f"{GRAPH} SELECT {', '.join(EDGE_COLUMNS)}, rule_id FROM edges WHERE source_id = '{ID}Repository|region/1' AND target_id = '{ID}Module|nation/1'")
def _explain_relation(spark, d):
    wanted = spark.range(1).select(ids.edge_id(F.lit(f"{ID}Repository|region/1"), F.lit("CONTAINS"), F.lit(f"{ID}Module|nation/1"), F.lit("relation.unknown"))).first()[0]
    return Q.explain_relation(G.edges(spark, d), wanted).select(*EDGE_COLUMNS, "provenance.rule_id")


# --- traversal --------------------------------------------------------------------------------------------------


def _hops(k: int, seed: str, relation: str | None = None) -> str:
    of = f"WHERE relation_type = '{relation}'" if relation else ""
    out = f"{GRAPH}, e AS MATERIALIZED (SELECT * FROM edges {of}), f0 AS MATERIALIZED (SELECT id FROM nodes WHERE {seed})"
    for i in range(1, k + 1):
        out += f""",
e{i} AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN f{i - 1} ON source_id = f{i - 1}.id UNION SELECT e.* FROM e SEMI JOIN f{i - 1} ON target_id = f{i - 1}.id),
f{i} AS MATERIALIZED (SELECT source_id AS id FROM e{i} UNION SELECT target_id FROM e{i})"""
    return out


def _context(name: str, hops: int, seed_sql: str, relation: str | None = None, **seed):
    base = _hops(hops, seed_sql, relation)

    @_query(f"{name}_nodes", f"{base} SELECT {', '.join(NODE_COLUMNS)} FROM nodes WHERE id IN (SELECT id FROM f{hops}) OR id IN (SELECT id FROM f0)")
    def _nodes(spark, d):
        return T.query_context(G.nodes(spark, d), G.edges(spark, d), relation_type=relation, hops=hops, **seed)[0].select(*NODE_COLUMNS)

    @_query(f"{name}_edges", f"{base} SELECT {', '.join(EDGE_COLUMNS)} FROM e{hops}")
    def _edges(spark, d):
        return T.query_context(G.nodes(spark, d), G.edges(spark, d), relation_type=relation, hops=hops, **seed)[1].select(*EDGE_COLUMNS)


_context("context_hop1", 1, "file_path = 'supplier/3'", file_path="supplier/3")
_context("context_hop2", 2, "file_path = 'customer/7'", file_path="customer/7")
_context("context_hop3", 3, "file_path = 'customer/7'", file_path="customer/7")
_context("context_filtered", 2, "entity_kind = 'Repository'", relation="CONTAINS", symbol_type="Repository")


@_query("context_page", f"""{_hops(2, "file_path = 'customer/7'")} SELECT {', '.join(NODE_COLUMNS)} FROM nodes
  WHERE id IN (SELECT id FROM f2) OR id IN (SELECT id FROM f0) ORDER BY id LIMIT 10 OFFSET 5""")
def _context_page(spark, d):
    return Q.subgraph(G.nodes(spark, d), G.edges(spark, d), cursor=5, limit=10, file_path="customer/7", hops=2)["nodes"].select(*NODE_COLUMNS)


@_query("impacted_files", f"""WITH RECURSIVE {RELATIONS}, pairs AS (SELECT DISTINCT split_part(target_id, '|', 5) AS a, split_part(source_id, '|', 5) AS b FROM rel),
  hit AS (SELECT 'supplier/3' AS file_path UNION SELECT b FROM pairs JOIN hit ON a = file_path) SELECT file_path FROM hit""")
def _impacted_files(spark, d):
    return T.impacted_files(G.nodes(spark, d), G.edges(spark, d), spark.createDataFrame([("supplier/3",)], "file_path string"))


@_query("impacted_fallback_all", f"{GRAPH} SELECT file_path FROM nodes UNION SELECT 'no/such/file'")
def _impacted_all(spark, d):
    return T.impacted_files(G.nodes(spark, d), G.edges(spark, d), spark.createDataFrame([("no/such/file",)], "file_path string"))


@_query("containment_1_3", f"""{GRAPH}, walk AS (SELECT target_id AS entity, id AS edge_id, 1 AS hop, source_id || '>' || target_id AS path FROM edges
    WHERE relation_type = 'CONTAINS' AND source_id = '{ID}Repository|region/2'
  UNION ALL SELECT e.target_id, e.id, hop + 1, path || '>' || e.target_id FROM walk JOIN edges e ON e.source_id = entity
    WHERE relation_type = 'CONTAINS' AND hop < 3) SELECT entity, edge_id, hop, path FROM walk""")
def _containment(spark, d):
    root = spark.createDataFrame([(f"{ID}Repository|region/2",)], "id string")
    return T.containment(G.edges(spark, d), root).withColumn("path", F.array_join("path", ">"))


@_query("dependency_impact", f"""{GRAPH}, walk AS (SELECT '{ID}Class|part/7' AS id, 0 AS hop UNION
  SELECT target_id, hop + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE relation_type = 'IMPORTS')
  SELECT id, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY id""")
def _dependency_impact(spark, d):
    return schema_rules.dependency_impact(G.edges(spark, d), spark.createDataFrame([(f"{ID}Class|part/7",)], "id string"), "IMPORTS")


@_query("pr_impact", f"""{GRAPH}, scored AS (SELECT *, CASE relation_type WHEN 'CONTAINS' THEN 0.5 WHEN 'CALLS' THEN 0.9 ELSE 0.88 END::double AS w FROM edges),
  walk AS (SELECT target_id AS entity, 1 AS hop, w AS score FROM scored WHERE source_id = '{ID}Module|nation/3' AND w > 0.3
  UNION ALL SELECT e.target_id, hop + 1, score * w FROM walk JOIN scored e ON e.source_id = entity WHERE hop < 3 AND score * w > 0.3)
  SELECT entity, round(max(score), 9) AS best_score, count(DISTINCT hop) AS n_hops FROM walk GROUP BY entity""")
def _pr_impact(spark, d):
    kind = F.col("relation_type")
    score = F.when(kind == "CONTAINS", F.lit(0.5)).when(kind == "CALLS", F.lit(0.9)).otherwise(F.lit(0.88))
    out = schema_rules.change_impact(G.edges(spark, d), spark.createDataFrame([(f"{ID}Module|nation/3",)], "id string"), score)
    return out.select("entity", F.round("best_score", 9).alias("best_score"), F.size("hops").cast("long").alias("n_hops"))


# --- scores, weights, paths -------------------------------------------------------------------------------------


def _pagerank_sql(rounds: int = 9) -> str:
    out = f"""{GRAPH}, deg AS (SELECT source_id, count(*) AS d FROM edges GROUP BY 1), r0 AS (SELECT id, 1.0::double / count(*) OVER () AS s FROM nodes)"""
    for i in range(1, rounds + 1):
        out += f""", r{i} AS (SELECT n.id, 0.15::double + 0.85::double * coalesce(g.s, 0) AS s FROM nodes n LEFT JOIN
  (SELECT e.target_id, sum(r.s / d.d) AS s FROM edges e JOIN deg d USING (source_id) JOIN r{i - 1} r ON r.id = e.source_id GROUP BY 1) g ON g.target_id = n.id)"""
    return out + f" SELECT id, round(s / sum(s) OVER (), 12) AS page_rank_score FROM r{rounds}"


@_query("pagerank", _pagerank_sql())
def _pagerank(spark, d):
    ranks = pagerank(G.nodes(spark, d), G.relations(spark, d))
    return ranks.select("id", F.round("page_rank_score", 12).alias("page_rank_score"))


def _typed_edges(spark, d) -> DataFrame:
    """calls: customer to order; instantiates: order to part, repeated; references: part to supplier; has_method."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")

    def edges(df, a, ak, b, bk, kind):
        return df.select(node_ref(a, ak).alias("source_id"), node_ref(b, bk).alias("target_id"), F.lit(kind).alias("relation_type"))

    return (
        edges(orders, "customer", "o_custkey", "orders", "o_orderkey", "calls")
        .unionByName(edges(items, "orders", "l_orderkey", "part", "l_partkey", "instantiates"))
        .unionByName(edges(items, "supplier", "l_suppkey", "part", "l_partkey", "references"))
        .unionByName(edges(items.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "has_method"))
    )


@_query("weights_function", f"""WITH c AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1)
  SELECT '{ID}File|customer/' || c_custkey AS id, c_nationkey + 1 AS code_line_count, 0 AS callee_count, coalesce(n, 0)::int AS caller_count, false AS self_recursive_func, 0 AS instantiated_by_function FROM customer LEFT JOIN c ON k = c_custkey
  UNION ALL SELECT '{ID}Method|orders/' || o_orderkey, o_orderkey % 100 + 1, 1, 0, false, coalesce(n, 0)::int FROM orders LEFT JOIN (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1) ON k = o_orderkey""")
def _weights_function(spark, d):
    a = table(spark, d, "customer").select(node_ref("customer", "c_custkey").alias("id"), F.lit(0).cast("long").alias("line"), F.col("c_nationkey").cast("long").alias("line_end"))
    b = table(spark, d, "orders").select(node_ref("orders", "o_orderkey").alias("id"), F.lit(0).cast("long").alias("line"), (F.col("o_orderkey") % 100).alias("line_end"))
    return weights.function_weights(a.unionByName(b), _typed_edges(spark, d))


@_query("weights_struct", f"""SELECT '{ID}Class|part/' || p_partkey AS id, p_size AS code_line_count, p_size % 5 AS field_count,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey)::int AS method_count,
  (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey)::int AS reference_count,
  (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey)::int AS total_instance_count FROM part""")
def _weights_struct(spark, d):
    fields = F.slice(F.array(*(F.lit(c) for c in "abcd")), F.lit(1), F.col("p_size") % 5)
    nodes = table(spark, d, "part").select(node_ref("part", "p_partkey").alias("id"), F.lit(1).alias("line"), F.col("p_size").alias("line_end"), fields.alias("fields"))
    return weights.struct_weights(nodes, _typed_edges(spark, d))


@_query("weights_interface", f"""SELECT '{ID}Interface|supplier/' || s_suppkey AS id, (s_suppkey % 4)::int AS method_count, 0 AS reference_count FROM supplier""")
def _weights_interface(spark, d):
    methods = F.slice(F.array(*(F.lit(c) for c in "abcd")), F.lit(1), (F.col("s_suppkey") % 4).cast("int"))
    nodes = table(spark, d, "supplier").select(node_ref("supplier", "s_suppkey").alias("id"), methods.alias("methods"))
    return weights.interface_weights(nodes, _typed_edges(spark, d))


@_query("weights_file", """WITH m AS (SELECT 'nation/' || c_nationkey p, 1 f, 0 s FROM customer UNION ALL SELECT 'nation/' || s_nationkey, 0, 1 FROM supplier)
  SELECT n_nationkey AS id, n_nationkey % 3 + 1 AS code_line_count, coalesce(sum(s), 0)::int AS struct_count, coalesce(sum(f), 0)::int AS function_count, 0 AS interface_count
  FROM nation LEFT JOIN m ON p = 'nation/' || n_nationkey GROUP BY 1, 2""")
def _weights_file(spark, d):
    member = lambda name, key, kind: table(spark, d, name).select(F.lit(kind).alias("type"), F.concat(F.lit("nation/"), F.col(key)).alias("file_path"))
    files = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("nation/"), "n_nationkey").alias("file_path"), F.repeat(F.lit("x\n"), F.col("n_nationkey") % 3).alias("content")
    )
    return weights.file_weights(files, member("customer", "c_nationkey", "function").unionByName(member("supplier", "s_nationkey", "struct")))


@_query("weights_package", """WITH p AS (SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS name, '/g/' || r_regionkey AS path FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, '/g/' || n_regionkey || '/' || n_nationkey FROM nation)
  SELECT id, (SELECT count(*) FROM supplier WHERE 'n' || s_nationkey = name)::int AS struct_count, (SELECT count(*) FROM customer WHERE 'n' || c_nationkey = name)::int AS function_count,
  0 AS interface_count, 0 AS go_files_count, 0 AS code_line_count, 0 AS import_count,
  (SELECT count(*) FROM p q WHERE starts_with(q.path, p.path) AND q.path <> p.path)::int AS subpackage_count FROM p""")
def _weights_package(spark, d):
    package = lambda name, key, letter, path: table(spark, d, name).select(
        F.concat(F.lit(letter), F.col(key)).alias("id"), F.concat(F.lit(letter), F.col(key)).alias("package_name"), path.alias("file_path"))
    packages = package("region", "r_regionkey", "r", F.concat(F.lit("/g/"), "r_regionkey")).unionByName(
        package("nation", "n_nationkey", "n", F.concat(F.lit("/g/"), "n_regionkey", F.lit("/"), "n_nationkey")))
    member = lambda name, key, kind: table(spark, d, name).select(F.lit(kind).alias("type"), F.concat(F.lit("n"), F.col(key)).alias("package_name"))
    members = member("customer", "c_nationkey", "function").unionByName(member("supplier", "s_nationkey", "struct"))
    files = spark.createDataFrame([], "file_path string, content string")
    return weights.package_weights(packages, members, files, _typed_edges(spark, d))


@_query("top20_pct", "SELECT p_partkey AS id, p_retailprice AS score FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= greatest(1, floor((SELECT count(*) FROM part) * 0.2))")
def _top20(spark, d):
    return importance.top_share(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), "score")


@_query("top20_pct_by_brand", """SELECT p_brand, p_partkey AS id, p_retailprice AS score FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= greatest(1, floor(count(*) OVER (PARTITION BY p_brand) * 0.2))""")
def _top20_by(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return importance.top_share(rows, "score", by=["p_brand"])


@_query("important_nodes", "SELECT p_partkey AS id, p_type AS type, p_size AS importance FROM part WHERE p_size >= 40")
def _important(spark, d):
    return importance.important_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_size").alias("importance")), 40.7)


_CALLS = "calls AS (SELECT DISTINCT source_id AS s, target_id AS t FROM rel WHERE relation_type <> 'CONTAINS')"
_PATHS = f"""WITH {RELATIONS}, {_CALLS},
  p3 AS (SELECT a.s AS n1, a.t AS n2, b.t AS n3 FROM calls a JOIN calls b ON b.s = a.t WHERE a.s NOT IN (SELECT t FROM calls)),
  p4 AS (SELECT p3.*, c.t AS n4 FROM p3 JOIN calls c ON c.s = n3),
  lp AS (SELECT n1 || '>' || n2 || '>' || n3 AS path, 3 AS length, n1, n2, n3, NULL AS n4 FROM p3 UNION ALL SELECT n1 || '>' || n2 || '>' || n3 || '>' || n4, 4, n1, n2, n3, n4 FROM p4),
  top AS (SELECT *, row_number() OVER (ORDER BY length DESC, n1, n2, n3, n4) AS i FROM lp QUALIFY i <=
    least(10000, CASE WHEN (SELECT count(*) FROM lp) > 25 THEN (SELECT count(*) FROM lp) // 5 ELSE (SELECT count(*) FROM lp) END))"""


def _calls_of(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls between node codes, the entries and the sinks."""
    calls = G.relations(spark, d, G.node_code, repeats=True).where("relation_type <> 'CONTAINS'")
    ends = paths.ends(calls)
    return calls, ends.where("calls").select("id"), ends.where("not calls").select("id")


def _named(path: str) -> F.Column:
    """A path of codes as joined node ids."""
    return F.concat_ws(">", *(G.node_name(F.get(path, F.lit(i))) for i in range(paths.LONGEST))).alias(path)


def _shown(found: DataFrame) -> DataFrame:
    return found.select(_named("path"), "length")


@_query("long_paths", f"{_PATHS} SELECT path, length FROM lp")
def _long_paths(spark, d):
    calls, entries, sinks = _calls_of(spark, d)
    return _shown(paths.long_paths(calls, entries, sinks=sinks))


@_query("longest_paths", f"{_PATHS} SELECT path, length FROM top")
def _longest_paths(spark, d):
    return _shown(paths.longest_paths(*_calls_of(spark, d), G.node_name))


@_query("common_subpaths", f"""{_PATHS},
  c AS (SELECT concat_ws('>', CASE WHEN a.n1 = b.n1 THEN a.n1 END, CASE WHEN a.n2 = b.n2 THEN a.n2 END, CASE WHEN a.n3 = b.n3 THEN a.n3 END, CASE WHEN a.n4 = b.n4 THEN a.n4 END) AS common_path
    FROM lp a JOIN lp b ON a.path > b.path AND a.n3 = b.n3 AND (a.n1 = b.n1)::int + (a.n2 = b.n2)::int + coalesce((a.n4 = b.n4)::int, 0) >= 2
    UNION ALL SELECT concat_ws('>', a.n1, a.n2, a.n4) FROM lp a JOIN lp b ON a.path > b.path AND a.n4 = b.n4 AND a.n1 = b.n1 AND a.n2 = b.n2 AND a.n3 <> b.n3)
  SELECT common_path, count(*) AS n FROM c GROUP BY 1""")
def _common_subpaths(spark, d):
    out = paths.all_common_subpaths(*_calls_of(spark, d))
    return out.select(_named("common_path"), F.col("count").alias("n"))


@_query("core_functions", "SELECT p_partkey AS id FROM part WHERE NOT (p_size % 3 = 0 OR p_size % 5 = 0) AND p_size % 2 = 0")
def _core_functions(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("p_size") % 3 == 0, "Utility"), F.when(F.col("p_size") % 5 == 0, "testing"), F.lit("core")))
    functions = table(spark, d, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"), (F.col("p_size") % 2).alias("callee_count"))
    empty = spark.createDataFrame([], "source_id long, target_id long, relation_type string")
    return paths.core_call_graph(functions, empty)[1]


# --- relations --------------------------------------------------------------------------------------------------

_FACTS = """WITH f AS (SELECT l_orderkey, l_partkey % 50 AS source_key, l_suppkey % 20 AS target_key,
  CASE l_linenumber % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'INSTANTIATES' ELSE 'USES' END AS relation_type,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Class' ELSE 'Method' END AS target_kind, l_linenumber AS phase,
  l_orderkey * 10000 + l_partkey AS seq, l_quantity AS q, l_extendedprice AS x FROM lineitem)"""


def _facts(spark, d) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "CALLS").when(F.col("l_linenumber") % 3 == 1, "INSTANTIATES").otherwise("USES")
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 50).alias("source_key"), (F.col("l_suppkey") % 20).alias("target_key"), kind.alias("relation_type"),
        F.when(F.col("l_suppkey") % 2 == 0, "Class").otherwise("Method").alias("target_kind"), F.col("l_linenumber").alias("phase"),
        (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("seq"),
    )


@_query("dedup_best_rule", f"""{_FACTS} SELECT source_key, target_key, relation_type, min(phase * 1000000000000 + seq) AS first_seq FROM f GROUP BY 1, 2, 3""")
def _dedup_best_rule(spark, d):
    keys = ["source_key", "target_key", "relation_type"]
    ruled = rules.with_rule(_facts(spark, d))
    return rules.best_rule(ruled, keys, ["phase", "seq"]).select(*keys, (F.col("phase").cast("long") * 1000000000000 + F.col("seq")).alias("first_seq"))


@_query("dedup_pair_first", f"""{_FACTS}, k AS (SELECT *, first_value(relation_type) OVER (PARTITION BY source_key, target_key ORDER BY phase, seq, relation_type) AS head FROM f)
  SELECT source_key, target_key, relation_type FROM k QUALIFY row_number() OVER (PARTITION BY source_key, target_key
  ORDER BY CASE WHEN head = 'CALLS' AND relation_type = 'INSTANTIATES' AND target_kind = 'Class' THEN 0 ELSE 1 END, phase, seq) = 1""")
def _dedup_pair_first(spark, d):
    return rules.one_per_pair(_facts(spark, d)).select("source_key", "target_key", "relation_type")


@_query("valid_relations", "SELECT l_partkey AS s, l_suppkey AS t, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def _valid_relations(spark, d):
    rel = table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("t"))
    known_s = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("s"))
    known_t = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("t"))
    return rel.where("s <> t").join(known_s, "s", "left_semi").join(known_t, "t", "left_semi").groupBy("s", "t").agg(F.count("*").alias("n"))


# --- evidence, jobs, governance over events ---------------------------------------------------------------------


def _cases(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("case_id"), (F.col("user_id") % 10 / 10.0).alias("precision"), (F.col("user_id") % 7 / 7.0).alias("recall"),
        (F.col("user_id") % 3).cast("int").alias("false_positive_count"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cost_usd"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "timeout").otherwise("").alias("failure_type"),
    )


@_query("evidence_report", """SELECT count(*) AS total_cases, round(avg((user_id % 10) / 10.0), 9) AS precision, round(avg((user_id % 7) / 7.0), 9) AS recall,
  round(avg(user_id % 3), 9) AS mean_false_positives, round(avg(value / 1000), 9) AS mean_cost_usd,
  list_sort(list(value))[greatest(1, floor(count(*) * 0.95::double))::int] AS p95_latency_ms,
  count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS timeouts FROM events""")
def _evidence_report(spark, d):
    r = E.report(_cases(spark, d), "2026-01")
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "mean_false_positives", "mean_cost_usd")]
    return r.select("total_cases", *rounded, "p95_latency_ms", F.col("failure_taxonomy")["error"].alias("errors"), F.col("failure_taxonomy")["timeout"].alias("timeouts"))


@_query("evidence_p95", "SELECT event_type, list_sort(list(value))[greatest(1, floor(count(*) * 0.95::double))::int] AS p95 FROM events GROUP BY 1")
def _evidence_p95(spark, d):
    return E.rank_percentiles(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.col("value").alias("p95"))


@_query("failure_taxonomy", "SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'timeout' END AS failure_type, count(*) AS cases FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def _failure_taxonomy(spark, d):
    return E.failure_taxonomy(_cases(spark, d))


@_query("delivery_dedup", "SELECT DISTINCT user_id AS tenant_id, event_type || '-' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS delivery_id FROM events")
def _delivery_dedup(spark, d):
    key = F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMddHH"))
    return table(spark, d, "events").select(F.col("user_id").alias("tenant_id"), key.alias("delivery_id")).dropDuplicates(["tenant_id", "delivery_id"])


@_query("job_latest_status", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, arg_min(value, event_id) AS created_at FROM events GROUP BY 1")
def _job_latest(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"), F.col("value").alias("created_at"))
    return E.latest(log, ["job_id"], "seq")


@_query("audit_by_tenant", "SELECT event_id, event_type AS action FROM events WHERE user_id = 7 ORDER BY event_id")
def _audit(spark, d):
    return table(spark, d, "events").where("user_id = 7").select("event_id", F.col("event_type").alias("action")).orderBy("event_id")


@_query("quota_repos", "SELECT user_id AS tenant_id, count(DISTINCT event_type) AS repos, count(DISTINCT event_type) <= CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 4 + 1 END AS allowed FROM events GROUP BY 1")
def _quota_repos(spark, d):
    events = table(spark, d, "events")
    policies = events.select(F.col("user_id").alias("tenant_id")).distinct().where("tenant_id % 4 <> 0").withColumn("max_repos", F.col("tenant_id") % 4 + 1)
    return govern.repo_usage(events.select(F.col("user_id").alias("tenant_id"), F.col("event_type").alias("repo_id")), policies)


@_query("quota_slots", """WITH s AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS delta FROM events),
  t AS (SELECT *, sum(delta) OVER w AS total FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, (total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id)))::bigint AS slots FROM t""")
def _quota_slots(spark, d):
    delta = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)
    events = table(spark, d, "events").select("event_id", "user_id", delta.alias("delta"))
    return E.running_slots(events, "user_id", "event_id", "delta").select("event_id", "slots")


@_query("rbac_check", """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'invalid_key' WHEN user_id % 3 <> event_id % 3 THEN 'tenant_denied'
  WHEN event_type NOT IN ('view', 'click') THEN 'role_denied' ELSE 'ok' END AS verdict FROM events""")
def _rbac(spark, d):
    events = table(spark, d, "events")
    principals = events.select("user_id").distinct().where("user_id % 5 <> 0").select(
        F.col("user_id").alias("api_key"), F.col("user_id").alias("principal_id"), F.array((F.col("user_id") % 3)).alias("tenant_ids"), F.array(F.lit("view"), F.lit("click")).alias("roles"))
    requests = events.select("event_id", F.col("user_id").alias("api_key"), (F.col("event_id") % 3).alias("tenant_id"), F.col("event_type").alias("role"))
    return govern.verdicts(requests, principals).select("event_id", "verdict")


# --- texts ------------------------------------------------------------------------------------------------------


@_query("file_entities", """SELECT doc_id, length(text) AS size, len(string_split(text, chr(10))) AS lines, md5(text) AS content_hash,
  'documents/' || source || '/' || doc_id AS path, CASE WHEN contains(lower(source || text), 'test') THEN 'test' WHEN contains(lower(source || text), 'doc') THEN 'documentation'
  WHEN contains(lower(source || text), 'config') THEN 'config' ELSE 'source' END AS module_type, (length(text) // 4)::int AS tokens FROM documents""")
def _file_entities(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.length("text").cast("long").alias("size"), text.line_count("text").cast("long").alias("lines"), ids.content_hash("text").alias("content_hash"),
        F.concat_ws("/", F.lit("documents"), "source", "doc_id").alias("path"), text.module_type(F.concat("source", "text")).alias("module_type"), text.token_estimate("text").alias("tokens"),
    )


@_query("content_duplicates", "SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _content_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(ids.content_hash("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query("normalize_datetime", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def _normalize_datetime(spark, d):
    return table(spark, d, "events").select("event_id", text.utc_datetime(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso"))


@_query("line_endings", "SELECT page_id, md5(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS h FROM (SELECT page_id, regexp_replace(replace(html, '<p>', chr(13) || chr(10)), chr(13) || chr(10) || '?', chr(10), 'g') AS t FROM pages)")
def _line_endings(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.normalized_source(F.replace("html", F.lit("<p>"), F.lit("\r\n")))).alias("h"))


@_query("path_distance", """SELECT page_id, list_sum(list_transform(list_zip(string_split('a/b/c/d', '/'), string_split('a/' || (page_id % 3) || '/c/x/y', '/')[1:4]), lambda z: (z[1] <> z[2])::int))::int AS distance FROM pages""")
def _path_distance(spark, d):
    other = F.concat(F.lit("a/"), F.col("page_id") % 3, F.lit("/c/x/y"))
    return table(spark, d, "pages").select("page_id", text.path_distance(F.lit("a/b/c/d"), other).alias("distance"))


@_query("dot_ids", "SELECT p_partkey, regexp_replace(replace(replace(replace(p_name || ' *[x]-' || p_type, '*', 'ptr_'), '[', 'arr_'), ']', ''), '[. /:-]', '_', 'g') AS dot_id FROM part")
def _dot_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", text.dot_id(F.concat("p_name", F.lit(" *[x]-"), "p_type")).alias("dot_id"))


@_query("semantic_code_search", "SELECT doc_id, source FROM documents WHERE contains(text, 'License')")
def _code_search(spark, d):
    return schema_rules.code_search(table(spark, d, "documents"), "License", "text").select("doc_id", "source")


@_query("complexity_flag", "SELECT p_partkey, p_size FROM part WHERE p_size > 15 OR p_partkey % 30 > 20")
def _complexity(spark, d):
    part = table(spark, d, "part").withColumns({"cyclomatic": F.col("p_size"), "cognitive": F.col("p_partkey") % 30})
    return schema_rules.complexity_flags(part).select("p_partkey", "p_size")


@_query("coverage_check", "SELECT p_partkey AS id, count(l_partkey) AS tests, count(l_partkey) > 0 AS covered FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey GROUP BY 1")
def _coverage(spark, d):
    edges = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("target_id"), F.lit("VERIFIES").alias("relation_type"))
    return schema_rules.coverage(table(spark, d, "part").select(F.col("p_partkey").alias("id")), edges)


@_query("constraint_violations", """SELECT * FROM (SELECT 'unique' AS rule, 'l_orderkey,l_linenumber' AS detail, count(*) AS rows FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'range', 'l_quantity', count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 5 AND 50 UNION ALL SELECT 'required', 'l_shipdate', count(*) FROM lineitem WHERE l_shipdate IS NULL) WHERE rows > 0""")
def _constraints(spark, d):
    return schema_rules.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], {"l_quantity": (5, 50)})


@_query("cardinality_check", "SELECT o_custkey AS source_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _cardinality(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.lit("CALLS").alias("relation_type"))
    return schema_rules.cardinality(edges, "CALLS", 15)


# --- the typed graph: nations as packages, customers as functions, suppliers as structs, parts as interfaces ------


def _typed_nodes(spark, d) -> DataFrame:
    def typed(df, kind, node, weight=None, **data):
        fields = {"package_name": F.lit(None), **data}
        struct = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
        return df.select(
            node.alias("id"), F.lit(kind).alias("type"), F.from_json(struct, kg_json.DATA.split(" ", 1)[1]).alias("data"),
            F.from_json(F.to_json(F.struct(*(v.alias(k) for k, v in (weight or {}).items()))) if weight else F.lit(None).cast("string"), kg_json.WEIGHTS.split(" ", 1)[1]).alias("weights"))

    t = lambda name: table(spark, d, name)
    nation = lambda key: F.concat(F.lit("n"), F.col(key))
    place = F.struct(F.concat(F.lit("/g/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("file_path"))
    region = F.struct(F.concat(F.lit("/g/r"), "r_regionkey").alias("file_path"))
    return (
        typed(t("region"), "package", F.concat(F.lit("package:r"), "r_regionkey"), package_name=F.concat(F.lit("r"), "r_regionkey"), location=region)
        .unionByName(typed(t("nation"), "package", F.concat(F.lit("package:n"), "n_nationkey"), {"function_count": F.col("n_nationkey")}, package_name=nation("n_nationkey"), location=place))
        .unionByName(typed(t("customer"), "function", F.concat(F.lit("function:"), "c_custkey"), {"importance": F.col("c_custkey") % 100, "callee_count": F.col("c_custkey") % 7},
                           package_name=nation("c_nationkey"), function_name=F.col("c_name"), params=F.col("c_mktsegment")))
        .unionByName(typed(t("supplier"), "struct", F.concat(F.lit("struct:"), "s_suppkey"), package_name=nation("s_nationkey"), struct_name=F.col("s_name"), is_generic=F.col("s_suppkey") % 2 == 0))
    )


@_query("list_packages", """SELECT 'package:r' || r_regionkey AS id, 'r' || r_regionkey AS package_name, 0 AS function_count FROM region
  UNION ALL SELECT 'package:n' || n_nationkey, 'n' || n_nationkey, n_nationkey FROM nation""")
def _list_packages(spark, d):
    return listings.list_packages(_typed_nodes(spark, d)).select("id", "package_name", "function_count")


@_query("list_package_functions", """SELECT 'function:' || c_custkey AS id, rtrim(c_name || '(' || c_mktsegment || ') ') AS signature, (c_custkey % 100)::int AS importance,
  (c_custkey % 7)::int AS callee_count, 0 AS caller_count, count(*) OVER () AS total FROM customer WHERE c_nationkey = 3""")
def _list_package_functions(spark, d):
    return listings.list_package_functions(_typed_nodes(spark, d), "package:n3").drop("location")


@_query("list_package_structs", "SELECT 'struct:' || s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS is_generic, count(*) OVER () AS total FROM supplier WHERE s_nationkey = 3")
def _list_package_structs(spark, d):
    return listings.list_package_structs(_typed_nodes(spark, d), "n3").select("id", "name", "is_generic", "total")


@_query("list_subpackages", "SELECT 'package:n' || n_nationkey AS id, 'n' || n_nationkey AS package_name FROM nation WHERE n_regionkey = 2")
def _list_subpackages(spark, d):
    return listings.list_subpackages(_typed_nodes(spark, d), "package:r2").select("id", "package_name")


@_query("typed_important_nodes", "SELECT 'function:' || c_custkey AS id, 'function' AS type, (c_custkey % 100)::int AS importance FROM customer WHERE c_custkey % 100 >= 90")
def _typed_important(spark, d):
    return importance.important_nodes(_typed_nodes(spark, d).select("id", "type", "weights.importance"), 90.5)


@_query("call_listing", f"""SELECT '{ID}File|customer/' || o_custkey AS caller, '{ID}Method|orders/' || o_orderkey AS callee, 'calls' AS relation FROM orders
  UNION ALL SELECT DISTINCT '{ID}Method|orders/' || l_orderkey, '{ID}Class|part/' || l_partkey, 'instantiates' FROM lineitem""")
def _call_listing(spark, d):
    return listings.call_listing(_typed_edges(spark, d))


@_query("staged_members", "SELECT 'struct:' || s_suppkey AS owner, 'function:' || c_custkey AS id FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def _staged_members(spark, d):
    # every customer meets all suppliers of its nation: customers are dealt out, as few bytes of them are much work
    dealt = table(spark, d, "customer").select("c_custkey", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    own = dealt.join(F.broadcast(table(spark, d, "supplier")), F.col("s_nationkey") == F.col("c_nationkey"))
    edges = own.select(F.concat(F.lit("struct:"), "s_suppkey").alias("source_id"), F.concat(F.lit("function:"), "c_custkey").alias("target_id"), F.lit("has_method").alias("relation_type"))
    return importance.members(_typed_nodes(spark, d).select("id", "type"), edges, ("has_method",), ("function",)).select("owner", "id")


@_query("resolved_calls", f"""WITH f AS (SELECT DISTINCT o_custkey c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 40 END fn, o_orderkey % 9 it FROM orders),
  j AS (SELECT c, coalesce('f' || a.s_suppkey, 'i' || b.s_suppkey) AS target_id, CASE WHEN a.s_suppkey IS NOT NULL THEN 'function' ELSE 'interface_function' END AS target_type
    FROM f LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) a ON fn = a.s_suppkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 1) b ON it = b.s_suppkey)
  SELECT DISTINCT 'c' || c AS source_id, target_type, target_id, 'calls' AS relation_type FROM j WHERE target_id IS NOT NULL""")
def _resolved_calls(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    nodes = table(spark, d, "supplier").select(F.concat(F.when(even, "f").otherwise("i"), F.col("s_suppkey")).alias("id"), F.when(even, "function").otherwise("interface_func").alias("type"))
    facts = table(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("caller_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("f"), F.col("o_custkey") % 40)).alias("function_id"),
        F.concat(F.lit("i"), F.col("o_orderkey") % 9).alias("interface_id"), F.lit("calls").alias("relation_type"))
    return listings.resolve_calls(facts, nodes)


@_query("dot_parts", "SELECT n_regionkey, 0 AS part, string_agg('<f' || k || '> ' || n_name, '|' ORDER BY k) AS label FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) GROUP BY 1")
def _dot_parts(spark, d):
    return dot.parts(table(spark, d, "nation"), ["n_regionkey"], "n_name", F.col("n_name"))


@_query("containment_upsert", "SELECT user_id AS key, arg_max(event_type, event_id) AS v, max(event_id) AS seq FROM events GROUP BY 1")
def _upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"))
    return containment.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["key"])


@_query("job_transitions", """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'COMPLETED' WHEN event_id % 5 + 1 < 3 THEN 'RETRYING' ELSE 'FAILED' END AS status, (event_id % 5 + 1)::bigint AS attempts,
  CASE WHEN event_type = 'error' AND event_id % 5 + 1 < 3 THEN least(2 ** (event_id % 5 + 1), 8)::int END AS wait_seconds FROM events""")
def _job_transitions(spark, d):
    log = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 5).alias("attempts"), F.lit(3).alias("max_retries"))
    return ingest.after_attempt(log, F.col("event_type") == "error").select("event_id", "status", "attempts", "wait_seconds")
