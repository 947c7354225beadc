import pytest
from pyspark.sql import functions as F

from weftgraph.operators import containment, evidence, importance, listings, paths, query, schema_rules, traverse, weights
from weftgraph.operators.pagerank import pagerank
from weftgraph.sources import dot, kg_json


def graph(spark, pairs, kind="CALLS"):
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(n, n + ".py", "File") for n in names], "id string, file_path string, entity_kind string")
    edges = spark.createDataFrame([(f"e{i}", a, b, kind) for i, (a, b) in enumerate(pairs)], "id string, source_id string, target_id string, relation_type string")
    return nodes, edges


CYCLE = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")]


def test_context_of_a_cycle(spark):
    nodes, edges = graph(spark, CYCLE)
    found, touched = traverse.query_context(nodes, edges, file_path="A.py", hops=1)
    assert {r.id for r in found.collect()} == {"A", "B", "C"}
    assert {(r.source_id, r.target_id) for r in touched.collect()} == {("A", "B"), ("C", "A")}
    assert traverse.query_context(nodes, edges, file_path="A.py", hops=0)[0].count() == 3
    assert traverse.query_context(nodes, edges, file_path="A.py", hops=9)[1].count() == 4


@pytest.mark.parametrize("changed, hit", [("B", "ABC"), ("A", "ABC"), ("D", "ABCD"), ("Z", "ABCDZ")])
def test_impact(spark, changed, hit):
    nodes, edges = graph(spark, CYCLE)
    start = spark.createDataFrame([(changed + ".py",)], "file_path string")
    assert {r[0] for r in traverse.impacted_files(nodes, edges, start).collect()} == {x + ".py" for x in hit}
    assert traverse.impacted_files(nodes, edges, start.limit(0)).count() == 0


def test_pagerank_sums_to_one(spark):
    nodes, edges = graph(spark, CYCLE)
    ranks = {r.id: r.page_rank_score for r in pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["A"] < ranks["B"]
    assert pagerank(nodes.limit(0), edges.limit(0)).count() == 0


def test_paths(spark):
    _, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("c", "a")])
    found = paths.long_paths(edges, spark.createDataFrame([("a",)], "id string"))
    assert sorted("".join(r.path) for r in found.collect()) == ["abc", "abcd", "abcde"]
    shared = {"".join(r.common_path): r["count"] for r in paths.common_subpaths(found).collect()}
    assert shared == {"abc": 1, "abcd": 1}


def test_pages_join_up(spark):
    nodes, _ = graph(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)])
    got = [r.id for c in range(0, 30, 7) for r in query.page(nodes, ("id",), c, 7).collect()]
    assert got == sorted(got) and len(got) == 21
    assert tuple(query.envelope(nodes, 14, 7).first()) == (21, None) and query.envelope(nodes, 7, 7).first().next_cursor == 14
    with pytest.raises(ValueError):
        query.page(nodes, ("id",), -1)


def test_rank_percentiles(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 20), ("d", 100)) for v in range(1, n + 1)]
    rows += [("e", 5.0)] * 50 + [("e", 9.0)] + [("f", None), (None, 3.0), ("g", float("nan")), ("g", 1.0), ("g", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.v for r in evidence.rank_percentiles(df, ["g"], "v").collect()}
    assert got == {"a": 1, "b": 1, "c": 19, "d": 95, "e": 5.0, None: 3.0, "g": 2.0}


def test_report(spark):
    cases = spark.createDataFrame([("b", 1.0, 0.5, 1, 120.0, 0.1, ""), ("a", 0.5, 0.5, 0, 150.0, 0.2, "timeout")],
                                  "case_id string, precision double, recall double, false_positive_count int, latency_ms double, cost_usd double, failure_type string")
    head = evidence.report(cases, "2026-03")
    r = head.first()
    assert (r.total_cases, r.precision, r.p95_latency_ms, r.failure_taxonomy) == (2, 0.75, 120.0, {"timeout": 1})
    assert '"month":"2026-03"' in evidence.report_json(head).first()[0]
    assert evidence.report_markdown(head, cases).index("- a:") < evidence.report_markdown(head, cases).index("- b:")
    with pytest.raises(ValueError):
        evidence.report(cases.limit(0))


DOCUMENT = {
    "nodes": [
        {"id": "package:p:/r", "type": "package", "data": {"package_name": "p", "location": {"file_path": "/r/p"}}},
        {"id": "package:q:/r/p", "type": "package", "data": {"package_name": "q", "location": {"file_path": "/r/p/q"}}},
        {"id": "function:f:/r/p/a.go", "type": "function", "data": {"package_name": "p", "function_name": "f", "params": "x int", "location": {"line": 1, "lineEnd": 4}}, "weights": {"importance": 50}},
        {"id": "function:g:/r/p/a.go", "type": "function", "data": {"package_name": "p", "function_name": "g", "location": {"line": 6, "lineEnd": 6}}},
        {"id": "struct:S:/r/p/a.go", "type": "struct", "data": {"package_name": "p", "struct_name": "S", "fields": ["a", "b"], "location": {"line": 8, "lineEnd": 12}}},
        {"id": "interface:I:/r/p/a.go", "type": "interface", "data": {"package_name": "p", "interface_name": "I", "methods": ["M() error"]}},
    ],
    "edges": [
        {"source_id": "function:f:/r/p/a.go", "target_id": "function:g:/r/p/a.go", "relation_type": "calls"},
        {"source_id": "function:f:/r/p/a.go", "target_id": "function:f:/r/p/a.go", "relation_type": "calls"},
        {"source_id": "function:g:/r/p/a.go", "target_id": "struct:S:/r/p/a.go", "relation_type": "instantiates"},
        {"source_id": "package:p:/r", "target_id": "function:f:/r/p/a.go", "relation_type": "has_function"},
    ],
}


def test_typed_graph(spark, tmp_path):
    nodes, edges = kg_json.load_rows(spark, DOCUMENT)
    files = spark.createDataFrame([("/r/p/a.go", "x\ny\n"), ("/r/p/a_test.go", "t")], "file_path string, content string")
    w = {r.id: r.weights for r in weights.node_weights(nodes, edges, files).collect()}
    f, g, s, p = (w[x] for x in ("function:f:/r/p/a.go", "function:g:/r/p/a.go", "struct:S:/r/p/a.go", "package:p:/r"))
    assert (f.caller_count, f.callee_count, f.self_recursive_func, f.code_line_count) == (1, 0, True, 4)
    assert (g.callee_count, g.instantiated_by_function) == (1, 1)
    assert (s.field_count, s.total_instance_count, s.code_line_count) == (2, 1, 5)
    assert (p.function_count, p.struct_count, p.interface_count, p.go_files_count, p.code_line_count, p.subpackage_count) == (2, 1, 1, 2, 3, 1)
    assert [r.signature for r in listings.list_package_functions(nodes, "package:p:/r").orderBy("id").collect()] == ["f(x int)", "g()"]
    assert listings.list_package_interfaces(nodes, "package:p:/r").first().methods == ["M() error"]
    assert [r.id for r in listings.list_subpackages(nodes, "package:p:/r").collect()] == ["package:q:/r/p"]
    scored = kg_json.with_importance(nodes, spark.createDataFrame([("function:g:/r/p/a.go", 80)], "id string, importance int"))
    important = importance.important_nodes(scored.select("id", "type", "weights.importance"), 50.9).collect()
    assert {(r.id, r.importance) for r in important} == {("function:f:/r/p/a.go", 50), ("function:g:/r/p/a.go", 80)}
    kg_json.write_graph(nodes, edges, str(tmp_path / "g.json"))
    again, more = kg_json.read_graph(spark, str(tmp_path / "g.json"))
    assert again.count() == 6 and more.count() == 4
    dot.write_dot(nodes, edges, str(tmp_path / "g.dot"))
    drawn = (tmp_path / "g.dot").read_text()
    assert "subgraph cluster_p" in drawn and "<fd1> a" in drawn and "calls" in drawn


def test_dot_parts_start_again(spark):
    rows = spark.createDataFrame([("p", f"n{i}") for i in range(9)], "package string, name string")
    got = dot.parts(rows, ["package"], "name", F.col("name"), most=25).orderBy("part").collect()
    assert len(got) == 3 and all(len(r.label) <= 25 for r in got) and got[0].label == "<f1> n0|<f2> n1|<f3> n2"


def test_call_resolution_and_nearest(spark):
    nodes = spark.createDataFrame([("f1", "function"), ("i1", "interface_func")], "id string, type string")
    facts = spark.createDataFrame([("c", "f1", "x", "calls"), ("c", "zz", "i1", "calls"), ("c", "f1", "x", "instantiates"), ("c", "no", "no", "calls")], "caller_id string, function_id string, interface_id string, relation_type string")
    assert {(r.target_id, r.target_type, r.relation_type) for r in listings.resolve_calls(facts, nodes).collect()} == {("f1", "function", "calls"), ("i1", "interface_function", "calls")}
    wanted = spark.createDataFrame([("k", "T", "/a/b/c", "main"), ("j", "T", "/x", "p2")], "key string, name string, file_path string, package_name string")
    have = spark.createDataFrame([("T", "far", "/z/y/c", "p1", 1), ("T", "near", "/a/b/d", "p2", 2)], "name string, id string, file_path string, package_name string, seq int")
    assert {r.key: r.id for r in listings.nearest(wanted, have).collect()} == {"k": "near", "j": "near"}


def test_scorers_and_shares(spark):
    rows = spark.range(25).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    assert importance.score_batches(rows, lambda b: {r["id"]: 1000 * r["v"] for r in b}).agg(F.max("importance"), F.min("importance")).first() == (100, 1)
    assert importance.top_share(rows, "v").count() == 5 and importance.top_share(rows.limit(2), "v").count() == 1
    assert importance.batch_prompts(rows, "function").agg(F.sum(F.size(F.split("prompt", "\n- ")) - 1)).first()[0] == 25
    tags = spark.createDataFrame([("TestRead",)], "n string").select(importance.keyword_tags("n")).first()[0]
    assert tags == ["testing", "io"]


def test_containment_and_rules(spark):
    files = spark.createDataFrame([("src/a/x.py", "1"), ("y.py", "2")], "file_path string, content string")
    symbols = spark.createDataFrame([("src/a/x.py", "Class", "", "C", "c"), ("src/a/x.py", "Method", "C", "m", "m"), ("y.py", "Method", "Gone", "n", "n")], "file_path string, kind string, parent_name string, name string, content string")
    tree = {tuple(r) for r in containment.contains(files, symbols, "repo").collect()}
    assert {("repo", "src"), ("src", "src_a"), ("src_a", "src_a_x_py"), ("repo", "y_py"), ("Class_src_a_x_py_C", "Method_src_a_x_py_C_m"), ("y_py", "Method_y_py_Gone_n")} <= tree
    assert containment.documents(files, symbols, "repo").count() == 8
    old = spark.createDataFrame([("k", "a", 1)], "key string, v string, seq int")
    assert containment.upsert(old, spark.createDataFrame([("k", "b", 2)], old.schema), ["key"]).first().v == "b"
    bad = schema_rules.violations(spark.createDataFrame([(1, "", 99), (1, "x", 5)], "id int, name string, c int"), ["id"], ["name"], {"c": (1, 50)})
    assert {(r.rule, r.rows) for r in bad.collect()} == {("unique", 1), ("required", 1), ("range", 1)}
