import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ids, rules, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")])
    return row.select(column).first()[0]


@pytest.mark.parametrize("raw, clean", [(" a\\b//c ", "a/b/c"), ("x y|z", "x_y_z"), ("\tq<r>\n", "q_r_"), ("", "")])
def test_sanitize(spark, raw, clean):
    assert one(spark, ids.sanitize("v"), v=raw) == clean


def test_ids(spark):
    path = ids.symbol_path(F.lit("src/m.py"), F.lit("A/B"), F.lit("run"))
    assert one(spark, path) == "src/m.py::A.B.run"
    assert one(spark, ids.symbol_path(F.lit("a.py"), F.lit(""), F.lit(ids.FILE_NAME))) == "a.py::_file_"
    assert one(spark, ids.node_id(*(F.lit(x) for x in ("t 1", "r", "c", "Method", "a.py::f")))) == "t_1|r|c|Method|a.py::f"
    edge = one(spark, ids.edge_id(*(F.lit(x) for x in ("t|r", "CALLS", "u|v", "rule"))))
    assert edge.startswith("edge|") and len(edge) == 29
    assert one(spark, ids.typed_id(F.lit("import"), F.lit("fmt"), F.lit("/a/b.go"))) == "import:fmt"
    assert one(spark, ids.typed_id(F.lit("package"), F.lit("p"), F.lit("/a/p"))) == "package:p:/a"


@pytest.mark.parametrize("n, size", [(240, 240), (241, 240), (5000, 240)])
def test_path_key_length(spark, n, size):
    key = one(spark, ids.path_key("v"), v="x" * n)
    assert len(key) == size and key.endswith("_trunc") == (n > 240)


@pytest.mark.parametrize("path, kind", [("src/Test_docs.py", "test"), ("docs/conf.py", "documentation"), ("app/config.py", "config"), ("app/x.py", "source")])
def test_module_type(spark, path, kind):
    assert one(spark, text.module_type("v"), v=path) == kind


@pytest.mark.parametrize("raw, iso", [
    (None, None), ("", None), ("junk", None), ("1734192659", "2024-12-14T16:10:59+00:00"), ("2024-12-14 16:10:59", "2024-12-14T16:10:59+00:00"),
    ("2024-12-14T18:10:59+02:00", "2024-12-14T16:10:59+00:00"), ("Sat, 14 Dec 2024 16:10:59 GMT", "2024-12-14T16:10:59+00:00"), ("2024-12-14", "2024-12-14T00:00:00+00:00"),
])
def test_utc_datetime(spark, raw, iso):
    row = spark.createDataFrame([(raw,)], "v string").select(text.utc_datetime("v")).first()
    assert row[0] == iso


def test_languages(spark):
    rows = spark.createDataFrame([("a/B.PY",), ("x.go",), ("noext",), ("t.TSX",)], "p string")
    got = [tuple(r) for r in rows.select(text.language("p"), text.is_supported("p")).collect()]
    assert got == [("python", True), ("go", False), ("unknown", False), ("tsx", True)]


@pytest.mark.parametrize("name, current, path", [("pkg.module", "a/b.py", "pkg/module"), (".sub.mod", "src/current/f.py", "src/current/sub/mod"), ("..x", "a/b/c.py", "a/x"), (".", "a/b.py", "a")])
def test_import_target(spark, name, current, path):
    assert one(spark, text.import_target("n", "c"), n=name, c=current) == path


@pytest.mark.parametrize("kind, found", [("map[string][]*pkg.T", ["pkg.T"]), ("map[K]V", ["K", "V"]), ("[]int", []), ("*Foo", ["Foo"]), ("", []), ("map[string]map[Key]*Val", ["Key", "Val"])])
def test_referenced_types(spark, kind, found):
    assert one(spark, text.referenced_types("v"), v=kind) == found


@pytest.mark.parametrize("reply, found", [("x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'), ("```\n[1]\n```", "[1]"), ("so {\"b\": {}} ok", '{"b": {}}'), ("none", "none")])
def test_reply_json(spark, reply, found):
    assert one(spark, text.reply_json("v"), v=reply) == found


def test_small_functions(spark):
    assert one(spark, text.element_type("v"), v="List[Worker]") == "Worker"
    assert one(spark, text.returns_self("o", "m"), o="QueryBuilder", m="go") is True
    assert one(spark, text.returns_self("o", "m"), o="A", m="set_x") is True
    assert one(spark, text.returns_self("o", "m"), o="A", m="run") is False
    assert one(spark, text.dot_id("v"), v="*a.b[c]/d") == "ptr_a_barr_c_d"
    assert one(spark, text.dot_params("v"), v="x chan struct{}, y struct { a int }") == "x chan struct, y struct"
    assert one(spark, text.path_label("v"), v=["f:a:x", "f:b:y"]) == "a-b"
    assert one(spark, text.type_of_value("v"), v="make(map[string]int, 3)") == "map[string]int"
    assert one(spark, text.type_of_value("v"), v="&pkg.T{A: 1}") == "pkg.T"
    assert one(spark, text.fits_model("t", "m"), t="x" * 20_000, m="gpt-4") is True
    assert one(spark, text.fits_model("t", "m"), t="x" * 20_000, m="other") is False
    assert one(spark, text.normalized_source("v"), v="a\r\nb\rc") == "a\nb\nc\n"
    assert one(spark, text.line_count("v"), v="a\nb\n") == 3


def test_rules(spark):
    rel = spark.createDataFrame([("CALLS", True), ("CALLS", False), ("ODD", None)], "relation_type string, s boolean")
    got = rules.with_rule(rel, F.col("s")).select("rule_id", "priority").collect()
    assert [tuple(r) for r in got] == [("calls.super.method", 25), ("calls.function.dispatch", 30), ("relation.unknown", 999)]


@pytest.mark.parametrize("kind, kept", [("Class", "INSTANTIATES"), ("Method", "CALLS")])
def test_one_relation_a_pair(spark, kind, kept):
    rel = spark.createDataFrame([("a", "b", "CALLS", kind, 1, 1), ("a", "b", "INSTANTIATES", kind, 2, 2)], "source_key string, target_key string, relation_type string, target_kind string, phase int, seq int")
    assert [r.relation_type for r in rules.one_per_pair(rel).collect()] == [kept]
