from collections import Counter
from itertools import combinations

from weftgraph.plans import catalog

ID = "t0|tpch|c0|"


def tables(spark, folder, **rows):
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def calls_of(spark, tmp_path):
    """Three customers; the third has no orders."""
    orders = [(1, 10), (1, 11), (2, 20), (2, 21)]
    items = [(10, 1, 1), (10, 2, 1), (11, 1, 2), (20, 1, 1), (20, 3, 2), (21, 3, 3), (21, 3, 3)]
    d = tables(spark, tmp_path, nation=("n_nationkey int, n_regionkey int", [(0, 0)]), customer=("c_custkey int, c_nationkey int", [(1, 0), (2, 0), (3, 0)]),
               orders=("o_custkey int, o_orderkey int", orders), lineitem=("l_orderkey int, l_partkey int, l_suppkey int", items))
    held, sold = {(o, p) for o, p, _ in items}, {(p, s) for _, p, s in items}
    three = [(c, o, p) for c, o in orders for q, p in held if q == o]
    want = three + [(*x, s) for x in three for p, s in sold if p == x[2]]
    name = lambda x: tuple(f"{ID}{k}/{v}" for k, v in zip(("File|customer", "Method|orders", "Class|part", "Interface|supplier"), x))
    return d, [name(x) for x in want]


def test_paths_from_every_entry(spark, tmp_path):
    d, want = calls_of(spark, tmp_path)
    got = catalog.queries()["long_paths"](spark, d).collect()
    assert sorted(r.path for r in got) == sorted(map(">".join, want))
    assert {r.path.split(">")[0] for r in got} == {f"{ID}File|customer/{i}" for i in (1, 2)}
    top = sorted(want, key=lambda x: (-len(x), x))[: len(want) // 5 if len(want) > 25 else len(want)]
    assert sorted(r.path for r in catalog.queries()["longest_paths"](spark, d).collect()) == sorted(map(">".join, top))
    shared = Counter()
    for a, b in combinations(top, 2):
        both = [x for x in a if x in b]
        if len(both) >= 3:
            shared[">".join(both)] += 1
    assert {r.common_path: r.n for r in catalog.queries()["common_subpaths"](spark, d).collect()} == shared


def test_members_and_coverage_of_every_row(spark, tmp_path):
    d = tables(spark, tmp_path, region=("r_regionkey int", [(0,)]), nation=("n_nationkey int, n_regionkey int", [(0, 0), (1, 0)]),
               customer=("c_custkey int, c_nationkey int, c_name string, c_mktsegment string", [(1, 0, "a", "m"), (2, 1, "b", "m"), (3, 1, "c", "m")]),
               supplier=("s_suppkey int, s_nationkey int, s_name string", [(5, 0, "x"), (25, 1, "y"), (900, 1, "z")]),
               part=("p_partkey int, p_size int", [(1, 7), (2, 8), (3, 50)]), lineitem=("l_partkey int, l_quantity double", [(2, 46.0), (2, 50.0), (2, 45.0), (1, 1.0)]))
    owned = [("struct:5", "function:1"), *((f"struct:{s}", f"function:{c}") for s in (25, 900) for c in (2, 3))]
    assert sorted(tuple(r) for r in catalog.queries()["staged_members"](spark, d).collect()) == sorted(owned)
    assert sorted(tuple(r) for r in catalog.queries()["coverage_check"](spark, d).collect()) == [(1, 0, False), (2, 2, True), (3, 0, False)]


def test_texts_are_read_whole(spark, tmp_path):
    from hashlib import md5

    html = "<p>" + "x" * 500
    d = tables(spark, tmp_path, pages=("page_id int, html string", [(1, html), (2, html + "y"), (3, None), (4, "a/b")]),
               documents=("doc_id int, source string, text string", [(1, "web", "a" * 60 + " Test"), (2, "web", "b" * 60 + " config"), (3, "web", "c"), (4, "web", "d" * 60 + "doc")]))
    key = lambda x: "_p_" + "x" * 222 + "_" + md5(x.encode()).hexdigest()[:8] + "_trunc"
    got = {r.page_id: r.path_key for r in catalog.queries()["path_keys"](spark, d).collect()}
    assert got == {1: key(html), 2: key(html + "y"), 3: None, 4: "a_b"}
    kinds = {r.doc_id: r.module_type for r in catalog.queries()["file_entities"](spark, d).collect()}
    assert kinds == {1: "test", 2: "config", 3: "source", 4: "documentation"}


def test_common_subpaths_of_every_path(spark, tmp_path):
    """More paths than a report's sample: 4 customers, 12 orders, 4 parts, 4 suppliers."""
    orders = [(c, 10 * c + i) for c in range(1, 5) for i in range(3)]
    items = [(o, p, (o + p) % 4) for _, o in orders for p in range(4) if (o + p) % 3]
    d = tables(spark, tmp_path, nation=("n_nationkey int, n_regionkey int", [(0, 0)]), customer=("c_custkey int, c_nationkey int", [(c, 0) for c in range(1, 5)]),
               orders=("o_custkey int, o_orderkey int", orders), lineitem=("l_orderkey int, l_partkey int, l_suppkey int", items))
    sold = {(p, s) for _, p, s in items}
    three = [(f"File|customer/{c}", f"Method|orders/{o}", f"Class|part/{p}") for c, o in orders for q, p, _ in items if q == o]
    every = three + [(*x, f"Interface|supplier/{s}") for x in three for p, s in sold if x[2] == f"Class|part/{p}"]
    shared = Counter()
    for a, b in combinations(every, 2):
        both = [x for x in a if x in b]
        if len(both) >= 3:
            shared[">".join(ID + x for x in both)] += 1
    assert len(every) > 100 and {r.common_path: r.n for r in catalog.queries()["common_subpaths"](spark, d).collect()} == shared
