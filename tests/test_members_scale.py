from weftgraph.operators import importance


def test_edges_stay_where_they_are(spark):
    """Few nodes go to the edges; the edges, their product, aren't shuffled to the nodes."""
    nodes = spark.createDataFrame([("function:1", "function"), ("struct:5", "struct")], "id string, type string")
    edges = spark.createDataFrame([("struct:5", "function:1", "has_method"), ("struct:5", "struct:5", "has_method")], "source_id string, target_id string, relation_type string")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = importance.members(nodes, edges, ("has_method",), ("function",))
        plan = held._jdf.queryExecution().sparkPlan().toString()
        assert [tuple(r) for r in held.select("owner", "id").collect()] == [("struct:5", "function:1")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
