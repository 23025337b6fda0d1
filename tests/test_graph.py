from pyspark.sql import functions as F

from veridale.operators import graph
from veridale.operators.graph import components, dealt_join


def test_long_chains_are_one_component(spark):
    n = 100
    made = [(k, k + 1) for k in range(n)] + [(200, 201), (205, 201)]
    edges = spark.createDataFrame(made, "from long, to long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {200: 200, 201: 200, 205: 200}
    assert components(edges.limit(0)).count() == 0


def test_null_ends_loops_and_repeats_dont_matter(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "c"), ("d", None), (None, None), ("a", "e")], "from string, to string")
    assert {r.node: r.component for r in components(edges).collect()} == {"a": "a", "b": "a", "e": "a"}


def test_large_keys_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 10)
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', concat('k', id)) as key", "id % 7 as other")
    per = rows.groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    got = {r.id: r.last for r in dealt_join(rows, per, ["key", "other"], "id").collect()}
    assert got == {i: (max(k for k in range(900) if k % 7 == i % 7) if i < 900 else i) for i in range(1000)}
    # without a row of per_key a row stays
    few = spark.createDataFrame([("hot", 900, 1)], "key string, n long, x int")
    joined = dealt_join(rows, few, ["key"], "id")
    assert joined.count() == 1000 and joined.where("x = 1").count() == 900
    assert dealt_join(rows.limit(0), few.limit(0), ["key"], "id").count() == 0


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 10)
    edges = spark.range(1, 500).selectExpr("0L as from", "id as to").unionByName(spark.createDataFrame([(900, 901)], "from long, to long"))
    assert {r.node: r.component for r in components(edges).collect()} == {k: 0 for k in range(500)} | {900: 900, 901: 900}
