"""Queries over all rows of their tables, against plain Python on a small fixture."""

from lineloom import registry


def test_all_parts_are_compared(spark, tmp_path):
    names = ["red bolt", "red", "blue nut small", "blue", "green ring", "redder bolt", "red bolt"]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.device, r.document) for r in registry.queries()["q_prefix_compat"](spark, str(tmp_path)).select("device", "document").collect())
    assert got == sorted({(x, y.split(" ")[0]) for x in names for y in names if x.split(" ")[0] == y.split(" ")[0]})


def test_all_orders_are_looked_up(spark, tmp_path):
    tables = {
        "orders": ([(k, k % 4) for k in range(1, 26)], "o_orderkey long, o_custkey long"),
        "customer": ([(0, 0), (1, 1), (2, 2)], "c_custkey long, c_nationkey long"),
        "nation": ([(0, 0), (1, 1), (2, 0)], "n_nationkey long, n_regionkey long"),
        "region": ([(0, "EUROPE"), (1, "ASIA")], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(tuple(r) for r in registry.queries()["q_semantic_lookup"](spark, str(tmp_path)).collect())
    assert got == [(k, "EUROPE") for k in range(1, 26) if k % 4 in (0, 2)]
