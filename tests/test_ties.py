"""Equal averages have one rank, whatever the order of their sums."""

from datetime import datetime

from tessera.plans import catalog, more  # noqa: F401


def test_equal_suppliers_have_one_borda_rank(spark, tmp_path):
    values = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (0.4, 0.2, 0.1)}  # 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1
    rows = [(k, p, v, datetime(1996, 5, 3)) for k, vs in values.items() for p in (1, 2) for v in vs]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_extendedprice double, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "ECONOMY A"), (2, "MEDIUM B")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.entity: r.borda for r in catalog.QUERIES["bm6_borda"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == 0 and got[3] == 4
