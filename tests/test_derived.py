import pytest
from pyspark.sql import functions as F

from graphloom.plans import derived as D


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(o, o * 7 % 13 + k, float(k + 1)) for o in range(300) for k in (0, 1, 1, 3)] + [(None, 4, 1.0), (5, None, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_lines_of_an_order_move_once(spark, tables):
    for built in (D.callable_keys(spark, tables), D.import_pairs(spark, tables), D.calls(spark, tables)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan


def test_parts_hold_a_bounded_number_of_lines(spark, tables, monkeypatch):
    monkeypatch.setattr(D, "LINES_A_PART", 50)
    parts = D.order_lines(spark, tables).select("l_orderkey", F.spark_partition_id().alias("p")).distinct()
    assert parts.select("p").distinct().count() >= 20
    assert parts.count() == parts.select("l_orderkey").distinct().count()
