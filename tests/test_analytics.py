"""Golden fixtures of the analytical queries, with their boundaries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.plans import ch

LINE = "l_orderkey long, ol_number int, delivered timestamp_ntz, qty long, cents long, l_suppkey long"


def at(n):
    return None if n is None else datetime(1970, 1, 1, 0, n // 60, n % 60)


def lines(spark, rows):
    return spark.createDataFrame([(o, n, d, q, 100 * a, 0) for o, n, d, q, a in rows], LINE)


B1 = [(1, 1, at(50), 5, 100), (1, 2, at(50), 3, 60), (2, 1, at(50), 7, 140), (2, 2, at(150), 2, 999), (3, 1, None, 1, 10)]


def test_summary(spark):
    got = {r.ol_number: r for r in ch.pricing_summary(lines(spark, B1), F.col("delivered") <= F.lit(at(100))).collect()}
    assert {k: (r.count_order, r.sum_qty, r.sum_amount, r.avg_qty, r.avg_amount) for k, r in got.items()} == {1: (2, 12, 240.0, 6.0, 120.0), 2: (1, 3, 60.0, 3.0, 60.0)}


def test_summary_cutoff_is_inclusive(spark):
    rows = [(1, 1, at(0), 1, 1), (1, 1, at(100), 1, 10), (1, 1, at(101), 1, 1_000_000)]
    r = ch.pricing_summary(lines(spark, rows), F.col("delivered") <= F.lit(at(100))).first()
    assert (r.count_order, r.sum_amount) == (2, 11.0)


def test_strict_variant_excludes_its_date(spark):
    day = datetime(2007, 1, 2)
    rows = [(1, 1, day, 9, 5), (1, 1, datetime(2007, 1, 2, 0, 0, 0, 1000), 3, 7)]
    r = ch.pricing_summary(lines(spark, rows), F.col("delivered") > F.lit(day)).collect()
    assert [(x.count_order, x.sum_amount) for x in r] == [(1, 7.0)]


@pytest.mark.parametrize("rows,lo,hi,want", [(B1, 0, 200, 1159.0), ([(1, 1, at(0), 1, 7), (1, 2, at(99), 1, 11), (1, 3, at(100), 1, 1_000_000)], 0, 100, 18.0), ([], 0, 100, 0.0)])
def test_revenue_bounds(spark, rows, lo, hi, want):
    d = F.col("delivered")
    assert ch.revenue(lines(spark, rows), (d >= F.lit(at(lo))) & (d < F.lit(at(hi))) & (F.col("qty") < 6)).first().revenue == want


def test_late_orders(spark):
    day = lambda n: datetime(1996, 1, 1 + n)
    orders = spark.createDataFrame([(10, day(1)), (11, day(1)), (12, datetime(1997, 1, 1)), (13, day(2)), (14, day(2))], "o_orderkey long, o_orderdate timestamp_ntz")
    rows = [(10, 1, day(20), 1, 1), (10, 2, day(3), 1, 1), (11, 1, day(3), 1, 1), (11, 2, day(3), 1, 1), (12, 1, None, 1, 1), (13, 1, None, 1, 1), (13, 2, day(4), 1, 1)]
    got = ch.late_orders(orders, lines(spark, rows), "1996-01-01 00:00:00", "1996-02-01 00:00:00", 5).collect()
    assert [(r.o_ol_cnt, r.order_count) for r in got] == [(2, 2)]  # 14 has no lines: not late


def test_revenue_by_nation(spark):
    orders = spark.createDataFrame([(1, datetime(1996, 5, 1))], "o_orderkey long, o_orderdate timestamp_ntz")
    rows = lines(spark, [(1, 1, None, 1, 50), (1, 2, None, 1, 30)]).withColumn("l_suppkey", F.col("ol_number").cast("long") - 1)
    supplier = spark.createDataFrame([(0, 6), (1, 8)], "s_suppkey long, s_nationkey long")
    nation = spark.createDataFrame([(6, "FRANCE", 3), (8, "INDIA", 2)], "n_nationkey long, n_name string, n_regionkey long")
    region = spark.createDataFrame([(3, "EUROPE"), (2, "ASIA")], "r_regionkey long, r_name string")
    ask = lambda name: [tuple(r) for r in ch.revenue_by_nation(orders, rows, supplier, nation, region, name, "1996-01-01 00:00:00", "1997-01-01 00:00:00").collect()]
    assert ask("EUROPE") == [("FRANCE", 50.0)]
    assert ask("ASIA") == [("INDIA", 30.0)]
    assert ask("ATLANTIS") == []


def test_partition_invariance(spark, sf):
    from chronolith.plans import base
    from chronolith.plans.registry import Tables

    rows = base.lines(Tables(spark, sf))
    want = sorted(map(tuple, ch.pricing_summary(rows, F.lit(True)).collect()))
    for n in (1, 3, 7):
        assert sorted(map(tuple, ch.pricing_summary(rows.repartitionByRange(n, "l_orderkey"), F.lit(True)).collect())) == want
