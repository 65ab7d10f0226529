"""Pairs of intervals: all of them, dealt out in the same way at any size, with no side sent whole to every task."""

import random

import pytest
from pyspark.sql import functions as F

from loomseq import catalog
from loomseq.operators import ranges


def made(spark):
    """Equal rows, names that come back, nulls, a bin that most rows share, and intervals that are empty or end before they start."""
    r = random.Random(11)
    rows = [(r.choice([0, 1, None]), r.choice([None, *range(60)]), a, a + r.choice([-12, -1, 0, 1, 2, 5, 9, 30])) for a in (r.choice([-9, 4, 5, 6, r.randrange(-30, 60)]) for _ in range(260))]
    rows += rows[:20] + [(1, 3, None, 4), (0, 5, 2, None)]
    return rows, spark.createDataFrame(rows, "k long, name long, start long, stop long")


def pairs(rows, test):
    whole = [x for x in rows if None not in x]
    return sorted((x[0], x[1], y[1]) for x in whole for y in whole if x[0] == y[0] and test(x, y))


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_overlap_pairs(spark, block):
    rows, df = made(spark)
    got = sorted(map(tuple, ranges.overlap_pairs(df, ["k"], "name", 8, block).select("k", "a", "b").collect()))
    assert got == pairs(rows, lambda x, y: x[2] < y[3] and y[2] < x[3] and x[1] < y[1])


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_containment_pairs(spark, block):
    rows, df = made(spark)
    got = sorted(map(tuple, ranges.containment_pairs(df, ["k"], "name", 8, block).select("k", "a", "b").collect()))
    assert got == pairs(rows, lambda x, y: y[2] <= x[2] and x[3] <= y[3] and x[1] != y[1])


@pytest.mark.parametrize("name", ["overlap_join", "containment_join"])
def test_rows_are_dealt_out_however_few(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # only the list of large bins is broadcast, and tasks aren't merged by bytes, since pairs outgrow those
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert all("LeftOuter" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert df.agg(F.count("*")).first()[0] > 0
