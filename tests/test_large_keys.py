"""Runs, merged intervals and joins of points with them where a key is dealt into ranges, against keys in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import ranges

R = random.Random(31)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    keys = ["a"] * 6 + ["b", "c", None]
    iv = [(R.choice(keys), s, s + R.randrange(1, 30), f"n{i}") for i, s in enumerate(R.randrange(2000) for _ in range(500))]
    points = [(R.choice(keys), R.randrange(2100), i) for i in range(900)] + [("z", 5, -1), ("a", None, -2)]
    df = spark.createDataFrame(iv, "key string, start long, stop long, name string").repartition(3)
    return df, spark.createDataFrame(points, "key string, p long, no long").repartition(3)


def test_merged(tables):
    iv = tables[0].select("key", "start", "stop")
    assert rows(ranges.merge_intervals(iv, ["key"], hot=0)) == rows(ranges.merge_intervals(iv, ["key"]))
    assert rows(ranges.merge_intervals(iv.unionByName(iv), ["key"], hot=0)) == rows(ranges.merge_intervals(iv, ["key"]))


def test_runs(tables):
    points = tables[1].select("key", "p").dropna().distinct()
    assert rows(ranges.maximal_runs(points, ["key"], "p", F.lit(True), hot=0)) == rows(ranges.maximal_runs(points, ["key"], "p", F.lit(True)))


def test_points_in_intervals(tables):
    iv, points = tables
    asof = lambda **x: ranges.last_start(points, iv.dropDuplicates(["key", "start"]), ["key"], "p", ["name", "stop"], **x)
    assert rows(asof(hot=0)) == rows(asof())
    b = iv.select("key", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), "name")
    first = lambda **x: ranges.first_match(points, b, ["key"], "p", "name", **x)
    assert rows(first(hot=0)) == rows(first())
