"""Ranks, order statistics and multiple testing."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import spool


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of a column's values; integers stay themselves."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    names = column.combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    order = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), object), kind="stable"), kind="stable")
    return order[names.indices.to_numpy()]


def _offsets(rows: DataFrame, add: Column) -> dict[int, float]:
    """The sum of `add` in all partitions before each, of rows with _id: the driver sees one number a partition."""
    got = sorted((r[0], r[1] or 0) for r in rows.groupBy(F.shiftright("_id", 33).alias("p")).agg(add).collect())
    before, total = {}, 0
    for p, c in got:
        before[p], total = total, total + c
    return before


def _look_up(of: dict[int, float], kind: str) -> Column:
    """A value for the partition of a row with _id, from one literal that is read by position."""
    text = ",".join(repr(of.get(p, 0)) for p in range(max(of, default=0) + 1))
    return F.get(F.split(F.lit(text), ",").cast(f"array<{kind}>"), F.shiftright("_id", 33).cast("int"))


def _in_order(df: DataFrame, order: list[Column], partitions: int = 0) -> DataFrame:
    """`df` sorted into ranges, with _id: its partition and the place in it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spool(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")


def row_numbers(df: DataFrame, order: list[Column], name: str, partitions: int = 0) -> DataFrame:
    """A global 0-based row number in a total order, without a window over the whole table.

    Rows are dealt into ranges and sorted; each gets its place in its range plus the rows of the ranges before, of
    which the driver sees one count a range.
    """
    rows = _in_order(df, order, partitions)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, _look_up(_offsets(rows, F.count("*")), "long") + place).drop("_id")


def after_others(df: DataFrame, order: list[Column], depth: int) -> tuple[DataFrame, WindowSpec]:
    """`df` in ranges of a total order, and a window in which each row sees at least `depth` rows before it.

    Each range begins with copies of the rows that end the ranges before (`depth` of each pass through the driver);
    they have _copy and are to be dropped once the window was used. Rows have _part and _id.
    """
    rows = _in_order(df, order).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    last = sorted(tuple(r) for r in rows.groupBy("_part").agg(F.max("_id")).collect())
    ends = rows.where(F.col("_id").isin([m - i for _, m in last for i in range(depth) if (m - i) >> 33 == m >> 33])).collect()
    ends = sorted((r.asDict() for r in ends), key=lambda r: r["_id"])
    copies = []
    for part, _ in last:
        before = [r for r in ends if r["_part"] < part][-depth:]
        copies += [{**r, "_part": part, "_id": (part << 33) - len(before) + i} for i, r in enumerate(before)]
    more = df.sparkSession.createDataFrame([tuple(c[n] for n in rows.columns) for c in copies], rows.schema)
    both = rows.withColumn("_copy", F.lit(False)).unionByName(more.withColumn("_copy", F.lit(True)))
    return both, Window.partitionBy("_part").orderBy("_id")


def numbered(rows: DataFrame, w: WindowSpec, keep: Column, name: str) -> DataFrame:
    """Rows of `after_others` without its copies, and how many rows up to each `keep` holds for, in all ranges, less one."""
    rows = rows.withColumn("_keep", (keep & ~F.col("_copy")).cast("long"))
    rows = spool(rows.withColumn("_sum", F.sum("_keep").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not _copy"), "numbered")
    return rows.withColumn(name, F.col("_sum") + _look_up(_offsets(rows, F.sum("_keep")), "long") - 1).drop("_keep", "_sum", "_copy", "_part", "_id")


def running_sum(df: DataFrame, order: list[Column], add: str, name: str) -> DataFrame:
    """The sum of `add` over this and all earlier rows in a total order: a window within each range, plus the ranges before."""
    rows = _in_order(df, order)
    w = Window.partitionBy(F.shiftright("_id", 33)).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(add).over(w) + _look_up(_offsets(rows, F.sum(add)), "long")).drop("_id")


def running_sums(df: DataFrame, order: list[Column], add: list[str]) -> DataFrame:
    """`df` with the running sums of several columns, each named after its column and ending in _upto."""
    rows = _in_order(df, order)
    w = Window.partitionBy(F.shiftright("_id", 33)).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[(F.sum(c).over(w) + _look_up(_offsets(rows, F.sum(c)), "long")).alias(f"{c}_upto") for c in add]).drop("_id")


def carried(df: DataFrame, key: list[str], order: list[Column], value: Column, name: str, how: str = "last", before: bool = False) -> DataFrame:
    """`df` with the last value that isn't null (or with how="max" the greatest) of this and all earlier rows of its key.

    With `before` the row itself doesn't count. Rows are dealt into ranges of key and order, so a large key is many tasks:
    what a range knows of its last key is handed to the ranges after it, of which the driver sees a row each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in key], *order]
    rows = df.withColumn("_v", value).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    of = F.max if how == "max" else lambda c: F.last(c, ignorenulls=True)
    w = Window.partitionBy("_part", *key).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", of("_v").over(w))
    if before:
        rows = rows.withColumn("_before", of("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = spool(rows, "carried")
    ends = rows.groupBy("_part").agg(F.min_by(F.struct(*key), "_id").alias("first"), F.max_by(F.struct(F.struct(*key).alias("key"), F.col("_upto").alias("v")), "_id").alias("last"))
    more, carry = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        last, v = r["last"]["key"], r["last"]["v"]
        if carry is not None and carry[0] == r["first"] and carry[1] is not None:
            more.append((r["_part"], *carry[0], carry[1]))
            if last == r["first"]:
                v = carry[1] if v is None else max(v, carry[1]) if how == "max" else v
        carry = (last, v)
    schema = StructType([StructField("_p", IntegerType()), *[StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(key)], StructField("_c", rows.schema["_v"].dataType)])
    handed = F.broadcast(df.sparkSession.createDataFrame(more, schema))
    on = (F.col("_part") == F.col("_p")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    own = F.col("_before" if before else "_upto")
    run = F.greatest(own, "_c") if how == "max" else F.coalesce(own, "_c")
    return rows.join(handed, on, "left").select(*df.columns, run.alias(name))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """1-based ranks in which ties share their mean: counts of equal values are summed, and only they are ordered."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        ranked = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(value)))
    else:
        ranked = running_sum(counts, [F.col(value)], "_n", "_upto")
    ranked = ranked.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranked, [*by, value])


def benjamini_hochberg(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adjusted p-values: the least p * m / rank over this and all larger p, 1 at most. Null p stay null and don't count.

    Distinct values are dealt into ranges: ranks get the counts of the ranges before, and the running least gets the
    least of the ranges after, of which the driver sees one number each.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    steps = _in_order(running_sum(counts, [F.col(p)], "_n", "_upto"), [F.col(p)])
    total = steps.agg(F.sum("_n").cast("double")).first()[0] or 0.0
    steps = steps.select(p, "_id", (F.col(p) * total / F.col("_upto")).alias("_q"))
    least, after = 1.0, {}
    for r in sorted(steps.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.min("_q").alias("q")).collect(), reverse=True):
        after[r["p"]], least = least, min(least, r["q"])
    w = Window.partitionBy(F.shiftright("_id", 33)).orderBy(F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(p, F.least(F.min("_q").over(w), _look_up(after, "double")).alias(name))
    return df.join(steps, p, "left")


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share by Wilson; (0, 0) without trials."""
    f, d = x / n, 1 + z * z / n
    half = z * F.sqrt(f * (1 - f) / n + z * z / (4 * n * n)) / d
    mid = (f + z * z / (2 * n)) / d
    return F.when(n > 0, mid - half).otherwise(0.0), F.when(n > 0, mid + half).otherwise(0.0)


def wald(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    f = x / n
    half = z * F.sqrt(f * (1 - f) / n)
    return F.when(n > 0, f - half).otherwise(0.0), F.when(n > 0, f + half).otherwise(0.0)


def sign_z(up: Column, down: Column) -> Column:
    """z of a sign test, zeros left out; 0 without pairs."""
    n = up + down
    return F.when(n > 0, (up - n / 2) / F.sqrt(n / 4)).otherwise(0.0)


def mcnemar(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square of discordant counts; 0 without any."""
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c)).otherwise(0.0)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p against one half for any n: twice the smaller tail, 1 at most; terms are summed from their logs."""
    m = F.least(k, n - k).cast("int")
    first = n * math.log(0.5)
    more = F.when(m < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), m))
    zero = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    return F.least(F.lit(1.0), 2 * F.aggregate(more, zero, step, lambda a: a["s"]))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """The complementary error function, which Spark lacks; null stays null."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(v)).astype(float)


def sign_p(up: Column, down: Column) -> Column:
    """Two-sided p of a sign test by the normal approximation; 1 without pairs."""
    return erfc(F.abs(sign_z(up, down)) / math.sqrt(2))


def wilcoxon(df: DataFrame, by: list[str], diff: str, least: int = 10) -> DataFrame:
    """Signed-rank test of each group: n (differences that aren't zero), w_plus, z with ties corrected; groups of fewer than
    `least` are left out. Equal absolute differences are counted first, and only their distinct values are ordered."""
    rows = df.where(F.col(diff) != 0).select(*by, F.abs(diff).alias("_a"), (F.col(diff) > 0).alias("_up"))
    ties = rows.groupBy(*by, "_a").agg(F.count("*").alias("_t"), F.count_if("_up").alias("_u"))
    w = Window.partitionBy(*by).orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("_r", F.sum("_t").over(w) - (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    out = ranked.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_r") * F.col("_u")).alias("w_plus"), F.sum(t * t * t - t).alias("_c")).where(F.col("n") >= least)
    n = F.col("n").cast("double")
    return out.select(*by, "n", "w_plus", ((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_c") / 48)).alias("z"))


def depth_matched(df: DataFrame, key: list[str], x: str, n: str, depth: str, seeds: int = 5) -> DataFrame:
    """`df` once for each seed with `drawn`: of `depth` of its n reads, drawn without replacement, those among the x.

    The generator of a row is seeded by its key and seed, so the draws don't depend on partitions or retries.
    """

    @F.pandas_udf("long")
    def draw(seed: pd.Series, x: pd.Series, n: pd.Series, depth: pd.Series) -> pd.Series:
        cols = zip(seed, x, n, depth, strict=True)
        return pd.Series([np.random.default_rng(int(s) & (1 << 63) - 1).hypergeometric(a, b - a, min(d, b)) for s, a, b, d in cols], dtype="int64")

    rows = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return rows.withColumn("drawn", draw(F.xxhash64(*key, "seed"), F.col(x), F.col(n), F.col(depth)))
