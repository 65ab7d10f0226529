"""Runs, intervals and joins of points with them. Intervals are half-open."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spool
from . import ranks


#: Rows of a key from which it is dealt into ranges; smaller keys are one sorted pass each.
HOT_KEY = 1 << 22


def has_large(df: DataFrame, key: list[str], hot: int) -> bool:
    """Whether any key has more than `hot` rows: counts are combined before they meet, and one number comes back."""
    return (df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > hot


def running(df: DataFrame, key: list[str], order: list[str | Column], value: Column, name: str, how: str, before: bool, hot: int) -> DataFrame:
    """`df` with the last or greatest value up to each row of its key (`ranks.carried`), by one window where keys are small."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if has_large(df, key, hot):
        return ranks.carried(df, key, order, value, name, how, before)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn("_v", value).withColumn(name, F.max("_v").over(w) if how == "max" else F.last("_v", ignorenulls=True).over(w)).drop("_v")


def maximal_runs(df: DataFrame, key: list[str], pos: str, inside: Column, hot: int = HOT_KEY) -> DataFrame:
    """Stretches of consecutive positions at which `inside` holds: key, start, stop."""
    rows = df.where(inside).select(*key, F.col(pos).cast("long").alias("p"))
    if has_large(rows, key, hot):
        rows, w = ranks.after_others(rows, [*[F.col(k) for k in key], F.col("p")], 1)
        same = reduce(lambda a, b: a & b, [F.lag(k).over(w).eqNullSafe(F.col(k)) for k in key])
        rows = rows.withColumn("_new", ~F.coalesce(same & (F.lag("p").over(w) == F.col("p") - 1), F.lit(False)))
        rows = ranks.numbered(rows, w, F.col("_new"), "g")
        return rows.groupBy(*key, "g").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("stop")).drop("g")
    island = F.col("p") - F.row_number().over(Window.partitionBy(*key).orderBy("p"))
    return rows.withColumn("g", island).groupBy(*key, "g").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("stop")).drop("g")


#: Rows that a task makes of texts before it hands them on.
ROWS = 1 << 17


def of_text(df: DataFrame, text: str, of: Callable[[np.ndarray | None], list[np.ndarray]], more: str) -> DataFrame:
    """The rows that `of` makes of each text on its own, as arrays of the columns `more`, beside the other columns of `df`.

    `of` gets the code points of a text, or None for null. A text is one task's, so nothing is shuffled.
    """
    keep = [c for c in df.columns if c != text]
    fields = [f.split() for f in more.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_()}[t] for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = [], [], 0
            texts = batch.column(len(keep))
            for i in range(len(texts)):
                t = texts[i].as_py()
                got = of(None if t is None else np.frombuffer(t.encode("utf-32-le"), "<u4"))
                at.append((i, len(got[0])))
                held.append(got)
                size += len(got[0])
                if size >= ROWS or i == len(texts) - 1:
                    take = pa.array(np.repeat([x for x, _ in at], [n for _, n in at]))
                    cols = [c.take(take) for c in batch.columns[:-1]]
                    cols += [pa.array(np.concatenate(x), t) if not isinstance(x[0], np.ma.MaskedArray) else pa.array(np.concatenate([y.data for y in x]), t, mask=np.concatenate([np.ma.getmaskarray(y) for y in x])) for x, t in zip(zip(*held, strict=True), types, strict=True)]
                    whole = pa.RecordBatch.from_arrays(cols, names)
                    for a in range(0, len(whole), ROWS):
                        yield whole.slice(a, ROWS)
                    at, held, size = [], [], 0

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])
    return df.select(*keep, text).mapInArrow(run, schema)


def _runs_of(codes: np.ndarray, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of `letters`."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = np.isin(codes, [ord(c) for c in letters])
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def text_runs(df: DataFrame, text: str, letters: str = "ACGT") -> DataFrame:
    """Maximal runs of `letters` in whole sequences, a row each, in linear time and without a shuffle: run_ix, start, stop, off, joined.

    off is the number of other letters before the run since the last one; joined is its place among run letters.
    """

    def of(codes: np.ndarray | None) -> list[np.ndarray]:
        start, stop = _runs_of(codes if codes is not None else np.zeros(0, np.uint32), letters)
        size = stop - start
        return [np.arange(len(start)), start, stop, start - np.r_[0, stop][:-1], np.cumsum(size) - size]

    return of_text(df, text, of, "run_ix long, start long, stop long, off long, joined long")


def text_places(df: DataFrame, text: str, every: int, span: int = 0, letters: str = "ACGT") -> DataFrame:
    """Every so many positions of each text from 0, while `span` more letters follow: pos, and run_ix, start, stop, joined of its run.

    The last four are null outside runs. Runs and positions are of one text, so they meet where it is read.
    """

    def of(codes: np.ndarray | None) -> list[np.ndarray]:
        codes = codes if codes is not None else np.zeros(0, np.uint32)
        start, stop = _runs_of(codes, letters)
        pos = np.arange(0, max(len(codes) - span, 0), every)
        at = np.searchsorted(start, pos, side="right") - 1
        if not len(start):
            start, stop, at = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(len(pos), np.int64)
        size = stop - start
        out = (at < 0) | (pos >= stop[at])
        return [pos, *(np.ma.MaskedArray(x, out) for x in (at, start[at], stop[at], (np.cumsum(size) - size)[at]))]

    return of_text(df, text, of, "pos long, run_ix long, start long, stop long, joined long")


def text_windows(df: DataFrame, text: str, size: int, stride: int, letters: str = "ACGT") -> DataFrame:
    """The `tiles` of each text: w, joined_start (letters of runs before it) and n (those inside it)."""

    def of(codes: np.ndarray | None) -> list[np.ndarray]:
        codes = codes if codes is not None else np.zeros(0, np.uint32)
        upto = np.r_[0, np.cumsum(np.isin(codes, [ord(c) for c in letters]))].astype(np.int64)
        w = np.arange(max(1, -(-len(codes) // stride)))
        a, b = np.minimum(w * stride, len(codes)), np.minimum(w * stride + size, len(codes))
        return [w, upto[a], upto[b] - upto[a]]

    return of_text(df, text, of, "w long, joined_start long, n long")


def _flanks(codes: np.ndarray | None, flank: int, between: int, letters: str, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sites with room for both flanks, every so many letters, and either flank as a number in the base of `letters`."""
    digit = np.zeros(max(int(codes.max()) if codes is not None and len(codes) else 0, *map(ord, letters)) + 1, np.int64)
    digit[[ord(c) for c in letters]] = np.arange(len(letters))
    d = digit[codes] if codes is not None else np.zeros(0, np.int64)
    n = max(len(d) - 2 * flank - between + 1, 0)
    site = np.arange(0, n, every)
    a, b = np.zeros(len(site), np.int64), np.zeros(len(site), np.int64)
    for j in range(flank):
        a = a * len(letters) + d[j : j + n : every][: len(site)]
        b = b * len(letters) + d[j + flank + between : j + flank + between + n : every][: len(site)]
    return site, a, b


def flank_sites(df: DataFrame, text: str, flank: int, between: int, letters: str, every: int = 1) -> DataFrame:
    """The sites of each text with room for two flanks of `letters`, `between` apart: site and k, both flanks as one number."""

    def of(codes: np.ndarray | None) -> list[np.ndarray]:
        site, a, b = _flanks(codes, flank, between, letters, every)
        return [site, a * len(letters) ** flank + b]

    return of_text(df, text, of, "site long, k long")


def flank_pair_sites(df: DataFrame, text: str, flank: int, between: int, letters: str) -> DataFrame:
    """The same with either flank as a number of its own, a and b: flanks of twice the letters fit."""
    return of_text(df, text, lambda codes: list(_flanks(codes, flank, between, letters)), "site long, a long, b long")


def flank_counts(df: DataFrame, text: str, flank: int, between: int, letters: str) -> DataFrame:
    """k and n: how often each pair of flanks stands in all texts. Tasks count all pairs that there can be, so those must be few."""
    size = len(letters) ** (2 * flank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if (t := t.as_py()) is not None:
                    _, a, b = _flanks(np.frombuffer(t.encode("utf-32-le"), "<u4"), flank, between, letters)
                    k = a * len(letters) ** flank + b
                    # a short text touches few counts
                    if len(k) < size // 64:
                        np.add.at(count, k, 1)
                    else:
                        count += np.bincount(k, minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["k", "n"])

    return df.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def merge_intervals(df: DataFrame, key: list[str], start: str = "start", stop: str = "stop", hot: int = HOT_KEY) -> DataFrame:
    """Intervals that overlap or touch, merged within each key."""
    if has_large(df, key, hot):
        rows = ranks.carried(df, key, [F.col(start), F.col(stop)], F.col(stop), "_top", "max", True)
        rows = rows.withColumn("_new", F.when(F.col(start) <= F.col("_top"), 0).otherwise(1))
        rows = ranks.running_sum(rows, [*[F.col(k) for k in key], F.col(start), F.col(stop), F.col("_new").desc()], "_new", "_g")
        return rows.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_g")
    w = Window.partitionBy(*key).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return rows.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_g")


def complement(df: DataFrame, key: list[str], low: Column, high: Column, start: str = "start", stop: str = "stop") -> DataFrame:
    """What of [low, high) no interval covers; keys without intervals don't appear."""
    merged = merge_intervals(df, key, start, stop)
    w = Window.partitionBy(*key).orderBy(start)
    gaps = merged.select(*key, F.coalesce(F.lag(stop).over(w), low).alias("a"), F.col(start).alias("b"))
    tail = merged.groupBy(*key).agg(F.max(stop).alias("a")).withColumn("b", high)
    return gaps.unionByName(tail).select(*key, F.greatest("a", low).alias(start), F.least("b", high).alias(stop)).where(F.col(start) < F.col(stop))


def tiles(df: DataFrame, length: str, size: int, stride: int) -> DataFrame:
    """Overlapping windows of each sequence: w, start, stop; one at least, also for an empty sequence."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col(length) / stride))
    rows = df.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("start", F.col("w") * stride).withColumn("stop", F.least(F.col("w") * stride + size, F.col(length).cast("long")))


def last_start(points: DataFrame, intervals: DataFrame, key: list[str], pos: str, carry: list[str], start: str = "start", stop: str = "stop", closed: bool = False, hot: int = HOT_KEY) -> DataFrame:
    """As-of containment: for each point the interval with the greatest start up to it, if that reaches beyond the point.

    One sort-merge pass over points and intervals together; right for intervals that don't nest. Columns of `carry`
    are null where no interval holds the point.
    """
    names = [c for c in points.columns if c not in key]
    a = intervals.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(start).alias("_s"), F.col(stop).alias("_e"), *carry).alias("_iv"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names])
    b = points.select(*key, F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_iv"].dataType).alias("_iv"), *names)
    order = ["_at", "_kind", F.col("_iv").asc_nulls_last()]
    rows = running(a.unionByName(b), key, order, F.col("_iv"), "_held", "last", False, hot).drop("_iv").withColumnRenamed("_held", "_iv").where("_kind = 1")
    inside = (F.col("_at") <= F.col("_iv._e")) if closed else (F.col("_at") < F.col("_iv._e"))
    return rows.select(*key, *names, *[F.when(inside, F.col(f"_iv.{c}")).alias(c) for c in carry])


def placed(rows: DataFrame, runs: DataFrame, key: list[str], ends: dict[str, str]) -> DataFrame:
    """`rows` with, for each position of `ends`, its place among run letters under the given name and that name's _run.

    `runs` has the key, start, stop, joined and run_ix; both are null for a position outside a run.
    """
    for pos, name in ends.items():
        carry = ["start", "joined", "run_ix"]
        of = runs.select(*key, F.col("start").alias("_0"), F.col("stop").alias("_1"), *[F.col(c).alias(f"_{c}") for c in carry])
        got = last_start(rows, of, key, pos, [f"_{c}" for c in carry], "_0", "_1")
        rows = got.select(*rows.columns, (F.col("_joined") + F.col(pos) - F.col("_start")).alias(name), F.col("_run_ix").alias(f"{name}_run"))
    return rows


def bins(start: Column, stop: Column, width: int) -> Column:
    """The bins that [start, stop) touches."""
    return F.sequence(F.floor(start / width), F.floor((stop - 1) / width))


#: Rows of a key's bin that meet in one part; larger bins are dealt into blocks.
BLOCK = 1 << 15


def meeting(df: DataFrame, key: list[str], name: str, width: int, test: Column, block: int = BLOCK) -> DataFrame:
    """Pairs of rows of `df` that pass `test`, by which a must start within b: key, a and b (names), a_start, a_stop, b_start and b_stop.

    A pair meets in the bin of a's start. Where a ends before it starts, `test` may hold although b stops before a starts;
    such a pair meets in the bin of b's stop.

    Pairs are made where rows meet and never shuffled. Rows are dealt out in the same way whatever their number, and no
    side is broadcast. Equal intervals stand on b's side as one row with a list of names, so they are tested once. A bin of
    more than `block` rows is dealt into blocks, and each pair of blocks is a part of its own.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = df.select(*key, name, "start", "stop").dropna()
    binned = lambda x, y: F.explode(F.sequence(F.floor(x / width), F.floor(y / width))).alias("_bin")
    left = rows.select(*key, binned(F.least("start", "stop"), F.col("start")), F.col(name).alias("a"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
    right = rows.select(*key, binned(F.col("start"), F.col("stop")), F.col(name).alias("b"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    at = [*key, "_bin"]
    large = F.broadcast(right.groupBy(*at).count().where(F.col("count") > block).select(*at, F.ceil(F.col("count") / block).alias("_n")))

    def dealt(side: DataFrame, own: str, other: str, *of: str) -> DataFrame:
        n = F.coalesce("_n", F.lit(1).cast("long"))
        side = side.join(large, at, "left").withColumn(own, F.pmod(F.xxhash64(*of), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        return side.drop("_n").repartition(parts, *at, "_p", "_q")

    left = dealt(left, "_p", "_q", "a", "a_start", "a_stop")
    lists = dealt(right, "_q", "_p", "b", "b_start", "b_stop").groupBy(*at, "_p", "_q", "b_start", "b_stop").agg(F.collect_list("b").alias("_b"))
    once = (F.col("a_start") <= F.col("a_stop")) | (F.col("_bin") == F.floor(F.least("a_start", "b_stop") / width))
    pairs = left.join(lists.hint("merge"), [*at, "_p", "_q"]).where(test & once)
    return pairs.select(*key, "a", "a_start", "a_stop", "b_start", "b_stop", F.explode("_b").alias("b"))


def overlap_pairs(df: DataFrame, key: list[str], name: str, width: int, block: int = BLOCK) -> DataFrame:
    """Pairs of intervals of a key that share a position: key, a and b, the lesser name first; those of one name are left out."""
    order = (F.col("b_start") < F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & (F.col("b_stop") <= F.col("a_stop")))
    pairs = meeting(df, key, name, width, (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop")) & order, block)
    # equal intervals meet either way round, others with the later one as a
    same = (F.col("b_start") == F.col("a_start")) & (F.col("b_stop") == F.col("a_stop"))
    return pairs.where((F.col("a") < F.col("b")) | (~same & (F.col("a") > F.col("b")))).select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def containment_pairs(df: DataFrame, key: list[str], name: str, width: int, block: int = BLOCK) -> DataFrame:
    """Pairs of intervals of a key, the first of which lies wholly in the second: key, a and b; those of one name are left out."""
    pairs = meeting(df, key, name, width, (F.col("b_start") <= F.col("a_start")) & (F.col("a_stop") <= F.col("b_stop")), block)
    return pairs.where("a <> b").select(*key, "a", "b")


def containment_join(a: DataFrame, b: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs in which [a_start, a_stop) lies wholly in [b_start, b_stop)."""
    right = b.withColumn("_bin", F.explode(bins(F.col("b_start"), F.col("b_stop"), width)))
    left = a.withColumn("_bin", F.floor(F.col("a_start") / width))
    return left.join(right, [*key, "_bin"]).where("b_start <= a_start and a_stop <= b_stop").drop("_bin")


def sums_within(points: DataFrame, intervals: DataFrame, key: list[str], pos: str, values: dict[str, Column], start: str = "start", stop: str = "stop") -> DataFrame:
    """`intervals` with sums (longs) of `values` over the points of their key in [start, stop); 0 where there is none.

    Points are summed by position, and positions run up in order; an interval takes what stands before its stop less what
    stands before its start, so there is no row for a pair.
    """
    names = list(values)
    at = points.select(*key, F.col(pos).alias("_at"), *[v.alias(c) for c, v in values.items()]).groupBy(*key, "_at").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    bounds = intervals.dropna(subset=key).select(*key, F.explode(F.array(start, stop)).alias("_at")).distinct()
    rows = at.withColumn("_kind", F.lit(1)).unionByName(bounds.select("*", *[F.lit(0).cast("long").alias(c) for c in names], F.lit(0).alias("_kind")))
    # a bound comes before the points at its position
    upto = spool(ranks.running_sums(rows, [*[F.col(k) for k in key], F.col("_at"), F.col("_kind")], names).where("_kind = 0"), "bounds")
    side = lambda c, x: upto.select(*key, F.col("_at").alias(c), *[F.col(f"{n}_upto").alias(f"_{x}{n}") for n in names])
    out = intervals.join(side(start, "a"), [*key, start]).join(side(stop, "b"), [*key, stop])
    return out.select(*intervals.columns, *[(F.col(f"_b{n}") - F.col(f"_a{n}")).alias(n) for n in names])


def first_match(points: DataFrame, intervals: DataFrame, key: list[str], pos: str, name: str, hot: int = HOT_KEY) -> DataFrame:
    """For each point the first interval [b_start, b_stop] (closed) in order of start, stop and name that holds it, else null.

    The first interval that ends at or after a point is the one, if it starts by then: whatever holds the point starts
    no earlier. So only intervals that end after all those before them count, and points look up the next of their ends
    in one sorted pass, without a row for each pair.
    """
    firsts = running(intervals.dropna(subset=key), key, ["b_start", "b_stop", name], F.col("b_stop"), "_top", "max", True, hot).where("_top is null or b_stop > _top")
    a = firsts.select(*key, F.col("b_stop").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("b_start").alias("s"), F.col(name).alias("name")).alias("_iv"), F.lit(None).cast(points.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    b = points.select(*key, F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_iv"].dataType).alias("_iv"), F.struct(*points.columns).alias("_row"))
    rows = running(a.unionByName(b), key, [F.desc("_at"), "_kind"], F.col("_iv"), "_held", "last", False, hot).drop("_iv").withColumnRenamed("_held", "_iv").where("_kind = 1")
    return rows.select("_row.*", F.when(F.col("_iv.s") <= F.col("_at"), F.col("_iv.name")).alias(name))


def blocked_ranges(variants: DataFrame, key: str, relax: int = 128) -> DataFrame:
    """Merged stretches [start, stop) of each key that no cut may fall in: `relax` bases about each variant.

    `variants` has typ, pos and len; a splice site's len is its right end, and exons block nothing.
    """
    end = F.when(F.col("typ") == "deletion", F.col("pos") + F.col("len")).when(F.col("typ") == "splice", F.col("len") + 1).otherwise(F.col("pos") + 1)
    rows = variants.where("typ <> 'exon'").select(key, F.greatest(F.col("pos") - relax - 1, F.lit(0)).cast("long").alias("start"), (end + relax + 1).cast("long").alias("stop"))
    return merge_intervals(rows, [key])


#: Groups that keys are dealt into where a call of Python takes a group: many small keys share one.
GROUPS = 1 << 12


def fragment_cuts(lengths: DataFrame, blocked: DataFrame, key: str, chunk: int) -> DataFrame:
    """key, start, stop: fragments of `chunk` bases, each end pushed past the blocked stretch that it falls in.

    Each end follows from the one before, so a key's merged stretches are walked in order by one task, which is handed
    many small keys at once.
    """
    kind = lengths.schema[key].dataType.simpleString()

    def run(lens: pa.Table, bad: pa.Table) -> pa.Table:
        names = lens.column(key)
        code = pa.chunked_array([*names.chunks, *bad.column(key).chunks], names.type).dictionary_encode("encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
        start, stop = (bad.column(c).to_numpy() for c in ("start", "stop"))
        own, of = code[: len(lens)], code[len(lens) :]
        order = np.lexsort((start, of))
        bounds = np.searchsorted(of[order], np.arange(code.max(initial=-1) + 2))
        at, a_, b_ = [], [], []
        for i, (k, n) in enumerate(zip(own.tolist(), lens.column("length").to_pylist(), strict=True)):
            mine = order[bounds[k] : bounds[k + 1]]
            starts, stops = start[mine].tolist(), stop[mine].tolist()
            a = 0
            while n is not None and a < n:
                b = a + chunk
                j = bisect.bisect_right(starts, b) - 1
                b = int(min(n, stops[j] if j >= 0 and b < stops[j] else b))
                at.append(i)
                a_.append(a)
                b_.append(b)
                a = b
        return pa.table([names.take(pa.array(at, pa.int64())), pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], [key, "start", "stop"])

    # columns of its own for either side, as both may come of one table
    dealt = lambda df, *more: df.select(*[F.col(c).alias(c) for c in (key, *more)], F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group")).groupBy("_group")
    return dealt(lengths, "length").cogroup(dealt(blocked, "start", "stop")).applyInArrow(run, f"{key} {kind}, start long, stop long")


def bad_cuts(cuts: DataFrame, blocked: DataFrame, key: str, width: int) -> DataFrame:
    """Cuts (starts of fragments but the first) that fall in a blocked stretch; empty if the cuts are right."""
    points = cuts.where("start > 0").select(key, F.col("start").alias("a_start"), (F.col("start") + 1).alias("a_stop"))
    return containment_join(points, blocked.select(key, F.col("start").alias("b_start"), F.col("stop").alias("b_stop")), [key], width).select(key, F.col("a_start").alias("cut"))
