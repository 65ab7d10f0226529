"""The largest evenly spaced choice of a window's variants that fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, spool


def evenly(n: int, k: int) -> list[int]:
    """Which of n items k evenly spaced ones are."""
    k = min(n, k)
    return [i * n // k for i in range(k)]


def largest_fit(n: int, fits: Callable[[int], bool]) -> int:
    """All n if they fit, else the k that halving between none (which always fits) and n arrives at."""
    if fits(n):
        return n
    low, high = 0, n
    while high > low + 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def thin(df: DataFrame, key: list[str], order: list[str], cost: Callable[[pd.DataFrame], float], budget: float) -> DataFrame:
    """The rows of each window (`key`) that are kept: evenly spaced in `order`, as many as cost no more than `budget`.

    A window is bounded, so a task holds it; windows are dealt out by their keys. `cost` may be anything and is called for
    each choice of each window; where it is a sum, `thin_sums` decides many windows at once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        k = largest_fit(len(rows), lambda k: cost(rows.iloc[evenly(len(rows), k)]) <= budget)
        return rows.iloc[evenly(len(rows), k)]

    return df.groupBy(*key).applyInPandas(run, df.schema)


def _places(size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows k evenly spaced ones of each window are, windows of `size` rows standing one after another; and where each window's begin."""
    begin = np.cumsum(k) - k
    i = np.arange(k.sum()) - np.repeat(begin, k)
    return np.repeat(np.cumsum(size) - size, k) + i * np.repeat(size, k) // np.repeat(k, k), begin


def largest_sums(cost: np.ndarray, known: np.ndarray, size: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`largest_fit` of windows that stand one after another, decided together round by round, where a choice costs the sum of its rows.

    Unknown costs add nothing; a choice of unknown costs alone neither fits nor counts as too large, so its window's search
    ends there. Beside the numbers that fit, the sums of whole windows come back and how many of their costs are known.
    """
    cost = np.where(known, cost, 0)
    begin = np.cumsum(size) - size
    whole, some = np.add.reduceat(cost, begin), np.add.reduceat(known.astype(np.int64), begin)
    low, high = np.zeros_like(size), size.copy()
    fits = (some > 0) & (whole <= budget)
    low[fits] = size[fits]
    open_ = ~fits
    while len(at := np.flatnonzero(open_ & (high > low + 1))):
        mid = np.zeros_like(size)
        mid[at] = (low[at] + high[at]) // 2
        place, first = _places(size, mid)
        sums, any_ = np.add.reduceat(cost[place], first[at]), np.add.reduceat(known[place].astype(np.int64), first[at])
        open_[at[any_ == 0]] = False
        good = (any_ > 0) & (sums <= budget)
        low[at[good]] = mid[at[good]]
        bad = at[(any_ > 0) & ~good]
        high[bad] = mid[bad]
    return low, whole, some


def _windows(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole windows, by their first `key` columns, with the windows' sizes."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if len(held) < 2:
            continue
        codes = [c.combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in held.columns[:key]]
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
        if len(ends):
            yield held.slice(0, ends[-1]), np.diff(ends, prepend=0)
            held = held.slice(ends[-1])
    if held is not None and len(held):
        yield held, np.array([len(held)])


def _decided(df: DataFrame, key: list[str], order: list[str], cost: str, budget: float, of: Callable[[pa.Table, np.ndarray, np.ndarray, pa.Array], pa.Table], schema: str) -> DataFrame:
    """What `of` makes of windows, their sizes, the numbers of rows that fit and the whole costs; a task has its windows in order."""
    names = [*key, cost, *(c for c in df.columns if c not in key and c != cost)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size in _windows(batches, len(key)):
            c = rows.column(cost)
            k, whole, some = largest_sums(c.fill_null(0).to_numpy(), c.is_valid().to_numpy(), size, budget)
            yield from of(rows, size, k, pa.array(whole, mask=some == 0)).to_batches()

    return df.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def thin_sums(df: DataFrame, key: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """`thin` where a choice costs the sum of the column `cost` (longs), many windows at a time; rows without a window (a null key) are left out."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*key, cost, *(c for c in df.columns if c not in key and c != cost)]
    kept = _decided(df.dropna(subset=key), key, order, cost, budget, lambda rows, size, k, whole: rows.take(pa.array(_places(size, k)[0])), ", ".join(f"`{c}` {fields[c]}" for c in names))
    return kept.select(*df.columns)


def fitting(df: DataFrame, key: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """A row a window: its key, n (rows), cost of all (null where none is known) and kept, the number of rows that `thin_sums` keeps of it."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def of(rows: pa.Table, size: np.ndarray, k: np.ndarray, whole: pa.Array) -> pa.Table:
        at = rows.select(key).take(pa.array(np.cumsum(size) - size))
        return pa.table([*at.columns, pa.array(size), whole, pa.array(k)], [*key, "n", "cost", "kept"])

    rows = _decided(df.select(*dict.fromkeys([*key, *order, cost])), key, order, cost, budget, of, ", ".join([*(f"`{c}` {fields[c]}" for c in key), "n long, cost long, kept long"]))
    known = F.concat(*[F.col(c).cast("string") for c in key]).isNotNull()
    return rows.withColumn("kept", F.when(known, F.col("kept")).otherwise(0))


def search(df: DataFrame, key: str, order: list[str], too_large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of each window that are kept, where what fits is decided for all open windows together, round by round.

    `too_large` gets chosen rows and returns the keys of windows that they are too large for. A window that fits whole is
    settled at once; the others halve between none, which fits, and all, as `largest_fit` does. Each round is one table of
    a row a window, and a window of n rows takes as many rounds as n has bits. A window's rows are few, so they are
    numbered within it.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = spool(df.withColumn("_i", place), "window_rows")
    state = spool(rows.groupBy(key).agg(F.count("*").alias("_n")).select(key, "_n", F.lit(0).cast("long").alias("_low"), (F.col("_n") + 1).alias("_high"), F.col("_n").alias("_cur")), "state")

    def chosen(at: DataFrame) -> DataFrame:
        picked = at.where("_cur > 0").select(key, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cur") - 1), lambda i: F.floor(i * F.col("_n") / F.col("_cur")))).alias("_i"))
        return rows.join(picked, [key, "_i"]).drop("_i")

    while True:
        # all rows are tried first, which is why high begins beyond them
        open_ = state.where("_cur > _low and _cur < _high")
        if not open_.limit(1).count():
            return chosen(state.withColumn("_cur", F.col("_low")))
        bad = too_large(chosen(open_)).select(key, F.lit(True).alias("_bad")).distinct()
        tried = (F.col("_cur") > F.col("_low")) & (F.col("_cur") < F.col("_high"))
        bad_ = tried & F.coalesce("_bad", F.lit(False))
        low, high = F.when(tried & ~bad_, F.col("_cur")).otherwise(F.col("_low")), F.when(bad_, F.col("_cur")).otherwise(F.col("_high"))
        next_ = state.join(bad, key, "left").select(key, "_n", low.alias("_low"), high.alias("_high")).withColumn("_cur", F.floor((F.col("_low") + F.col("_high")) / 2))
        old, state = state, spool(next_, "state")
        forget(old)
