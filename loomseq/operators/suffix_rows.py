"""Suffix order of long texts with a row for each position: a text is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, spool
from .graph import from_first
from .ranks import codes_of

#: Letters of a tile, rows that a part should hold, and the bits of a rank below its part's number.
TILE, PART_ROWS, PART_BITS = 1 << 20, 1 << 20, 33


def tiles(df: DataFrame, key: str, text: str, end: str, more: int, size: int = TILE) -> DataFrame:
    """key, start, n (letters that are the tile's own), tile: stretches of text and end, with a letter before and `more` after.

    The first tile has the end before it. Texts of one byte a letter are cut as bytes, which needs no scan to the place.
    """
    full = df.where(F.col(text).isNotNull()).select(key, F.concat(F.col(text), F.lit(end)).alias("_t"))
    full = full.select(key, "_t", F.length("_t").cast("long").alias("_n"), (F.octet_length("_t") == F.length("_t")).alias("_bytes"))
    rows = full.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(size).cast("long"))).alias("start"))
    a = F.greatest(F.col("start"), F.lit(1)).cast("int")  # 1-based place of the letter before
    n = (F.least(F.col("start") + size + more, F.col("_n")) + 1 - a).cast("int")
    cut = F.when(F.col("_bytes"), F.substr(F.col("_t").cast("binary"), a, n).cast("string")).otherwise(F.substr("_t", a, n))
    tile = F.when(F.col("start") == 0, F.concat(F.lit(end), cut)).otherwise(cut)
    return rows.select(key, "start", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("start")).alias("n"), tile.alias("tile"))


def alphabet(cut: DataFrame) -> str:
    """The letters of all tiles in order; the driver sees distinct letters only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen |= set(t)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["letter"])

    return "".join(sorted(r[0] for r in cut.select("tile").mapInArrow(run, "letter string").distinct().collect()))


def ordered(df: DataFrame, key: str, text: str, end: str, letters: str | None = None, parts: int = 0, tile: int = TILE) -> DataFrame:
    """key, row (place in order), pos and bwt of all suffixes of text and `end`, as `index.suffixes` gives them.

    Positions are ranked by as many letters as fit 62 bits, in ranges over all keys. Where several share a rank, those
    alone look up the rank of the position so many letters on, and their group is ranked again within its part; letters
    double each round. A rank is its part and the place of its group there, so it changes within its group only, and
    every round is one written table of the positions that are still open.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    symbols = "".join(sorted({*letters, end})) if letters is not None else None
    if symbols is None:
        symbols = "".join(sorted({*alphabet(tiles(df, key, text, end, 0, tile)), end}))
    bits = len(symbols).bit_length()
    step = 62 // bits
    lut = np.zeros(max(map(ord, symbols)) + 1, np.int64)
    lut[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
    cut = tiles(df, key, text, end, step - 1, tile)
    size = df.where(F.col(text).isNotNull()).agg(F.coalesce(F.sum(F.length(text) + 1), F.lit(0))).first()[0]
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_ROWS)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (start, own, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                at = lut[np.frombuffer(t.encode("utf-32-le"), "<u4")]
                padded = np.concatenate([at[1:], np.zeros(step, np.int64)])
                code = np.zeros(own, np.int64)
                for j in range(step):
                    code = code << bits | padded[j : j + own]
                for a in range(0, own, 1 << 16):
                    b = min(own, a + (1 << 16))
                    names = batch.column(0).take(pa.array(np.full(b - a, i)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(start + a, start + b)), pa.array(code[a:b]), pa.array(at[a:b].astype(np.int32))], [key, "pos", "code", "before"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = TaskContext.get().partitionId()
        name, code = codes_of(table.column(key)), table.column("code").to_numpy()
        order = np.lexsort((code, name))
        name, code = name[order], code[order]
        head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (code[1:] != code[:-1])])
        count = np.diff(np.r_[head, len(code)])
        rank = np.repeat(head, count) + (part << PART_BITS)
        table = table.select([key, "pos", "before"]).take(pa.array(order))
        table = table.append_column("rank", pa.array(rank)).append_column("part", pa.array(np.full(len(rank), part, np.int32))).append_column("open", pa.array(np.repeat(count > 1, count)))
        yield from table.to_batches(max_chunksize=1 << 16)

    def again(table: pa.Table) -> pa.Table:
        rank, on = table.column("rank").to_numpy(), table.column("on").to_numpy()
        order = np.lexsort((on, rank))
        rank, on = rank[order], on[order]
        group = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        head = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (on[1:] != on[:-1])])
        count = np.diff(np.r_[head, len(rank)])
        base = np.repeat(group, np.diff(np.r_[group, len(rank)]))
        new = rank + np.repeat(head, count) - base
        table = table.select([key, "pos", "before"]).take(pa.array(order))
        return table.append_column("rank", pa.array(new)).append_column("part", pa.array((new >> PART_BITS).astype(np.int32))).append_column("open", pa.array(np.repeat(count > 1, count)))

    schema = f"{key} {kind}, pos long, before int, rank long, part int, open boolean"
    rows = cut.repartition(n, key, "start").mapInArrow(positions, f"{key} {kind}, pos long, code long, before int")
    last = spool(rows.repartitionByRange(n, key, "code").mapInArrow(first, schema), "suffixes")
    written, settled, reach = [last], last.where("not open"), step
    while last.where("open").limit(1).count():
        open_ = last.where("open")
        ahead = settled.unionByName(open_).select(key, F.col("pos").alias("_at"), F.col("rank").alias("on"))
        looked = open_.select(key, "pos", "before", "rank", "part", (F.col("pos") + reach).alias("_at")).join(ahead, [key, "_at"])
        last = spool(looked.select(key, "pos", "before", "rank", "part", "on").groupBy("part").applyInArrow(again, schema), "suffixes")
        written.append(last)
        settled, reach = settled.unionByName(last.where("not open")), 2 * reach
    total, offsets = 0, {}
    for r in settled.groupBy("part").count().orderBy("part").collect():
        offsets[r["part"]] = total
        total += r["count"]
    text_of = ",".join(str(offsets.get(p, 0)) for p in range(max(offsets, default=0) + 1))
    before = F.get(F.split(F.lit(text_of), ",").cast("array<long>"), F.col("part"))
    out = settled.select(key, (before + F.col("rank").bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias("row"), "pos", F.substring(F.lit(symbols), F.col("before"), F.lit(1)).alias("bwt"))
    out = spool(from_first(out, key, "row").select(key, "row", "pos", "bwt"), "ordered")
    forget(*written)
    return out
