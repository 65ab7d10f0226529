"""Helpers that the operators share: the scratch folder, written tables, range buckets, row keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together.
CHUNK_BYTES = 1 << 20

_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing a temporary folder stands in, on a local master only: elsewhere executors would write to
    disks that others can't read, so it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="loomseq-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = root = f"{base.rstrip('/')}/loomseq-{uuid.uuid4().hex[:12]}"
        atexit.register(lambda: remove(spark, root))
    return _roots[app]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; nothing happens if it is gone or the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the scratch folder: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.written_path)


def rows_with(docs: DataFrame, **more: Column) -> DataFrame:
    """`docs` with each row whole in one column, `row`, beside `more`: names of `docs` and of `more` can't clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ranges:
    """Cuts of an integer column into about equal ranges, numbered upwards; nulls have the first numbers.

    A key so frequent that it fills several ranges gets that many, and its rows are dealt out among them by `spread`, a
    column of shares from 0 to 1. So no key, and no null, is bound to one range.
    """

    def __init__(self, df: DataFrame, key: str, n: int):
        of = F.col(key).cast("long")
        got = df.agg(F.count("*").alias("n"), F.count_if(of.isNull()).alias("nulls"), F.percentile_approx(of, [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first()
        self.nulls = -(-n * got["nulls"] // got["n"]) if got["nulls"] else 0
        cuts = (got["q"] or []) if n > 1 else []
        self.bounds = sorted(set(cuts))
        self.shares = [cuts.count(b) for b in self.bounds]
        self.count = self.nulls + sum(self.shares) + 1

    def number(self, key: Column, spread: Column) -> Column:
        """The range of a row, found in two steps of about sqrt(n) comparisons."""
        deal = lambda n: F.least((spread * n).cast("int"), n - 1)
        null = deal(F.lit(self.nulls)) if self.nulls else F.lit(0)
        if not self.bounds:
            return F.when(key.isNull(), null).otherwise(F.lit(self.nulls)).cast("int")
        step = max(1, int(len(self.bounds) ** 0.5))
        rows = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        row = F.size(F.filter(longs(r[-1] for r in rows), lambda b: b < key))
        inner = F.coalesce(F.size(F.filter(F.get(F.array(*[longs(r) for r in rows]), row), lambda b: b < key)), F.lit(0))
        place = F.least(row * step + F.greatest(inner, F.lit(0)), F.lit(len(self.bounds)))  # bounds below the key
        before = [sum(self.shares[:i]) for i in range(len(self.bounds) + 1)]
        own = F.coalesce(F.get(F.array(*map(F.lit, self.shares)), place), F.lit(1))
        hot = F.get(longs(self.bounds), place) == key
        base = F.get(F.array(*map(F.lit, before)), place)
        return F.when(key.isNull(), null).otherwise(self.nulls + base + F.when(F.coalesce(hot, F.lit(False)), deal(own)).otherwise(0)).cast("int")


def chunks(sizes: list[int], most: int = CHUNK_BYTES):
    """Slices of consecutive rows with about `most` bytes together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about `most` bytes of text together, and their texts: only one slice is unpacked at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in chunks(sizes, most):
        part = batch.slice(a, b - a)
        yield part, part.column(column).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer over unsigned 64-bit values, so that low and high bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
