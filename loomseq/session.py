"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def spool(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written under spark.checkpoint.dir and read back.

    A temporary folder stands in where that is unset, on a local master only: elsewhere executors would write to disks
    that others can't read, so it is an error.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomseq-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes spooled tables that nothing will read again."""
    for t in tables:
        folder = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.spooled)
        folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@cache
def code_digest() -> str:
    """A digest of the library's own source, without the subpackage that nothing here imports."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = hashlib.sha256()
    for folder, names, files in sorted(os.walk(root)):
        names[:] = [n for n in names if n not in ("llm", "__pycache__")]
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(folder, f), "rb") as source:
                    out.update(f.encode() + b"\0" + source.read())
    return out.hexdigest()


#: Called with the name of each boundary that a build passes; a test lets it raise where the build is to break off.
on_boundary: list[Callable[[str], None]] = []


def boundary(name: str) -> None:
    for call in on_boundary:
        call(name)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stage(spark: SparkSession, root: str, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A stage that is resumed: `build()` written under `root`, or what an earlier run with equal `inputs` finished.

    The folder is named by the stage and a digest of its inputs and of this library's code, so that neither other inputs
    nor other code meet an old table. Only a job that ended commits its _SUCCESS mark, so what a lost driver left half
    written is built again. The boundaries of a stage are its name with :begin, :written and :end.
    """
    digest = hashlib.sha256("\0".join([name, code_digest(), *inputs]).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{digest}"
    boundary(f"{name}:begin")
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
        boundary(f"{name}:written")
    out = spark.read.parquet(path)
    out.spooled = path
    boundary(f"{name}:end")
    return out


def finished(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a build's folder: stage, digest and time (ms) of all stages that ended, in the order in which they did."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for f in fs.listStatus(folder) if fs.exists(folder) else []:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")
        if fs.exists(mark):
            name, _, digest = f.getPath().getName().rpartition("-")
            rows.append((name, digest, fs.getFileStatus(mark).getModificationTime()))
    return spark.createDataFrame(rows, "stage string, digest string, ended long").orderBy("ended", "stage")


def require(df: DataFrame, what: str) -> DataFrame:
    """`df`, or an error that names what is missing where it has no rows: a gate between stages."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df
