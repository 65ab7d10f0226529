"""Sinks: delimited tables, sequence formats and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> None:
    body = F.array_join(F.regexp_extract_all(F.col(seq), F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body)).write.mode("overwrite").text(path)


def fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")).write.mode("overwrite").text(path)


def bed(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"))).write.mode("overwrite").text(path)


def keyed_json(df: DataFrame, path: str, key: list[str], value: str) -> None:
    """One object a row: the key parts joined by |, and the value."""
    df.select(F.to_json(F.create_map(F.concat_ws("|", *key), F.col(value)))).write.mode("overwrite").text(path)


def gtf(df: DataFrame, path: str, source: str = "loomseq") -> None:
    """Rows as `readers.gtf` gives them: chrom, feature, start (0-based), stop, strand, gene."""
    attr = F.concat(F.lit('gene_id "'), "gene", F.lit('"; gene_name "'), "gene", F.lit('";'))
    cols = ["chrom", F.lit(source), "feature", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), attr]
    df.select(F.concat_ws("\t", *cols)).write.mode("overwrite").text(path)
