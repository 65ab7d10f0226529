"""A corpus from documents: quality rules, near-duplicates, repeated passages, personal data, packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import pack, pii, quality, simhash, substring
from loomseq.llm.common import rows_with, written


def _tag(*more: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null ids and repeated rows are judged like any other."""
    lang = F.when(F.col("lang").isin(list(quality.COMMON)), F.col("lang")).otherwise("") if "lang" in docs.columns else F.lit("")
    bad = quality.judge(docs).where("not kept").select(F.col("doc_id").alias("id2"), F.col("tag").alias("tag2"))
    rows = rows_with(docs, id=F.col("doc_id"), tag=_tag(lang))
    return rows.join(bad, rows["id"].eqNullSafe(bad["id2"]) & (rows["tag"] == bad["tag2"]), "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (alike by 0.8 or more in five-word shingles) the first document by id and text.

    Documents without an id have nothing to be chosen by and stay. Rows that repeat an id and its text are one document:
    one stays. Rows with one id but other texts are documents of their own.
    """
    kept = simhash.similar(docs).where("doc_id = component_id and tag = first").select(F.col("doc_id").alias("id2"), F.col("tag").alias("tag2")).distinct()
    rows = rows_with(docs, id=F.col("doc_id"), tag=_tag())
    found = rows.join(kept, (rows["id"] == kept["id2"]) & (rows["tag"] == kept["tag2"]), "left_semi").dropDuplicates(["id", "tag"])
    return found.unionByName(rows.where("id is null")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word passages that an earlier document has; documents stay, even if empty."""
    cut = substring.substring_dedup(docs, texts=True).where("n_removed > 0").select(F.col("doc_id").alias("id2"), F.col("tag").alias("tag2"), F.col("kept_text").alias("left"))
    cut = cut.dropDuplicates(["id2", "tag2"])
    rows = rows_with(docs, id=F.col("doc_id"), tag=_tag())
    return _with_text(rows.join(cut, rows["id"].eqNullSafe(cut["id2"]) & (rows["tag"] == cut["tag2"]), "left"), F.coalesce("left", "row.text"))


def _with_text(rows: DataFrame, text: Column) -> DataFrame:
    """The whole rows with another text and, where they have that column, its length."""
    row = F.col("row").withField("text", text)
    if "n_chars" in rows.schema["row"].dataType.names:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return rows.select(row.alias("row")).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _with_text(rows_with(pii.redact(docs)), F.col("row.text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints of 64-bit hashes, bootstrapped patterns and byte-pair merges are beyond SQL.
ORACLE_SQL = None
