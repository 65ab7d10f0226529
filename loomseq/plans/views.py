"""Views of the driver's tables in the shapes of the domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import acgt, acgt_sql


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(spark, sf_dir):
    """Reads at sites: arm, site, base, alt; the fifth event type has no base."""
    e = table(spark, sf_dir, "events")
    base = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "error", "C").when(F.col("event_type") == "purchase", "G").when(F.col("event_type") == "signup", "T")
    rows = e.select((F.col("event_id") % 2).alias("arm"), F.col("user_id").alias("site"), base.alias("base"), F.substring(F.lit("ACGT"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1)).alias("alt"))
    return rows.where(F.col("base").isNotNull())


BASES_SQL = """bases AS (SELECT event_id % 2 AS arm, user_id AS site,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' END AS base,
  substr('ACGT', CAST(user_id % 4 + 1 AS INTEGER), 1) AS alt
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup'))"""


def pileup(spark, sf_dir):
    """arm, site, alt and counts a, c, g, t."""
    return bases(spark, sf_dir).groupBy("arm", "site", "alt").agg(*[F.count_if(F.col("base") == b).cast("long").alias(b.lower()) for b in "ACGT"])


PILEUP_SQL = BASES_SQL + """, pileup AS (SELECT arm, site, alt, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c,
  count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM bases GROUP BY arm, site, alt)"""


def depth(spark, sf_dir):
    """arm, site, alt, n (depth), x (reads of the alternative base)."""
    p = pileup(spark, sf_dir)
    x = F.when(F.col("alt") == "A", F.col("a")).when(F.col("alt") == "C", F.col("c")).when(F.col("alt") == "G", F.col("g")).otherwise(F.col("t"))
    return p.select("arm", "site", "alt", (F.col("a") + F.col("c") + F.col("g") + F.col("t")).alias("n"), x.alias("x"))


DEPTH_SQL = PILEUP_SQL + """, depth AS (SELECT arm, site, alt, a + c + g + t AS n,
  CASE alt WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS x FROM pileup)"""


def matrix(spark, sf_dir):
    """Counts of two arms: arm, gene, cell, cnt."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("arm"), F.col("l_partkey").alias("gene"), (F.col("l_orderkey") % 500).alias("cell"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("arm", "gene", "cell").agg(F.sum("q").alias("cnt"))


MATRIX_SQL = """m AS (SELECT l_linestatus AS arm, l_partkey AS gene, l_orderkey % 500 AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt
  FROM lineitem GROUP BY 1, 2, 3)"""


def genes(spark, sf_dir):
    """Totals of a gene in both arms: gene, f, o (0 where absent)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("gene").agg(*[F.sum(F.when(F.col("l_linestatus") == s, F.col("q")).otherwise(0)).alias(s.lower()) for s in "FO"])


GENES_SQL = """genes AS (SELECT l_partkey AS gene, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS f,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS o FROM lineitem GROUP BY 1)"""


def variants(spark, sf_dir):
    """ix, chrom, pos, typ, len, seq."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderkey") % 10
    return o.select(F.col("o_orderkey").alias("ix"), F.col("o_orderpriority").alias("chrom"), F.expr("o_orderkey div 3").alias("pos"), F.when(d < 7, "single").when(d < 9, "deletion").otherwise("insertion").alias("typ"), F.when(d < 7, 1).when(d < 9, 1 + F.col("o_custkey") % 5).otherwise(1 + F.col("o_custkey") % 3).cast("long").alias("len"), F.substring(F.lit("ACGTACGT"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(3)).alias("seq"))


VARIANTS_SQL = """v AS (SELECT o_orderkey AS ix, o_orderpriority AS chrom, o_orderkey // 3 AS pos,
  CASE WHEN o_orderkey % 10 < 7 THEN 'single' WHEN o_orderkey % 10 < 9 THEN 'deletion' ELSE 'insertion' END AS typ,
  CAST(CASE WHEN o_orderkey % 10 < 7 THEN 1 WHEN o_orderkey % 10 < 9 THEN 1 + o_custkey % 5 ELSE 1 + o_custkey % 3 END AS BIGINT) AS len,
  substr('ACGTACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 3) AS seq FROM orders)"""


def sequences(spark, sf_dir):
    """doc_id and its whole text as bases."""
    return table(spark, sf_dir, "documents").select("doc_id", acgt(F.col("text")).alias("seq"))


SEQUENCES_SQL = f"s AS (SELECT doc_id, {acgt_sql('text')} AS seq FROM documents)"


def turns(spark, sf_dir):
    """key (conversation and turn) and the whole text of a turn as bases."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(key.alias("key"), acgt(F.col("text")).alias("seq"))


TURNS_SQL = f"s AS (SELECT conv_id || '/' || turn AS key, {acgt_sql('text')} AS seq FROM conversations)"


def intervals(spark, sf_dir):
    """Overlapping intervals: key, name, start, stop."""
    o = table(spark, sf_dir, "orders")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400
    return o.select((F.col("o_custkey") % 50).alias("key"), F.col("o_orderkey").alias("name"), F.floor(start).alias("start"), (F.floor(start) + 3 + F.col("o_orderkey") % 20).alias("stop"))


INTERVALS_SQL = """iv AS (SELECT o_custkey % 50 AS key, o_orderkey AS name, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS start,
  CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 3 + o_orderkey % 20 AS stop FROM orders)"""


def points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_partkey") % 50).alias("key"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).alias("p"))


POINTS_SQL = """pt AS (SELECT l_partkey % 50 AS key, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS p FROM lineitem)"""
