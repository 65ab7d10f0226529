"""Dedup, predicates, histograms, scrapes, audits and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import pack_text, seconds, unpack_text
from ..operators import ranks
from .views import SEQUENCES_SQL, sequences, table

Q = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def dedup_keep_none(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    once = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'a:0.9,' || CAST(l_discount AS VARCHAR) || '|b:1,.' ELSE 'a:1,.|b:0.5,' || CAST(l_tax AS VARCHAR) END AS freq FROM lineitem)
  SELECT l_orderkey, l_linenumber FROM f WHERE len(list_filter(string_split(freq, '|'), lambda s: len(list_filter(string_split(split_part(s, ':', 2), ',')[2:], lambda x: x <> '.' AND TRY_CAST(x AS DOUBLE) BETWEEN 0.01 AND 0.05)) > 0)) > 0""")
def freq_predicate(spark, d):
    li = table(spark, d, "lineitem")
    freq = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("a:0.9,"), F.col("l_discount").cast("string"), F.lit("|b:1,."))).otherwise(F.concat(F.lit("a:1,.|b:0.5,"), F.col("l_tax").cast("string")))
    common = lambda x: x.try_cast("double").between(0.01, 0.05)
    alt = lambda s: F.exists(F.slice(F.split(F.split_part(s, F.lit(":"), F.lit(2)), ","), F.lit(2), F.length(s)), lambda x: F.coalesce(common(x), F.lit(False)))
    return li.where(F.exists(F.split(freq, "\\|"), alt)).select("l_orderkey", "l_linenumber")


@query("SELECT least(n_chars // 100, 50) AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, "documents").groupBy(F.least(F.expr("n_chars div 100"), F.lit(50).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS gen, CAST(l_partkey AS BIGINT) AS temp, CAST(l_suppkey AS BIGINT) AS nodes, CAST(l_linenumber AS BIGINT) AS ranks FROM lineitem")
def log_scrape(spark, d):
    li = table(spark, d, "lineitem")
    line = F.format_string("Generation %d (%d -> %d nodes, %d ranks)", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    pattern = r"Generation (\d+) \((\d+) -> (\d+) nodes, (\d+) ranks\)"
    return li.select(line.alias("line")).select(*[F.regexp_extract("line", pattern, i + 1).cast("long").alias(c) for i, c in enumerate(("gen", "temp", "nodes", "ranks"))])


@query("SELECT o_orderkey, CAST(o_custkey * 60 + o_orderkey % 60 AS DOUBLE) AS secs FROM orders")
def elapsed_parse(spark, d):
    o = table(spark, d, "orders")
    clock = F.concat_ws(":", F.expr("o_custkey div 60").cast("string"), (F.col("o_custkey") % 60).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    return o.select("o_orderkey", seconds(clock).alias("secs"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT o_custkey, count(*) FILTER (before > o_totalprice) AS descents FROM x GROUP BY o_custkey""")
def md_audit_sorted(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    x = table(spark, d, "orders").select("o_custkey", (F.lag("o_totalprice").over(w) > F.col("o_totalprice")).alias("down"))
    return x.groupBy("o_custkey").agg(F.count_if("down").alias("descents"))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, CAST(a.v AS BIGINT) AS a, CAST(b.v AS BIGINT) AS b FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def full_diff(spark, d):
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    a = li.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("q").alias("a"))
    b = li.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("q").alias("b"))
    return a.join(b, "k", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("k", "a", "b")


@query("SELECT text, count(*) AS n FROM conversations GROUP BY text HAVING count(*) > 1")
def duplicates_check(spark, d):
    return table(spark, d, "conversations").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, replace(seq, 'N', '') AS back FROM s")
def two_bit_round_trip(spark, d):
    s = sequences(spark, d).select("doc_id", F.regexp_replace("seq", "N", "").alias("seq"))
    return s.select("doc_id", unpack_text(pack_text(F.col("seq")), F.length("seq")).alias("back"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean, min(p_size) AS low, max(p_size) AS high, count(*) FILTER (regexp_matches(p_name, '^[a-z]+ [a-z]+')) AS named FROM part GROUP BY p_brand")
def region_stats(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.count_if(F.col("p_name").rlike("^[a-z]+ [a-z]+")).alias("named"))


@query("SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(median(value), 6) AS mid FROM events GROUP BY user_id")
def exact_quantiles(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.median("value").alias("m"))
    return e.select("user_id", "n", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("q3"), F.round("m", 6).alias("mid"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def telemetry_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp").alias("start"), "event_type", "n", "total")


@query("SELECT c_custkey, row_number() OVER (ORDER BY split_part(c_name, '#', 1), CAST(split_part(c_name, '#', 2) AS BIGINT), c_custkey) - 1 AS place FROM customer")
def version_sort(spark, d):
    """Names in natural order: letters as letters, the number after them as a number."""
    c = table(spark, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("a"), F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("long").alias("b"))
    return ranks.row_numbers(c, [F.col("a"), F.col("b"), F.col("c_custkey")], "place").select("c_custkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '/17'), o_orderkey LIMIT 100")
def seeded_sample(spark, d):
    """A hundred orders by the digest of key and seed; the same rows however the table is partitioned."""
    return table(spark, d, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("/17"))), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS want, count(l_orderkey) AS got FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(l_orderkey) <> o_orderkey % 5")
def length_check(spark, d):
    """Where the length that a model declares isn't the one that is found, or none is."""
    got = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("got"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("want")).join(got, "o_orderkey", "left")
    return o.select("o_orderkey", "want", F.coalesce("got", F.lit(0).cast("long")).alias("got")).where("got <> want")
