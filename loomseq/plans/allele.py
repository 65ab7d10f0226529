"""Allele analytics: pileups, fractions, genotypes and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from .views import BASES_SQL, DEPTH_SQL, PILEUP_SQL, bases, depth, pileup

Q = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def both(spark, d):
    """Sites deep enough in both arms: site, n0, x0, n1, x1."""
    p = depth(spark, d)
    return p.groupBy("site").agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}{a}") for a in (0, 1) for c in ("n", "x")]).where("n0 >= 10 and n1 >= 10")


BOTH_SQL = DEPTH_SQL + """, two_arms AS (SELECT site, max(CASE WHEN arm = 0 THEN n END) AS n0, max(CASE WHEN arm = 0 THEN x END) AS x0,
  max(CASE WHEN arm = 1 THEN n END) AS n1, max(CASE WHEN arm = 1 THEN x END) AS x1 FROM depth GROUP BY site
  HAVING max(CASE WHEN arm = 0 THEN n END) >= 10 AND max(CASE WHEN arm = 1 THEN n END) >= 10)"""


@query(f"WITH {PILEUP_SQL} SELECT * FROM pileup")
def pileup_counts(spark, d):
    return pileup(spark, d)


@query(f"WITH {DEPTH_SQL} SELECT arm, round(sum(x) / sum(n), 6) AS pooled, count(*) AS sites FROM depth WHERE n >= 10 GROUP BY arm")
def alt_fraction_pooled(spark, d):
    return depth(spark, d).where("n >= 10").groupBy("arm").agg(F.round(F.sum("x") / F.sum("n"), 6).alias("pooled"), F.count("*").alias("sites"))


@query(f"WITH {DEPTH_SQL} SELECT arm, round(avg(x / n), 6) AS mean_fraction, round(median(x / n), 6) AS median_fraction FROM depth WHERE n >= 10 AND x / n BETWEEN 0.15 AND 0.85 GROUP BY arm")
def alt_fraction_per_site(spark, d):
    f = F.col("x") / F.col("n")
    return depth(spark, d).where(F.col("n") >= 10).where(f.between(0.15, 0.85)).groupBy("arm").agg(F.round(F.avg(f), 6).alias("mean_fraction"), F.round(F.median(f), 6).alias("median_fraction"))


@query(f"""WITH {BASES_SQL}, t AS (SELECT site, alt, base, count(*) AS k FROM bases WHERE base <> alt GROUP BY 1, 2, 3),
  r AS (SELECT site, alt, base, row_number() OVER (PARTITION BY site ORDER BY k DESC, base) AS rn FROM t) SELECT site, alt, base AS ref FROM r WHERE rn = 1""")
def ref_allele_argmax(spark, d):
    p = pileup(spark, d).groupBy("site", "alt").agg(*[F.sum(c).alias(c) for c in "acgt"])
    counts = F.array(*[F.when(F.col("alt") == c.upper(), F.lit(-1).cast("long")).otherwise(F.col(c)) for c in "acgt"])
    ref = F.substring(F.lit("ACGT"), F.array_position(counts, F.array_max(counts)).cast("int"), F.lit(1))
    return p.where(F.array_max(counts) > 0).select("site", "alt", ref.alias("ref"))


CALL_SQL = "CASE WHEN x / n < 0.2 THEN 'hom-ref' WHEN x / n <= 0.4 THEN 'het' ELSE 'hom-alt' END"


def _call(x, n):
    f = F.col(x) / F.col(n)
    return F.when(f < 0.2, "hom-ref").when(f <= 0.4, "het").otherwise("hom-alt")


@query(f"WITH {DEPTH_SQL} SELECT arm, site, {CALL_SQL} AS genotype FROM depth WHERE n >= 10")
def genotype_calls(spark, d):
    return depth(spark, d).where("n >= 10").select("arm", "site", _call("x", "n").alias("genotype"))


@query(f"""WITH {DEPTH_SQL}, c AS (SELECT arm, site, {CALL_SQL} AS g FROM depth WHERE n >= 10)
  SELECT a.g AS g0, b.g AS g1, count(*) AS sites FROM c a JOIN c b ON a.site = b.site AND a.arm = 0 AND b.arm = 1 GROUP BY 1, 2""")
def genotype_confusion(spark, d):
    return both(spark, d).select(_call("x0", "n0").alias("g0"), _call("x1", "n1").alias("g1")).groupBy("g0", "g1").agg(F.count("*").alias("sites"))


SIGN_SQL = "count(*) FILTER (x1 / n1 > x0 / n0) AS up, count(*) FILTER (x1 / n1 < x0 / n0) AS down"


@query(f"WITH {BOTH_SQL}, u AS (SELECT {SIGN_SQL} FROM two_arms) SELECT up, down, round(CASE WHEN up + down > 0 THEN (up - (up + down) / 2) / sqrt((up + down) / 4) ELSE 0.0 END, 6) AS z FROM u")
def paired_sign_test(spark, d):
    diff = F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0")
    u = both(spark, d).agg(F.count_if(diff > 0).alias("up"), F.count_if(diff < 0).alias("down"))
    return u.select("up", "down", F.round(ranks.sign_z(F.col("up"), F.col("down")), 6).alias("z"))


@query(f"""WITH {BOTH_SQL}, u AS (SELECT count(*) FILTER (x0 / n0 >= 0.25 AND x1 / n1 < 0.25) AS lost, count(*) FILTER (x0 / n0 < 0.25 AND x1 / n1 >= 0.25) AS gained FROM two_arms)
  SELECT lost, gained, round(CASE WHEN lost + gained > 0 THEN power(abs(lost - gained) - 1, 2) / (lost + gained) ELSE 0.0 END, 6) AS chi2 FROM u""")
def mcnemar(spark, d):
    a, b = F.col("x0") / F.col("n0") >= 0.25, F.col("x1") / F.col("n1") >= 0.25
    u = both(spark, d).agg(F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"))
    return u.select("lost", "gained", F.round(ranks.mcnemar(F.col("lost"), F.col("gained")), 6).alias("chi2"))


@query(f"""WITH {DEPTH_SQL} SELECT arm, site, round(((x / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
  round(((x / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM depth""")
def wilson_ci(spark, d):
    low, high = ranks.wilson(F.col("x"), F.col("n"))
    return depth(spark, d).select("arm", "site", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {DEPTH_SQL} SELECT arm, site, round(x / n - 1.96 * sqrt(x / n * (1 - x / n) / n), 6) AS low, round(x / n + 1.96 * sqrt(x / n * (1 - x / n) / n), 6) AS high FROM depth""")
def wald_ci(spark, d):
    low, high = ranks.wald(F.col("x"), F.col("n"))
    return depth(spark, d).select("arm", "site", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {DEPTH_SQL}, p AS (SELECT arm, site, 1 / (1 + x) AS p FROM depth), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)
  SELECT arm, site, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_adjust(spark, d):
    rows = depth(spark, d).select("arm", "site", (1 / (1 + F.col("x"))).alias("p"))
    return ranks.benjamini_hochberg(rows, "p", "q").select("arm", "site", F.round("q", 6).alias("q"))


@query(f"""WITH {DEPTH_SQL}, k AS (SELECT arm, site, n, least(x, n - x) AS m FROM depth), t AS (SELECT arm, site, n, m, unnest(range(0, m + 1)) AS i FROM k)
  SELECT arm, site, round(least(1.0, 2 * sum(exp(CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END + n * ln(0.5)))), 6) AS p FROM t GROUP BY arm, site""")
def binom_two_sided(spark, d):
    return depth(spark, d).select("arm", "site", F.round(ranks.binomial_two_sided(F.col("x"), F.col("n")), 6).alias("p"))


@query(f"""WITH {BOTH_SQL} SELECT CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = two_arms.site AND c.c_nationkey < 12) THEN 'in' ELSE 'out' END AS stratum,
  count(*) AS sites, round(sum(x0) / sum(n0), 6) AS f0, round(sum(x1) / sum(n1), 6) AS f1 FROM two_arms GROUP BY 1""")
def semi_anti_strata(spark, d):
    index = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey < 12").select(F.col("c_custkey").alias("site"))
    rows = both(spark, d)
    rows = rows.join(index, "site", "left_semi").withColumn("stratum", F.lit("in")).unionByName(rows.join(index, "site", "left_anti").withColumn("stratum", F.lit("out")))
    return rows.groupBy("stratum").agg(F.count("*").alias("sites"), F.round(F.sum("x0") / F.sum("n0"), 6).alias("f0"), F.round(F.sum("x1") / F.sum("n1"), 6).alias("f1"))


@query(f"""WITH {DEPTH_SQL}, h AS (SELECT arm, site, n, CASE WHEN site % 3 = 0 THEN n - x ELSE x END AS h FROM depth), j AS (SELECT h.*, c.c_nationkey AS gene FROM h JOIN customer c ON c.c_custkey = h.site)
  SELECT arm, gene, count(*) AS sites, round(sum(h) / sum(n), 6) AS fraction FROM j GROUP BY 1, 2 HAVING sum(n) >= 50""")
def phased_hap_fraction(spark, d):
    genes = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("gene"))
    rows = depth(spark, d).withColumn("h", F.when(F.col("site") % 3 == 0, F.col("n") - F.col("x")).otherwise(F.col("x"))).join(genes, "site")
    return rows.groupBy("arm", "gene").agg(F.count("*").alias("sites"), F.round(F.sum("h") / F.sum("n"), 6).alias("fraction"), F.sum("n").alias("reads")).where("reads >= 50").drop("reads")


@query("""SELECT user_id, count(*) FILTER (event_id & 4 = 0) AS mapped, count(*) FILTER (event_id & 256 <> 0) AS secondary, count(*) FILTER (event_id & 4 = 0 AND event_id & 2304 = 0) AS primary_reads,
  round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM events GROUP BY user_id""")
def tag_filter_count(spark, d):
    bit = lambda n: F.col("event_id").bitwiseAND(F.lit(n).cast("long")) == 0
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id").agg(F.count_if(bit(4)).alias("mapped"), F.count_if(~bit(256)).alias("secondary"), F.count_if(bit(4) & bit(2304)).alias("primary_reads"), F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6).alias("high_share"))


@query()
def depth_matching(spark, d):
    """Each site's deeper arm thinned to the depth of the other, for five seeds: the share of sites that change sides."""
    rows = both(spark, d).withColumn("depth", F.least("n0", "n1"))
    rows = ranks.depth_matched(rows, ["site"], "x0", "n0", "depth").select("site", "seed", "depth", "x1", "n1", F.col("drawn").alias("m0"))
    return rows.groupBy("seed").agg(F.count("*").alias("sites"), F.round(F.sum("m0") / F.sum("depth"), 6).alias("matched"), F.round(F.sum("x1") / F.sum("n1"), 6).alias("other"))


@query()
def sign_test_p(spark, d):
    """The sign test by site group with its p; erfc is beyond the SQL."""
    diff = F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0")
    u = both(spark, d).groupBy((F.col("site") % 7).alias("grp")).agg(F.count_if(diff > 0).alias("up"), F.count_if(diff < 0).alias("down"))
    return u.select("grp", "up", "down", ranks.sign_p(F.col("up"), F.col("down")).alias("p"))
