"""Count-matrix concordance and contrasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks
from .views import GENES_SQL, MATRIX_SQL, genes, matrix, table

Q = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {MATRIX_SQL}, {GENES_SQL}, c AS (SELECT cell, count(*) FILTER (arm = 'F') > 0 AS f, count(*) FILTER (arm = 'O') > 0 AS o FROM m GROUP BY cell),
  j AS (SELECT count(*) FILTER (f AND o) AS shared, count(*) AS cells FROM c),
  g AS (SELECT count(*) AS n, round(corr(ln(1 + f), ln(1 + o)), 6) AS pearson, round(avg(CASE WHEN abs(log2((f + 1) / (o + 1))) < 1 THEN 1.0 ELSE 0.0 END), 6) AS within_2x FROM genes WHERE f > 0 AND o > 0)
  SELECT shared, cells, round(shared / cells, 6) AS jaccard, n AS genes, pearson, within_2x FROM j, g""")
def matrix_concordance(spark, d):
    cells = matrix(spark, d).groupBy("cell").agg((F.count_if(F.col("arm") == "F") > 0).alias("f"), (F.count_if(F.col("arm") == "O") > 0).alias("o"))
    j = cells.agg(F.count_if(F.col("f") & F.col("o")).alias("shared"), F.count("*").alias("cells"))
    near = F.abs(F.log2((F.col("f") + 1) / (F.col("o") + 1))) < 1
    g = genes(spark, d).where("f > 0 and o > 0").agg(F.count("*").alias("genes"), F.round(F.corr(F.log1p("f"), F.log1p("o")), 6).alias("pearson"), F.round(F.avg(F.when(near, 1.0).otherwise(0.0)), 6).alias("within_2x"))
    # two rows of totals
    return j.withColumn("k", F.lit(1)).join(g.withColumn("k", F.lit(1)), "k").select("shared", "cells", F.round(F.col("shared") / F.col("cells"), 6).alias("jaccard"), "genes", "pearson", "within_2x")


@query(f"""WITH {GENES_SQL}, r AS (SELECT gene, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS rf, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2 AS ro FROM genes)
  SELECT round(corr(rf, ro), 6) AS spearman, count(*) AS genes FROM r""")
def spearman_genes(spark, d):
    rows = ranks.average_ranks(ranks.average_ranks(genes(spark, d), [], "f", "rf"), [], "o", "ro")
    return rows.agg(F.round(F.corr("rf", "ro"), 6).alias("spearman"), F.count("*").alias("genes"))


@query(f"""WITH {GENES_SQL}, l AS (SELECT gene, f, o, log2((f + 1) / (o + 1)) AS lr FROM genes WHERE f + o >= 50), h AS (SELECT 'high' AS side, * FROM l ORDER BY lr DESC, gene LIMIT 15), w AS (SELECT 'low' AS side, * FROM l ORDER BY lr, gene LIMIT 15)
  SELECT side, gene, f, o, round(lr, 6) AS lr FROM (SELECT * FROM h UNION ALL SELECT * FROM w)""")
def topk_disagreement(spark, d):
    rows = genes(spark, d).where("f + o >= 50").withColumn("lr", F.log2((F.col("f") + 1) / (F.col("o") + 1)))
    high = rows.orderBy(F.desc("lr"), "gene").limit(15).withColumn("side", F.lit("high"))
    low = rows.orderBy("lr", "gene").limit(15).withColumn("side", F.lit("low"))
    return high.unionByName(low).select("side", "gene", "f", "o", F.round("lr", 6).alias("lr"))


@query(f"""WITH {GENES_SQL}, t AS (SELECT sum(f) / sum(o) AS norm FROM genes) SELECT gene, round(f / o / norm, 6) AS ratio FROM genes, t WHERE o >= 20""")
def normalised_ratio(spark, d):
    rows = genes(spark, d)
    total = rows.agg((F.sum("f") / F.sum("o")).alias("norm")).withColumn("k", F.lit(1))
    return rows.where("o >= 20").withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("gene", F.round(F.col("f") / F.col("o") / F.col("norm"), 6).alias("ratio"))


@query(f"""WITH {GENES_SQL}, x AS (SELECT coalesce(p_type, 'other') AS biotype, f - o AS delta FROM genes LEFT JOIN part ON p_partkey = gene)
  SELECT biotype, count(*) AS n, count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down, CAST(sum(delta) AS BIGINT) AS net, CAST(sum(abs(delta)) AS BIGINT) AS moved FROM x GROUP BY biotype""")
def gene_delta_by_biotype(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("biotype"))
    x = genes(spark, d).join(part, "gene", "left").select(F.coalesce("biotype", F.lit("other")).alias("biotype"), (F.col("f") - F.col("o")).alias("delta"))
    return x.groupBy("biotype").agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.sum("delta").alias("net"), F.sum(F.abs("delta")).alias("moved"))


@query(f"""WITH {GENES_SQL}, x AS (SELECT gene, abs(f - o) AS a, row_number() OVER (ORDER BY abs(f - o) DESC, gene) AS rn FROM genes)
  SELECT CAST(sum(a) AS BIGINT) AS total, round(sum(CASE WHEN rn <= 10 THEN a ELSE 0 END) / sum(a), 6) AS top10, round(sum(CASE WHEN rn <= 50 THEN a ELSE 0 END) / sum(a), 6) AS top50 FROM x""")
def delta_concentration(spark, d):
    x = genes(spark, d).select("gene", F.abs(F.col("f") - F.col("o")).alias("a"))
    total = x.agg(F.sum("a").alias("total")).withColumn("k", F.lit(1))
    top = x.orderBy(F.desc("a"), "gene").limit(50).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("a"), "gene")))  # 50 rows
    top = top.agg(F.sum(F.when(F.col("rn") <= 10, F.col("a"))).alias("t10"), F.sum("a").alias("t50")).withColumn("k", F.lit(1))
    return total.join(top, "k").select("total", F.round(F.col("t10") / F.col("total"), 6).alias("top10"), F.round(F.col("t50") / F.col("total"), 6).alias("top50"))


@query(f"""WITH {GENES_SQL}, l AS (SELECT gene, log2((f + 1) / (o + 1)) AS lr FROM genes WHERE f + o > 0)
  SELECT gene, round(100 * (1 - (row_number() OVER (ORDER BY lr DESC, gene) - 1) / (SELECT count(*) FROM l)), 6) AS pct FROM l""")
def percentile_rank_genes(spark, d):
    rows = genes(spark, d).where("f + o > 0").withColumn("lr", F.log2((F.col("f") + 1) / (F.col("o") + 1))).select("gene", "lr")
    rows = ranks.row_numbers(rows, [F.desc("lr"), F.col("gene")], "rank")
    n = rows.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return rows.withColumn("k", F.lit(1)).join(F.broadcast(n), "k").select("gene", F.round(100 * (1 - F.col("rank") / F.col("n")), 6).alias("pct"))


@query(f"""WITH {MATRIX_SQL}, t AS (SELECT arm, cell, sum(cnt) AS total FROM m GROUP BY 1, 2) SELECT gene, m.arm, round(avg(ln(1 + cnt * 10000 / total)), 6) AS mean_log, count(*) AS cells FROM m JOIN t ON m.arm = t.arm AND m.cell = t.cell GROUP BY 1, 2""")
def library_normalise(spark, d):
    m = matrix(spark, d)
    t = m.groupBy("arm", "cell").agg(F.sum("cnt").alias("total"))
    return m.join(t, ["arm", "cell"]).groupBy("gene", "arm").agg(F.round(F.avg(F.log1p(F.col("cnt") * 10000 / F.col("total"))), 6).alias("mean_log"), F.count("*").alias("cells"))


@query("""WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), s AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
  k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM r) AS i, (SELECT sum(n * (n - 1) / 2) FROM s) AS j, (SELECT sum(n) FROM c) AS n)
  SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM k""")
def cluster_agreement(spark, d):
    c = table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    one = F.lit(1).alias("k")
    ij = c.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("n")).select("*", one)
    i = c.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("i")).select("*", one)
    j = c.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("j")).select("*", one)
    want = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return ij.join(i, "k").join(j, "k").select(F.round((F.col("ij") - want) / ((F.col("i") + F.col("j")) / 2 - want), 6).alias("ari"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS g FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS g FROM lineitem WHERE l_linestatus = 'O'),
  na AS (SELECT s, count(*) AS n FROM a GROUP BY s), nb AS (SELECT s, count(*) AS n FROM b GROUP BY s), x AS (SELECT a.s AS sa, b.s AS sb, count(*) AS k FROM a JOIN b ON a.g = b.g GROUP BY 1, 2),
  y AS (SELECT sa, sb, k / (na.n + nb.n - k) AS jac, row_number() OVER (PARTITION BY sa ORDER BY k / (na.n + nb.n - k) DESC, sb) AS rn FROM x JOIN na ON na.s = sa JOIN nb ON nb.s = sb) SELECT sa, sb, round(jac, 6) AS jaccard FROM y WHERE rn = 1""")
def marker_jaccard(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("g")).distinct()
    a, b = (li.where(F.col("l_linestatus") == x).select(F.col("s").alias(f"s{y}"), "g") for x, y in (("F", "a"), ("O", "b")))
    na, nb = a.groupBy("sa").agg(F.count("*").alias("na")), b.groupBy("sb").agg(F.count("*").alias("nb"))
    # a gene's second side goes along as one list, and pairs are made where their first side is counted
    lists = b.join(nb, "sb").groupBy("g").agg(F.collect_list(F.struct("sb", "nb")).alias("of"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = a.join(lists, "g").repartition(n, "sa").select("sa", F.explode("of").alias("o")).groupBy("sa", "o.sb", "o.nb").agg(F.count("*").alias("k")).join(na, "sa")
    x = x.withColumn("jac", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    best = x.groupBy("sa").agg(F.max_by("sb", F.struct("jac", -F.col("sb"))).alias("sb"), F.max("jac").alias("jac"))
    return best.select("sa", "sb", F.round("jac", 6).alias("jaccard"))


@query("SELECT l_partkey AS gene FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def n_way_intersection(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 10").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_distinct("l_returnflag").alias("n")).where("n = 3").drop("n")


@query(f"""WITH {GENES_SQL} SELECT gene, CASE WHEN f > 2 * o THEN 'gained' ELSE 'lost' END AS change FROM genes WHERE f > 2 * o OR o > 2 * f""")
def gained_lost(spark, d):
    rows = genes(spark, d)
    a, b = rows.where("f > 2 * o").select("gene"), rows.where("o > 2 * f").select("gene")
    return a.withColumn("change", F.lit("gained")).unionByName(b.withColumn("change", F.lit("lost")))


@query(f"""WITH {MATRIX_SQL} SELECT arm, 'gene' AS axis, gene AS key, CAST(sum(cnt) AS BIGINT) AS total FROM m GROUP BY 1, 3 UNION ALL SELECT arm, 'cell', cell, CAST(sum(cnt) AS BIGINT) FROM m GROUP BY 1, 3""")
def axis_sums(spark, d):
    m = matrix(spark, d)
    part = lambda c: m.groupBy("arm", F.lit(c).alias("axis"), F.col(c).alias("key")).agg(F.sum("cnt").alias("total"))
    return part("gene").unionByName(part("cell"))


@query(f"""WITH {MATRIX_SQL}, d AS (SELECT gene, cell, sum(CASE WHEN arm = 'F' THEN cnt ELSE -cnt END) AS d FROM m GROUP BY 1, 2), a AS (SELECT gene, abs(d) AS a, d FROM d WHERE d <> 0),
  r AS (SELECT gene, d, rank() OVER (PARTITION BY gene ORDER BY a) + (count(*) OVER (PARTITION BY gene, a) - 1) / 2 AS r, power(count(*) OVER (PARTITION BY gene, a), 2) - 1 AS c FROM a),
  s AS (SELECT gene, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(c) AS c FROM r GROUP BY gene HAVING count(*) >= 10)
  SELECT gene, n, round(w, 6) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - c / 48), 6) AS z FROM s""")
def wilcoxon_signed_rank(spark, d):
    rows = matrix(spark, d).groupBy("gene", "cell").agg(F.sum(F.when(F.col("arm") == "F", F.col("cnt")).otherwise(-F.col("cnt"))).alias("d"))
    return ranks.wilcoxon(rows, ["gene"], "d").select("gene", "n", F.round("w_plus", 6).alias("w_plus"), F.round("z", 6).alias("z"))


@query(f"""WITH {MATRIX_SQL}, t AS (SELECT cell, gene, sum(cnt) AS cnt FROM m GROUP BY 1, 2), c AS (SELECT cell, avg(ln(1 + cnt)) AS control FROM t GROUP BY cell),
  s AS (SELECT t.cell, p_brand AS label, round(avg(ln(1 + cnt)) - any_value(control), 6) AS score FROM t JOIN part ON p_partkey = gene JOIN c ON c.cell = t.cell GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, label) AS rn FROM s) SELECT cell, label, score FROM r WHERE rn = 1""")
def marker_label(spark, d):
    """Cells labelled by the set of markers (a brand's genes) that stands out most above the cell's mean."""
    t = matrix(spark, d).groupBy("cell", "gene").agg(F.log1p(F.sum("cnt")).alias("v"))
    control = t.groupBy("cell").agg(F.avg("v").alias("control"))
    sets = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("label"))
    s = t.join(sets, "gene").groupBy("cell", "label").agg(F.avg("v").alias("v")).join(control, "cell")
    s = s.select("cell", "label", F.round(F.col("v") - F.col("control"), 6).alias("score"))
    best = s.groupBy("cell").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b"))
    return best.select("cell", "b.label", (-F.col("b.s")).alias("score"))


@query(f"""WITH {GENES_SQL}, k AS (SELECT p_partkey AS gene, unnest(['tens ' || substr(p_brand, 7, 1), 'ones ' || substr(p_brand, 8, 1)]) AS family FROM part)
  SELECT family, count(*) AS members, CAST(sum(f) AS BIGINT) AS f, CAST(sum(o) AS BIGINT) AS o FROM genes JOIN k ON k.gene = genes.gene GROUP BY family""")
def family_rollup(spark, d):
    """Totals of families that share members."""
    of = F.array(F.concat(F.lit("tens "), F.substring("p_brand", 7, 1)), F.concat(F.lit("ones "), F.substring("p_brand", 8, 1)))
    k = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.explode(of).alias("family"))
    return genes(spark, d).join(k, "gene").groupBy("family").agg(F.count("*").alias("members"), F.sum("f").alias("f"), F.sum("o").alias("o"))


@query("""WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), s AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
  h AS (SELECT (SELECT sum(c.n / t * ln(c.n * t / (r.n * s.n))) FROM c JOIN r ON r.a = c.a JOIN s ON s.b = c.b, t) AS mi, (SELECT -sum(n / t * ln(n / t)) FROM r, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM s, t) AS hb)
  SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM h""")
def cluster_information(spark, d):
    c = table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    # mutual information from sums of n ln n over cells, rows and columns
    part = lambda x, name: x.agg(F.sum(F.col("n") * F.log("n")).alias(name), F.sum("n").alias("t")).withColumn("t", F.col("t").cast("double"))
    cells = part(c, "c")
    rows = part(c.groupBy("a").agg(F.sum("n").alias("n")), "r")
    cols = part(c.groupBy("b").agg(F.sum("n").alias("n")), "s")
    t, h = F.col("t"), lambda x: F.log("t") - F.col(x) / F.col("t")
    mi = F.col("c") / t - F.col("r") / t - F.col("s") / t + F.log(t)
    return cells.join(rows, "t").join(cols, "t").select(F.round(mi / ((h("r") + h("s")) / 2), 6).alias("nmi"))
