"""Runs, windows, intervals, variants, graphs and indexes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fragments, graph, index, ranges, thinning, whole
from ..session import spool
from .views import INTERVALS_SQL, POINTS_SQL, SEQUENCES_SQL, TURNS_SQL, VARIANTS_SQL, intervals, points, sequences, table, turns, variants

Q = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


CHARS_SQL = "c AS (SELECT doc_id, unnest(range(0, length(seq))) AS p, unnest(string_split(seq, '')) AS b FROM s WHERE seq <> '')"
RUNS_SQL = f"""{SEQUENCES_SQL}, {CHARS_SQL}, g AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM c WHERE b <> 'N'),
  r AS (SELECT doc_id, min(p) AS start, max(p) + 1 AS stop FROM g GROUP BY doc_id, g),
  runs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS run_ix, start, stop, start - coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS off,
  CAST(sum(stop - start) OVER (PARTITION BY doc_id ORDER BY start) - (stop - start) AS BIGINT) AS joined FROM r)"""
#: Bases between the positions that coordinates are mapped for.
STRIDE = 100


@query(f"WITH {RUNS_SQL} SELECT * FROM runs")
def seq_runs(spark, d):
    return ranges.text_runs(sequences(spark, d), "seq")


@query(f"WITH {RUNS_SQL}, q AS (SELECT doc_id, unnest(range(0, length(seq), {STRIDE})) AS pos FROM s), m AS (SELECT q.doc_id, pos, joined, start, stop FROM q ASOF LEFT JOIN runs ON runs.doc_id = q.doc_id AND start <= q.pos) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos < stop THEN joined + pos - start END AS joined_pos FROM m")
def seq_coord_map(spark, d):
    hit = ranges.text_places(sequences(spark, d), "seq", STRIDE)
    return hit.select("doc_id", "pos", (F.col("joined") + F.col("pos") - F.col("start")).alias("joined_pos"))


@query("""WITH t AS (SELECT doc_id, n_chars, unnest(range(0, greatest(1, CAST(ceil(n_chars / 900) AS BIGINT)))) AS w FROM documents) SELECT doc_id, CAST(w AS BIGINT) AS w, CAST(w * 900 AS BIGINT) AS start, CAST(least(w * 900 + 1000, n_chars) AS BIGINT) AS stop FROM t""")
def window_tiles(spark, d):
    return ranges.tiles(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1000, 900).select("doc_id", "w", "start", "stop")


@query(f"""WITH {VARIANTS_SQL}, w AS (SELECT chrom, pos // 100 AS w, count(*) AS n FROM v GROUP BY 1, 2)
  SELECT chrom, count(*) AS windows, CAST(sum(n) AS BIGINT) AS variants, count(*) FILTER (n > 7) AS over, round(sum(CASE WHEN n > 7 THEN n ELSE 0 END) / sum(n), 6) AS at_risk FROM w GROUP BY chrom""")
def variant_density(spark, d):
    w = variants(spark, d).groupBy("chrom", F.expr("pos div 100").alias("w")).agg(F.count("*").alias("n"))
    return w.groupBy("chrom").agg(F.count("*").alias("windows"), F.sum("n").alias("variants"), F.count_if(F.col("n") > 7).alias("over"), F.round(F.sum(F.when(F.col("n") > 7, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("at_risk"))


@query(f"""WITH {VARIANTS_SQL} SELECT ix, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos, CASE typ WHEN 'insertion' THEN 1 WHEN 'single' THEN 2 ELSE 4 END, len, seq, ix) AS place FROM v""")
def variant_sort(spark, d):
    rank = F.when(F.col("typ") == "insertion", 1).when(F.col("typ") == "single", 2).otherwise(4)
    w = Window.partitionBy("chrom").orderBy("pos", rank, "len", "seq", "ix")
    return variants(spark, d).select("ix", "chrom", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {VARIANTS_SQL} SELECT typ, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM v GROUP BY typ")
def variant_types(spark, d):
    return variants(spark, d).groupBy("typ").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))


FLANK = "b || lead(b) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w || lead(b, 12) OVER w || lead(b, 13) OVER w || lead(b, 14) OVER w || lead(b, 15) OVER w"


@query(f"WITH {SEQUENCES_SQL}, {CHARS_SQL}, f AS (SELECT doc_id, p, {FLANK} AS k FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)), n AS (SELECT k, count(*) AS n FROM f WHERE k IS NOT NULL GROUP BY k) SELECT doc_id, p AS site, n > 1 AS excluded FROM f JOIN n ON f.k = n.k WHERE p % {STRIDE} = 0")
def dup_flank_exclusion(spark, d):
    """Sites every STRIDE bases: whether their two flanks of 4 bases, 8 apart, stand anywhere else in the whole table."""
    s = sequences(spark, d)
    n = spool(ranges.flank_counts(s, "seq", 4, 8, "ACGNT"), "flanks")  # 5^8 keys at most
    sites = ranges.flank_sites(s, "seq", 4, 8, "ACGNT", STRIDE)
    return sites.join(F.broadcast(n), "k").select("doc_id", "site", (F.col("n") > 1).alias("excluded"))


@query(f"""WITH {VARIANTS_SQL}, r AS (SELECT chrom, ix, row_number() OVER (PARTITION BY chrom ORDER BY pos, ix) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM v), k AS (SELECT DISTINCT chrom, n, unnest(range(0, 10)) AS j FROM r)
  SELECT r.chrom, r.ix FROM r JOIN k ON r.chrom = k.chrom AND r.i = CAST(floor(j * k.n / 10) AS BIGINT)""")
def even_selection(spark, d):
    w = Window.partitionBy("chrom")
    r = variants(spark, d).select("chrom", "ix", (F.row_number().over(w.orderBy("pos", "ix")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    slot = F.floor(F.col("i") * 10 / F.col("n"))
    near = F.exists(F.array(slot, slot + 1), lambda j: (j < 10) & (index.spread(F.col("n"), 10, j) == F.col("i")))
    return r.where(near).select("chrom", "ix")


@query(f"""WITH {VARIANTS_SQL}, t AS (SELECT *, pos // 500 AS w FROM v), u AS (SELECT *, min(CASE WHEN typ = 'deletion' AND pos + len > (w + 1) * 500 - 12 THEN pos * 1000000 + ix END) OVER (PARTITION BY chrom, w) AS stop FROM t)
  SELECT chrom, w, count(*) AS admitted FROM u WHERE stop IS NULL OR pos * 1000000 + ix < stop GROUP BY 1, 2""")
def admission_early_stop(spark, d):
    t = variants(spark, d).withColumn("w", F.expr("pos div 500"))
    misfit = (F.col("typ") == "deletion") & (F.col("pos") + F.col("len") > (F.col("w") + 1) * 500 - 12)
    place = F.struct("pos", "ix")
    stop = t.where(misfit).groupBy("chrom", "w").agg(F.min(place).alias("stop"))
    return t.join(stop, ["chrom", "w"], "left").where(F.col("stop").isNull() | (place < F.col("stop"))).groupBy("chrom", "w").agg(F.count("*").alias("admitted"))


MERGED_SQL = f"""{INTERVALS_SQL}, a AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY key ORDER BY start, stop, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
  b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY start, stop, name ROWS UNBOUNDED PRECEDING) AS g FROM a), merged AS (SELECT key, min(start) AS start, max(stop) AS stop FROM b GROUP BY key, g)"""


@query(f"WITH {MERGED_SQL} SELECT * FROM merged")
def interval_merge(spark, d):
    return ranges.merge_intervals(intervals(spark, d), ["key"])


@query(f"""WITH {MERGED_SQL}, g AS (SELECT key, coalesce(lag(stop) OVER (PARTITION BY key ORDER BY start), 9000) AS a, start AS b FROM merged UNION ALL SELECT key, max(stop), 12000 FROM merged GROUP BY key)
  SELECT key, greatest(a, 9000) AS start, least(b, 12000) AS stop FROM g WHERE greatest(a, 9000) < least(b, 12000)""")
def interval_complement(spark, d):
    return ranges.complement(intervals(spark, d), ["key"], F.lit(9000).cast("long"), F.lit(12000).cast("long"))


@query(f"""WITH {MERGED_SQL}, {POINTS_SQL} SELECT pt.key, ok, ln, p, start AS found FROM pt LEFT JOIN merged m ON m.key = pt.key AND start <= p AND p < stop""")
def asof_last_interval(spark, d):
    merged = ranges.merge_intervals(intervals(spark, d), ["key"])
    return ranges.last_start(points(spark, d), merged, ["key"], "p", ["start"]).withColumnRenamed("start", "found")


@query(f"""WITH {INTERVALS_SQL}, {POINTS_SQL}, h AS (SELECT pt.key, ok, ln, p, name, row_number() OVER (PARTITION BY pt.key, ok, ln, p ORDER BY start, stop, name) AS rn FROM pt LEFT JOIN iv ON iv.key = pt.key AND p BETWEEN start AND stop) SELECT key, ok, ln, p, name FROM h WHERE rn = 1""")
def first_match_interval(spark, d):
    iv = intervals(spark, d).select("key", "name", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    return ranges.first_match(points(spark, d), iv, ["key"], "p", "name")


@query(f"""WITH {INTERVALS_SQL} SELECT a.key, a.name AS a, b.name AS b FROM iv a JOIN iv b ON a.key = b.key AND a.start < b.stop AND b.start < a.stop AND a.name < b.name""")
def overlap_join(spark, d):
    return ranges.overlap_pairs(intervals(spark, d), ["key"], "name", 32)


@query(f"""WITH {INTERVALS_SQL} SELECT a.key, a.name AS a, b.name AS b FROM iv a JOIN iv b ON a.key = b.key AND b.start <= a.start AND a.stop <= b.stop AND a.name <> b.name""")
def containment_join(spark, d):
    return ranges.containment_pairs(intervals(spark, d), ["key"], "name", 32)


@query(f"""WITH {INTERVALS_SQL}, e AS (SELECT key, name, stop - start AS len, CAST(coalesce(sum(stop - start) OVER (PARTITION BY key ORDER BY CASE WHEN key % 2 = 1 THEN -start ELSE start END, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM iv)
  SELECT key, name, greatest(off, 90) AS a, least(off + len, 240) AS b FROM e WHERE greatest(off, 90) < least(off + len, 240)""")
def codon_slices(spark, d):
    w = Window.partitionBy("key").orderBy(F.when(F.col("key") % 2 == 1, -F.col("start")).otherwise(F.col("start")), "name")
    size = F.col("stop") - F.col("start")
    e = intervals(spark, d).select("key", "name", size.alias("len"), (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("off"))
    a, b = F.greatest("off", F.lit(90)), F.least(F.col("off") + F.col("len"), F.lit(240))
    return e.where(a < b).select("key", "name", a.cast("long").alias("a"), b.cast("long").alias("b"))


def _order_sql(end):
    """Suffix order of whole texts by doubling, with 8 letters to begin with: ranks r of 8 * 2^14 letters."""
    first = "||".join(["b", *[f"coalesce(lead(b, {i}) OVER w, '')" for i in range(1, 8)]])
    parts = [SEQUENCES_SQL, f"c AS (SELECT doc_id, unnest(range(0, length(seq) + 1)) AS pos, unnest(string_split(seq || '{end}', '')) AS b FROM s)"]
    parts += [f"k AS MATERIALIZED (SELECT doc_id, pos, lag(b, 1, '{end}') OVER w AS bwt, {first} AS k FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"]
    parts += ["r0 AS MATERIALIZED (SELECT doc_id, pos, bwt, rank() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM k)"]
    for i in range(14):
        # a row whose rank nobody shares keeps it; only the rest are ranked again within their equals
        parts += [f"a{i} AS (SELECT *, coalesce(lead(r, {8 << i}) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS n, count(*) OVER (PARTITION BY doc_id, r) AS same FROM r{i})"]
        parts += [f"r{i + 1} AS MATERIALIZED (SELECT doc_id, pos, bwt, r + rank() OVER (PARTITION BY doc_id, r ORDER BY n) - 1 AS r FROM a{i})"]
    return ", ".join([*parts, "rows AS (SELECT doc_id, r - 1 AS row, pos, bwt FROM r14)"])


@query(f"WITH {_order_sql('$')} SELECT doc_id, pos, row FROM rows")
def suffix_rank(spark, d):
    return index.suffixes(sequences(spark, d), "doc_id", "seq", "$", letters="ACGNT").select("doc_id", "pos", "row")


@query(f"WITH {_order_sql('~')} SELECT doc_id, pos, row FROM rows")
def suffix_rank_padlast(spark, d):
    return index.suffixes(sequences(spark, d), "doc_id", "seq", "~").select("doc_id", "pos", "row")


BWT_SQL = _order_sql("$")


@query(f"WITH {BWT_SQL} SELECT doc_id, row, pos, bwt FROM rows")
def bwt_rows(spark, d):
    return index.bwt(sequences(spark, d), "doc_id", "seq")


@query(f"WITH {BWT_SQL} SELECT doc_id, row // 64 AS block, bwt, count(*) AS n FROM rows GROUP BY 1, 2, 3")
def bwt_block_occ(spark, d):
    return index.block_counts(sequences(spark, d), "doc_id", "seq")


@query(f"WITH {BWT_SQL} SELECT doc_id, row, row_number() OVER (PARTITION BY doc_id ORDER BY bwt, row) - 1 AS \"to\" FROM rows")
def lf_map(spark, d):
    return index.text_lf(sequences(spark, d), "doc_id", "seq")


KMER_SQL = f"""WITH {SEQUENCES_SQL}, c AS (SELECT doc_id, unnest(range(0, length(seq) + 1)) AS p, unnest(string_split(seq || '$', '')) AS b FROM s),
  k AS (SELECT doc_id, b || coalesce(lead(b) OVER w, '') || coalesce(lead(b, 2) OVER w, '') AS kmer FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
  n AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY 1, 2), h AS (SELECT doc_id, kmer, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY kmer) AS BIGINT) AS hi FROM n) SELECT doc_id, kmer, hi - n AS lo, hi FROM h WHERE NOT contains(kmer, '$')"""


@query(KMER_SQL)
def kmer_table(spark, d):
    return index.kmer_table(sequences(spark, d), "doc_id", "seq", 3)


@query(KMER_SQL)
def kmer_trie(spark, d):
    return index.text_trie(sequences(spark, d), "doc_id", "seq", 3)


@query(f"""WITH {TURNS_SQL}, b AS (SELECT key, substr(replace(seq, 'N', 'A') || '~', CAST(p + 1 AS INTEGER), 3) AS kmer FROM (SELECT key, seq, unnest(range(0, length(seq) + 1)) AS p FROM s WHERE seq IS NOT NULL)),
  c AS (SELECT key, kmer, count(*) AS n FROM b GROUP BY 1, 2), h AS (SELECT key, kmer, n, sum(n) OVER (PARTITION BY key ORDER BY kmer) AS stop FROM c), a AS (SELECT key, max(stop) AS total FROM h GROUP BY 1),
  i AS (SELECT x || y || z AS kmer, row_number() OVER (ORDER BY x || y || z) - 1 AS slot FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x), (SELECT unnest(['A', 'C', 'G', 'T']) AS y), (SELECT unnest(['A', 'C', 'G', 'T']) AS z)),
  k AS MATERIALIZED (SELECT key, slot, stop - n AS start, stop FROM h JOIN i ON i.kmer = h.kmer), j AS (SELECT slot FROM i UNION ALL SELECT 64)
  SELECT a.key, j.slot, CAST(coalesce(max(k.stop) FILTER (k.slot < j.slot), 0) AS BIGINT) AS lo, CAST(CASE WHEN j.slot = 64 THEN any_value(total) ELSE coalesce(max(k.start) FILTER (k.slot = j.slot), max(k.stop) FILTER (k.slot < j.slot), 0) END AS BIGINT) AS hi FROM a CROSS JOIN j LEFT JOIN k ON k.key = a.key GROUP BY 1, 2""")
def kmer_overflow(spark, d):
    """The bounds of all 3-mers of turns, with the short suffixes that each takes in."""
    return index.kmer_bounds(turns(spark, d).withColumn("seq", F.translate("seq", "N", "A")), "key", "seq", 3)


@query(f"WITH {BWT_SQL} SELECT doc_id, row, pos FROM rows WHERE row % 4 = 0")
def sa_sample(spark, d):
    return index.sample(index.bwt(sequences(spark, d), "doc_id", "seq"), 4).select("doc_id", "row", "pos")


@query(f"WITH {TURNS_SQL} SELECT key, seq AS text FROM s WHERE seq <> ''")
def bwt_inverse(spark, d):
    """Turns rebuilt from the letters of their BWT, by the positions that it gives."""
    s, n = turns(spark, d).where("seq <> ''"), F.length("seq")
    near = _dealt(s.where(n <= index.LONG)).select("key", index.bwt_text(F.col("seq")).alias("bwt")).select("key", index.inverse_text(F.col("bwt")).alias("text"))
    return near.unionByName(_far_inverse(s.where(n > index.LONG))) if s.where(n > index.LONG).limit(1).count() else near


def _dealt(s):
    """Texts dealt out anew by key: a small file, or one of few row groups, would be few tasks."""
    return s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _far_inverse(s):
    rows = spool(index.bwt(s, "key", "seq").select("key", "row", "bwt"), "bwt")
    letters = index.inverse(rows, "key").join(rows, ["key", "row"]).where("pos > 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "bwt"))).alias("x"))
    return letters.select("key", F.array_join(F.transform("x", lambda x: x["bwt"]), "").alias("text"))


#: Letters of the words that turns are searched for, and where they begin in the turn.
WORDS = ((0, 4), (5, 6), (11, 9))


@query(f"""WITH {TURNS_SQL}, w AS (SELECT DISTINCT key, substr(seq, a + 1, n) AS word, seq FROM s, (VALUES {", ".join(map(str, WORDS))}) AS x(a, n) WHERE length(seq) >= a + n)
  SELECT key, word, p AS pos FROM (SELECT key, word, seq, unnest(range(0, length(seq))) AS p FROM w) WHERE substr(seq, p + 1, length(word)) = word""")
def pattern_positions(spark, d):
    """All places of words in turns, by backward steps and then to sampled rows."""
    s, n = turns(spark, d), F.length("seq")
    words = F.array_distinct(F.array_compact(F.array(*[F.when(n >= a + k, F.substring("seq", a + 1, k)) for a, k in WORDS])))
    near = index.found(_dealt(s.where(n <= index.LONG)).withColumn("words", words), "key", "seq", "words", "ACGNT")
    return near.unionByName(_far_positions(s.where(n > index.LONG))) if s.where(n > index.LONG).limit(1).count() else near


def _far_positions(s):
    """The same with a row for each place of a text, all words at once."""
    s = spool(s, "turns")
    words = s.select("key", F.explode(F.array(*[F.when(F.length("seq") >= a + n, F.substring("seq", a + 1, n)) for a, n in WORDS])).alias("word")).dropna().distinct()
    rows = spool(index.suffixes(s, "key", "seq", "~"), "rows")
    lookup = index.search(rows, "key", "ACGNT")
    return index.located(graph.spelled(words, lookup, "key"), lookup, rows.where("pos % 8 = 0"), "key").select("key", "word", "pos")


#: Bases from one variant of a sequence to the next.
APART = 50


def _texts(spark, d):
    """Whole turns as the texts of graphs."""
    return turns(spark, d).withColumn("seq", F.translate("seq", "N", "A")).where(F.length("seq") >= 12)


def _by_length(spark, d, key_rows, far):
    """What `key_rows` makes of the graphs of texts of up to whole.LONG letters, and `far` of longer ones."""
    s, n = _texts(spark, d), F.length("seq")
    if not s.where(n > whole.LONG).limit(1).count():
        return key_rows(_whole(s))
    return key_rows(_whole(s.where(n <= whole.LONG))).unionByName(far(s.where(n > whole.LONG)))


def _whole(s):
    """The graphs of `_graph`, a row each."""
    at = F.sequence(F.lit(0), F.expr(f"(length(seq) - 12) div {APART}"))
    pos = lambda k: F.transform(at, lambda i: (APART * i + k).cast("long"))
    base = F.array_join(F.transform(at, lambda i: F.substring(F.col("seq"), APART * i + 4, F.lit(1))), "")
    return s.select("key", F.col("seq").alias("text"), pos(3).alias("single"), F.translate(base, "ACGT", "CGTA").alias("base"), pos(6).alias("gone"), F.transform(at, lambda i: F.lit(2).cast("long")).alias("size"))


def _graph(s):
    """Whole turns as graphs; every APART bases a substitution and, three bases on, a deletion of two."""
    nodes, edges = graph.backbone(s, "key", "seq")
    places = F.transform(F.sequence(F.lit(0), F.expr(f"(length(seq) - 12) div {APART}")), lambda i: F.struct(i.alias("i"), F.substring(F.col("seq"), APART * i + 4, F.lit(1)).alias("b")))
    at = s.select("key", F.explode(places).alias("v")).select("key", F.col("v.i").alias("i"), F.translate("v.b", "ACGT", "CGTA").alias("base"))
    pos = (APART * F.col("i")).cast("long")
    one = at.select("key", F.col("i").alias("ix"), (pos + 3).alias("pos"), F.lit("single").alias("typ"), F.lit(1).alias("len"), "base")
    two = at.select("key", F.col("i").alias("ix"), (pos + 6).alias("pos"), F.lit("deletion").alias("typ"), F.lit(2).alias("len"), F.lit(None).cast("string").alias("base"))
    return graph.with_variants(nodes, edges, one.unionByName(two), "key")


GRAPH_SQL = f"""{TURNS_SQL}, t AS (SELECT key, replace(seq, 'N', 'A') AS q FROM s WHERE length(seq) >= 12),
  spots AS (SELECT key, length(q) AS n, i, substr(q, CAST({APART} * i + 4 AS INTEGER), 1) AS b FROM t, unnest(range(0, (length(q) - 12) // {APART} + 1)) AS u(i)),
  nodes AS MATERIALIZED (SELECT key, unnest(range(0, length(q) + 2)) AS id, unnest(string_split('Y' || q || 'Z', '')) AS label FROM t UNION ALL SELECT key, n + 2 + i, translate(b, 'ACGT', 'CGTA') FROM spots),
  edges AS MATERIALIZED (SELECT key, i AS src, i + 1 AS dst FROM t, unnest(range(0, length(q) + 1)) AS u(i) UNION SELECT key, {APART} * i + 3, n + 2 + i FROM spots UNION SELECT key, n + 2 + i, {APART} * i + 5 FROM spots UNION SELECT key, {APART} * i + 6, {APART} * i + 9 FROM spots)"""


@query(f"WITH {GRAPH_SQL} SELECT n.key, label, count(*) AS edges FROM edges e JOIN nodes n ON n.key = e.key AND n.id = e.src GROUP BY 1, 2")
def edge_node_join(spark, d):
    nodes, edges = _graph(_texts(spark, d))
    return edges.join(nodes.select("key", F.col("id").alias("src"), "label"), ["key", "src"]).groupBy("key", "label").agg(F.count("*").alias("edges"))


@query(f"WITH {GRAPH_SQL} SELECT n.key, dst, label, count(*) AS n FROM edges e JOIN nodes n ON n.key = e.key AND n.id = e.src GROUP BY 1, 2, 3 HAVING count(*) > 1")
def rev_determinism(spark, d):

    def of(g, _):
        node, label, n = whole.repeated(g)
        return g.of[node], [node - g.first[g.of[node]], whole.letters(label), n]

    return _by_length(spark, d, lambda s: whole.each(s, "key", of, "dst long, label string, n long"), lambda s: graph.repeated_predecessors(*_graph(s), "key"))


@query(f"WITH {GRAPH_SQL} SELECT key, src, count(*) AS outdeg FROM edges GROUP BY 1, 2 HAVING count(*) > 1")
def out_degree(spark, d):
    _, edges = _graph(_texts(spark, d))
    return edges.groupBy("key", "src").agg(F.count("*").alias("outdeg")).where("outdeg > 1")


PATHS_SQL = f"""{GRAPH_SQL}, p0 AS MATERIALIZED (SELECT e.key, src, dst, instr('ACGTYZ', label) - 1 AS k FROM edges e JOIN nodes n ON n.key = e.key AND n.id = e.src UNION ALL SELECT key, id, id, 5 FROM nodes WHERE label = 'Z'),
  p1 AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.k * 8 + b.k AS k FROM p0 a JOIN p0 b ON a.key = b.key AND a.dst = b.src), p2 AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.k * 64 + b.k AS k FROM p1 a JOIN p1 b ON a.key = b.key AND a.dst = b.src),
  p3 AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.k * 4096 + b.k AS k FROM p2 a JOIN p2 b ON a.key = b.key AND a.dst = b.src)"""


def _paths3(s):
    nodes, edges = _graph(s)
    paths = graph.paths0(nodes, edges, "key")
    for g in (1, 2, 3):
        paths = spool(graph.double(paths, g, "key"), f"paths{g}")
    return paths.select("key", "src", "dst", "k0")


def _paths_of(generation, columns):
    """Paths of a generation: places of their ends in their own graph, and `columns` of them."""

    def of(g, _):
        paths, _ = whole.doubled(g, until=generation)
        at = g.of[paths["src"]]
        k0 = whole.of_first(g, paths["src"], paths["k0"]) if generation > 3 else paths["k0"]
        return at, [paths["src"] - g.first[at], paths["dst"] - g.first[at], k0, *([paths["done"]] if "done" in columns else [])]

    return lambda s: whole.each(s, "key", of, f"src long, dst long, {columns}")


@query(f"WITH {PATHS_SQL} SELECT key, src, dst, CAST(k AS BIGINT) AS k0 FROM p3")
def path_doubling(spark, d):
    return _by_length(spark, d, _paths_of(3, "k0 long"), _paths3)


RANK4_SQL = f"""{PATHS_SQL}, j AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.k AS k0, b.k AS k1 FROM p3 a JOIN p3 b ON a.key = b.key AND a.dst = b.src),
  g AS MATERIALIZED (SELECT *, min(src) OVER (PARTITION BY key, k0, k1) = max(src) OVER (PARTITION BY key, k0, k1) AS hom, row_number() OVER (PARTITION BY key, k0, k1 ORDER BY src, dst) AS rn FROM j),
  h AS (SELECT key, k0, k1, src, hom, coalesce(hom AND lag(hom) OVER w AND lag(src) OVER w = src, false) AS again FROM g WHERE rn = 1 WINDOW w AS (PARTITION BY key ORDER BY k0, k1)),
  r AS (SELECT key, k0, k1, again, CAST(sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY k0, k1) - 1 AS BIGINT) AS place FROM h),
  p4 AS MATERIALIZED (SELECT g.key, src, dst, place, count(*) OVER (PARTITION BY g.key, place) = 1 AS done FROM g JOIN r ON r.key = g.key AND r.k0 = g.k0 AND r.k1 = g.k1 WHERE NOT (hom AND (rn > 1 OR again)))"""


def _placed(spark, d, generation):
    """Paths of a generation with their places."""
    far = lambda s: graph.from_first(graph.doubling(*_graph(s), "key", until=generation)[0], "key", "k0").select("key", "src", "dst", F.col("k0").alias("place"), "done")
    return _by_length(spark, d, _paths_of(generation, "place long, done boolean"), far)


@query(f"WITH {RANK4_SQL} SELECT key, src, dst, place, done FROM p4")
def run_collapse_hom(spark, d):
    return _placed(spark, d, 4)


@query(f"""WITH {RANK4_SQL}, j5 AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.done, a.place AS k0, b.place AS k1 FROM p4 a JOIN p4 b ON a.key = b.key AND a.dst = b.src WHERE NOT a.done UNION ALL SELECT key, src, dst, done, place, 0 FROM p4 WHERE done),
  g5 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key, k0, k1 ORDER BY src, dst) AS rn, count(*) OVER (PARTITION BY key, k0) AS bl FROM j5),
  h5 AS (SELECT key, k0, k1, min(src) = max(src) AS hom, max(src) AS src, any_value(bl) AS bl, arg_max(done, (src, dst)) AS own FROM g5 GROUP BY key, k0, k1),
  e0 AS (SELECT *, (bl > 1 AND hom) OR own AS eff0 FROM h5),
  s5 AS (SELECT *, coalesce(bl = 1 AND lag(bl) OVER w > 1 AND lag(eff0) OVER w AND lag(src) OVER w = src, false) AS solo FROM e0 WINDOW w AS (PARTITION BY key ORDER BY k0, k1)),
  d5 AS (SELECT *, solo OR coalesce(bl > 1 AND hom AND lag(eff0 OR solo) OVER w AND lag(src) OVER w = src, false) AS gone FROM s5 WINDOW w AS (PARTITION BY key ORDER BY k0, k1)),
  r5 AS (SELECT *, CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY k0, k1) - 1 AS BIGINT) AS place FROM d5)
  SELECT g5.key, g5.src, dst, place, done OR (hom AND r5.bl > 1) AS done FROM g5 JOIN r5 ON r5.key = g5.key AND r5.k0 = g5.k0 AND r5.k1 = g5.k1 WHERE NOT gone AND (NOT (hom AND r5.bl > 1) OR rn = 1)""")
def rank_fold(spark, d):
    return _placed(spark, d, 5)


#: Generations of the SQL below; all paths are done after fewer, and further ones change nothing.
GENERATIONS = 12


def _generation_sql(g):
    """Generation g from p{g-1}: paths joined end to start, then folded and ranked."""
    return f"""j{g} AS MATERIALIZED (SELECT a.key, a.src, b.dst, a.done, a.place AS k0, b.place AS k1 FROM p{g - 1} a JOIN p{g - 1} b ON a.key = b.key AND a.dst = b.src WHERE NOT a.done UNION ALL SELECT key, src, dst, done, place, 0 FROM p{g - 1} WHERE done),
  g{g} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key, k0, k1 ORDER BY src, dst) AS rn, count(*) OVER (PARTITION BY key, k0) AS bl FROM j{g}),
  h{g} AS (SELECT key, k0, k1, min(src) = max(src) AS hom, max(src) AS src, any_value(bl) AS bl, arg_max(done, (src, dst)) AS own FROM g{g} GROUP BY key, k0, k1),
  e{g} AS (SELECT *, (bl > 1 AND hom) OR own AS eff0 FROM h{g}),
  s{g} AS (SELECT *, coalesce(bl = 1 AND lag(bl) OVER w > 1 AND lag(eff0) OVER w AND lag(src) OVER w = src, false) AS solo FROM e{g} WINDOW w AS (PARTITION BY key ORDER BY k0, k1)),
  d{g} AS (SELECT *, solo OR coalesce(bl > 1 AND hom AND lag(eff0 OR solo) OVER w AND lag(src) OVER w = src, false) AS gone FROM s{g} WINDOW w AS (PARTITION BY key ORDER BY k0, k1)),
  r{g} AS (SELECT *, CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY k0, k1) - 1 AS BIGINT) AS place FROM d{g}),
  p{g} AS MATERIALIZED (SELECT g{g}.key, g{g}.src, dst, place, done OR (hom AND r{g}.bl > 1) AS done FROM g{g} JOIN r{g} ON r{g}.key = g{g}.key AND r{g}.k0 = g{g}.k0 AND r{g}.k1 = g{g}.k1 WHERE NOT gone AND (NOT (hom AND r{g}.bl > 1) OR rn = 1))"""


def _sure(s):
    """The same graphs without the deletions whose ends have predecessors of one label: reverse-deterministic as they are."""
    nodes, edges = _graph(s)
    twice = spool(graph.repeated_predecessors(nodes, edges, "key").select("key", "dst").distinct(), "twice")
    return nodes, edges.join(twice, ["key", "dst"], "left_anti").unionByName(edges.join(twice, ["key", "dst"], "left_semi").where("dst = src + 1"))


#: Everything up to the fixpoint p{GENERATIONS} on those graphs.
FIXPOINT_SQL = f"""{RANK4_SQL.replace("edges AS MATERIALIZED", "edges0 AS").replace("p0 AS MATERIALIZED", f"edges AS MATERIALIZED (SELECT e.* FROM edges0 e LEFT JOIN (SELECT DISTINCT e.key, dst FROM edges0 e JOIN nodes n ON n.key = e.key AND n.id = e.src GROUP BY e.key, dst, label HAVING count(*) > 1) x ON x.key = e.key AND x.dst = e.dst WHERE x.dst IS NULL OR e.dst = e.src + 1), p0 AS MATERIALIZED")},
  {", ".join(_generation_sql(g) for g in range(5, GENERATIONS + 1))}"""

#: Path nodes n0 and path edges t in row order. Here sources meet in order without gaps, so the k-th run of a source among
#: edges belongs to its k-th run among nodes.
ROWS_SQL = f"""{FIXPOINT_SQL}, n0 AS MATERIALIZED (SELECT key, place AS rank, src FROM p{GENERATIONS}), sz AS (SELECT key, count(*) AS n FROM n0 GROUP BY 1),
  pe AS MATERIALIZED (SELECT e.key, e.src, e.dst, n0.rank, instr('ACGTYZ', label) - 1 AS k FROM edges e JOIN nodes n ON n.key = e.key AND n.id = e.src JOIN n0 ON n0.key = e.key AND n0.src = e.dst),
  nr AS (SELECT *, CASE WHEN lag(src) OVER w = src THEN 0 ELSE 1 END AS new FROM n0 WINDOW w AS (PARTITION BY key ORDER BY rank)), nn AS (SELECT key, src, rank, row_number() OVER (PARTITION BY key, src ORDER BY rank) AS nth FROM nr WHERE new = 1),
  tr AS (SELECT *, CASE WHEN lag(src) OVER w = src THEN 0 ELSE 1 END AS new FROM pe WINDOW w AS (PARTITION BY key ORDER BY k, rank, src, dst)), tn AS (SELECT key, src, sum(new) OVER (PARTITION BY key, src ORDER BY k, rank, src, dst) AS nth FROM tr),
  dg AS (SELECT key, src, nth, count(*) AS n FROM tn GROUP BY 1, 2, 3), deg AS MATERIALIZED (SELECT n0.key, n0.rank, n0.src, coalesce(dg.n, 0) AS outdeg, sz.n FROM n0 JOIN sz ON sz.key = n0.key LEFT JOIN nn ON nn.key = n0.key AND nn.rank = n0.rank LEFT JOIN dg ON dg.key = n0.key AND dg.src = nn.src AND dg.nth = nn.nth),
  sp AS (SELECT key, rank, greatest(outdeg, 1) AS n FROM deg WHERE rank < n - 1), st AS (SELECT key, sum(n) OVER (PARTITION BY key ORDER BY rank) - n AS row FROM sp),
  er AS (SELECT pe.key, pe.src, dst, CASE WHEN k <> 4 AND rank >= n - 1 THEN rank - 1 ELSE rank END AS rank, CASE WHEN k = 4 THEN 5 ELSE k END AS k, k <> 4 AND rank >= n - 1 AS moved FROM pe JOIN sz ON sz.key = pe.key),
  ro AS (SELECT key, substr('ACGTYZ', CAST(k + 1 AS INTEGER), 1) AS label, row_number() OVER (PARTITION BY key ORDER BY rank, k, moved, src, dst) - 1 AS row, row_number() OVER (PARTITION BY key, rank ORDER BY k, moved, src, dst) = 1 AS f FROM er),
  rows AS MATERIALIZED (SELECT ro.key, ro.row, label, f, st.row IS NOT NULL AS m FROM ro LEFT JOIN st ON st.key = ro.key AND st.row = ro.row)"""


def _fixpoint(s):
    """Nodes, edges and the paths at their fixpoint."""
    nodes, edges = (spool(x, "graph") for x in _sure(s))
    return nodes, edges, spool(graph.doubling(nodes, edges, "key")[0], "fixpoint")


def _rows(s):
    """The rows of the graphs' index."""
    return spool(graph.edge_rows(*_fixpoint(s), "key")[0], "rows")


def _out_degrees(g, _):
    g = whole.sure(g)
    src = whole.doubled(g)[0]["src"]
    of = g.of[src]
    return of, [whole.of_first(g, src, np.arange(len(src))), src - g.first[of], whole.out_degrees(g, src, whole.path_edges(g, src))]


def _far_out_degrees(s):
    at, rows = (spool(x, "path") for x in graph.path_edges(*_fixpoint(s), "key"))
    return graph.positional_out_degree(at, rows, "key", ["rank"], ["k", "rank", "src", "dst"]).select("key", "rank", "src", "outdeg")


@query(f"WITH {ROWS_SQL} SELECT key, rank, src, CAST(outdeg AS BIGINT) AS outdeg FROM deg")
def positional_outdeg(spark, d):
    """Out-degrees of path nodes: path edges by label and rank meet them in order."""
    return _by_length(spark, d, lambda s: whole.each(s, "key", _out_degrees, "rank long, src long, outdeg long"), _far_out_degrees)


def _flags(g, _):
    x = whole.indexed(whole.sure(g))
    return x.of, [x.row, whole.letters(x.label), x.f, x.m]


@query(f"WITH {ROWS_SQL} SELECT key, row, label, f, m FROM rows")
def edge_flags(spark, d):
    return _by_length(spark, d, lambda s: whole.each(s, "key", _flags, "row long, label string, f boolean, m boolean"), _rows)


def _ranks(g, _):
    x = whole.indexed(whole.sure(g))
    before, upto = whole.of_first(g, g.first[x.of], np.cumsum(x.m) - x.m), whole.of_first(g, g.first[x.of], np.cumsum(x.f))
    # a graph's first row has the flag f
    return x.of, [x.row, before, pa.array(upto + 1, mask=~x.f)]


def _far_ranks(s):
    rows = _rows(s)
    picked = graph.selected(rows, "key", "f").withColumnRenamed("k", "select_k")
    return graph.rank_flags(rows, "key", "m", "rank_m").join(picked, ["key", "row"], "left").select("key", "row", "rank_m", "select_k")


@query(f"WITH {ROWS_SQL}, c AS (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY row) - CASE WHEN m THEN 1 ELSE 0 END AS rank_m, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY row) AS k FROM rows) SELECT key, row, CAST(rank_m AS BIGINT) AS rank_m, CAST(CASE WHEN f THEN k END AS BIGINT) AS select_k FROM c")
def flag_ranks(spark, d):
    return _by_length(spark, d, lambda s: whole.each(s, "key", _ranks, "row long, rank_m long, select_k long"), _far_ranks)


#: Letters that each graph is searched for: the first ones of its own text.
SPELLED = 6


def _spelled(g, texts):
    of, node = whole.spelled(whole.indexed(whole.sure(g)), len(texts), [t[:SPELLED] for t in texts])
    node = np.unique(node)
    return g.of[node], [node - g.first[g.of[node]]]


def _far_spelled(s):
    nodes, edges, paths = _fixpoint(s)
    rows, at = (spool(x, "rows") for x in graph.edge_rows(nodes, edges, paths, "key"))
    index = graph.tallied(rows, "key")
    words = nodes.where(f"id between 1 and {SPELLED}").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]), "").alias("word"))
    return graph.nodes_of(graph.spelled(words, index, "key"), index, at, "key").select("key", "src").distinct()


@query(f"""WITH {ROWS_SQL}, q AS (SELECT key, substr(q, 1, {SPELLED}) AS word FROM t),
  w1 AS (SELECT n.key, n.id AS start, n.id AS at, label AS word FROM nodes n WHERE label IN ('A', 'C', 'G', 'T')), {", ".join(f"w{i + 1} AS (SELECT w.key, w.start, e.dst AS at, w.word || n.label AS word FROM w{i} w JOIN q ON q.key = w.key AND q.word[:{i}] = w.word JOIN edges e ON e.key = w.key AND e.src = w.at JOIN nodes n ON n.key = e.key AND n.id = e.dst)" for i in range(1, SPELLED))},
  found AS (SELECT DISTINCT w.key, start FROM w{SPELLED} w JOIN q ON q.key = w.key AND q.word = w.word)
  SELECT f.key, f.start AS src FROM found f""")
def graph_lf(spark, d):
    """The nodes from which each graph spells the first letters of its own text, by backward steps over its rows."""
    return _by_length(spark, d, lambda s: whole.each(s, "key", _spelled, "src long"), _far_spelled)


@query()
def doubling_curve(spark, d):
    s, n = _texts(spark, d), F.length("seq")
    curve = whole.curve_of(_whole(s.where(n <= whole.LONG)), "key")
    if s.where(n > whole.LONG).limit(1).count():
        nodes, edges = graph.determinize(*_graph(s.where(n > whole.LONG)), "key")
        more = graph.doubling(spool(nodes, "nodes"), spool(edges, "edges"), "key")[1]
        parts = [(g, g == len(c) - 1, *row) for c in (curve, more) for g, *row in c]
        curve = whole.joined_curve(parts)
    return spark.createDataFrame(curve, "gen long, temp long, nodes long, ranks long")


RELAX, CHUNK = 20, 5000
SPARSE_SQL = f"""{VARIANTS_SQL}, x AS (SELECT ix, chrom, pos * 100 AS pos, typ, len FROM v), lens AS (SELECT chrom, max(pos) + 500 AS length FROM x GROUP BY chrom),
  bl AS (SELECT chrom, greatest(pos - {RELAX} - 1, 0) AS start, CASE WHEN typ = 'deletion' THEN pos + len ELSE pos + 1 END + {RELAX} + 1 AS stop FROM x),
  bn AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM bl),
  bg AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM bn), blocked AS MATERIALIZED (SELECT chrom, min(start) AS start, max(stop) AS stop FROM bg GROUP BY chrom, g)"""


def _sparse(spark, d):
    """The variants a hundred times farther apart, with the length of each chromosome."""
    v = variants(spark, d).withColumn("pos", F.col("pos") * 100)
    return v, v.groupBy("chrom").agg((F.max("pos") + 500).alias("length"))


CUTS_SQL = f"""WITH RECURSIVE {SPARSE_SQL}, f AS (SELECT chrom, length, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop FROM lens UNION ALL
  SELECT f.chrom, length, f.stop, least(length, coalesce(b.stop, f.stop + {CHUNK})) FROM f LEFT JOIN blocked b ON b.chrom = f.chrom AND b.start <= f.stop + {CHUNK} AND f.stop + {CHUNK} < b.stop WHERE f.stop < length)"""


@query(f"{CUTS_SQL} SELECT chrom, start, stop FROM f WHERE stop > start")
def fragment_cuts(spark, d):
    v, lengths = _sparse(spark, d)
    return ranges.fragment_cuts(lengths, ranges.blocked_ranges(v, "chrom", RELAX), "chrom", CHUNK)


@query(f"{CUTS_SQL} SELECT l.chrom, count(b.start) AS bad FROM lens l JOIN f ON f.chrom = l.chrom LEFT JOIN blocked b ON b.chrom = f.chrom AND f.start > 0 AND b.start <= f.start AND f.start < b.stop GROUP BY 1")
def fragment_audit(spark, d):
    v, lengths = _sparse(spark, d)
    blocked = ranges.blocked_ranges(v, "chrom", RELAX)
    bad = ranges.bad_cuts(ranges.fragment_cuts(lengths, blocked, "chrom", CHUNK), blocked, "chrom", 256)
    return lengths.select("chrom").join(bad, "chrom", "left").groupBy("chrom").agg(F.count("cut").alias("bad"))


#: Bases of a fragment of a turn, and how far cuts keep from variants.
PIECE, CLEAR = 120, 8


@query(f"""WITH {FIXPOINT_SQL}, v AS (SELECT key, id, label, CASE WHEN label IN ('Y', 'Z') THEN NULL WHEN id <= n THEN id - 1 ELSE {APART} * (id - n - 2) + 3 END AS value FROM nodes JOIN (SELECT key AS k, length(q) AS n FROM t) x ON x.k = nodes.key)
  SELECT e.key, a.label AS src_label, CAST(a.value AS BIGINT) AS src_value, b.label AS dst_label, CAST(b.value AS BIGINT) AS dst_value, count(*) AS edges FROM edges e JOIN v a ON a.key = e.key AND a.id = e.src JOIN v b ON b.key = e.key AND b.id = e.dst GROUP BY 1, 2, 3, 4, 5""")
def fragment_stitch(spark, d):
    """The graphs of `_sure` from fragments of about PIECE bases that are determinised apart: edges by label and value."""
    s = spool(turns(spark, d).withColumn("seq", F.translate("seq", "N", "A")).where(F.length("seq") >= 12), "turns")
    at = s.select("key", "seq", F.explode(F.sequence(F.lit(0), F.expr(f"(length(seq) - 12) div {APART}"))).alias("i")).withColumn("p", (APART * F.col("i")).cast("long"))
    base = lambda k: F.substring(F.col("seq"), APART * F.col("i") + k, F.lit(1))
    kind = "array<struct<typ:string,pos:bigint,len:bigint,seq:string>>"
    hap = lambda typ, pos, n, seq: F.array(F.struct(F.lit(typ).alias("typ"), pos.alias("pos"), F.lit(n).cast("long").alias("len"), seq.alias("seq"))).cast(kind).alias("variants")
    one = at.select("key", F.concat(F.lit("s"), "i").alias("hap"), (F.col("p") + 3).alias("left"), (F.col("p") + 3).alias("right"), hap("single", F.col("p") + 3, 1, F.translate(base(4), "ACGT", "CGTA")))
    two = at.where(base(6) != base(8)).select("key", F.concat(F.lit("d"), "i").alias("hap"), (F.col("p") + 6).alias("left"), (F.col("p") + 7).alias("right"), hap("deletion", F.col("p") + 6, 2, F.lit(None).cast("string")))
    haps = spool(one.unionByName(two), "haplotypes")
    blocked = ranges.blocked_ranges(haps.select("key", F.explode("variants").alias("v")).select("key", "v.typ", "v.pos", "v.len"), "key", CLEAR)
    cuts = ranges.fragment_cuts(s.select("key", F.length("seq").cast("long").alias("length")), blocked, "key", PIECE)
    nodes, edges = (spool(x, "stitched") for x in fragments.build(s, haps, spool(cuts, "cuts"), "key", "seq", PIECE))
    end = lambda c: nodes.select("key", F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("value").alias(f"{c}_value"))
    return edges.join(end("src").hint("merge"), ["key", "src"]).join(end("dst").hint("merge"), ["key", "dst"]).groupBy("key", "src_label", "src_value", "dst_label", "dst_value").agg(F.count("*").alias("edges"))


def thinning_windows(spark, d):
    """Variants (ix, pos, len) in windows (chrom, w) of fifty positions."""
    return variants(spark, d).select("chrom", F.expr("pos div 50").alias("w"), "ix", "pos", "len")


def thinning_sql(rounds=7):
    """The same choice from the cost of every number of variants: halving between none and all."""
    halves = ", ".join(f"h{i + 1} AS (SELECT h.chrom, h.w, h.n, CASE WHEN high > low + 1 AND c.cost <= 30 THEN (low + high) // 2 ELSE low END AS low, CASE WHEN high > low + 1 AND c.cost > 30 THEN (low + high) // 2 ELSE high END AS high FROM h{i} h LEFT JOIN c ON c.chrom = h.chrom AND c.w = h.w AND c.k = (low + high) // 2)" for i in range(rounds))
    return f"""WITH {VARIANTS_SQL}, x AS MATERIALIZED (SELECT chrom, pos // 50 AS w, ix, len, row_number() OVER (PARTITION BY chrom, pos // 50 ORDER BY pos, ix) - 1 AS i FROM v), s AS MATERIALIZED (SELECT chrom, w, count(*) AS n FROM x GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT chrom, w, n, k, unnest(range(0, k)) * n // k AS i FROM (SELECT chrom, w, n, unnest(range(1, n + 1)) AS k FROM s)), c AS MATERIALIZED (SELECT p.chrom, p.w, p.k, sum(len) AS cost FROM p JOIN x ON x.chrom = p.chrom AND x.w = p.w AND x.i = p.i GROUP BY 1, 2, 3),
  h0 AS (SELECT s.chrom, s.w, s.n, 0 AS low, s.n AS high FROM s), {halves}, r AS (SELECT h.chrom, h.w, CASE WHEN c.cost <= 30 THEN h.n ELSE low END AS k FROM h{rounds} h JOIN c ON c.chrom = h.chrom AND c.w = h.w AND c.k = h.n)
  SELECT x.chrom, x.w, x.ix FROM r JOIN p ON p.chrom = r.chrom AND p.w = r.w AND p.k = r.k JOIN x ON x.chrom = p.chrom AND x.w = p.w AND x.i = p.i"""


@query(thinning_sql())
def window_thinning(spark, d):
    """The variants that stay where those of a window may change 30 bases at most."""
    return thinning.thin_sums(thinning_windows(spark, d), ["chrom", "w"], ["pos", "ix"], "len", 30).select("chrom", "w", "ix")


@query(f"""WITH {TURNS_SQL}, t AS (SELECT key, length(seq) AS n FROM s WHERE length(seq) >= 60), e AS (SELECT key, unnest(range(0, n + 1)) AS src, n FROM t)
  SELECT key, src, src + 1 AS dst FROM e UNION SELECT key, 10, n - 8 FROM t WHERE n % 2 = 0""")
def splice_edges(spark, d):
    """Whole turns as backbones with an intron from base 10 to the tenth from the end; those of odd length are excluded."""
    s = turns(spark, d).where(F.length("seq") >= 60)
    _, edges = graph.backbone(s, "key", "seq")
    n = F.length("seq").cast("long")
    sites = s.select("key", F.lit(10).cast("long").alias("left"), (n - 10).alias("right"), (n % 2 == 1).alias("excluded"))
    return graph.with_splice_sites(edges, sites, "key")
