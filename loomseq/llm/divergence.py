"""Source divergence audit: how the terms of each source differ from those of other sources and of their language.

For a pair of sources only the counts of a term on either side matter, so the terms that both have are tallied by their
(count, count) combination. Cells with a zero are implied: what a source's histogram of counts has beyond the tallied
cells is met by zero in the other source, and what neither has is the cell (0, 0). The divergence is then evaluated once
per combination and taken times its multiplicity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks, written

#: A term in UTF-8 (ASCII letters and all beyond ASCII), the scale of shares and what is added to counts.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE, ADDED = 1_000_000_000, 2
#: Entries of a task's tallies at which they are handed on, and groups up to which their table is broadcast.
TALLIES, MOST_GROUPS = 1 << 19, 1 << 16


def tallies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): sums of parts of the table, to be added up.

    Nulls are ''. A group without terms has a row with the term '' (no term is empty) and zeros, as has every other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, has) in held.items():
                terms = [b"", *n]
                counts = [0, *n.values()], [0, *map(has.__getitem__, n)]
                same = [pa.array([x], pa.string()).take(pa.array([0] * len(terms), pa.int32())) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()).cast(pa.string()), *[pa.array(c, pa.int64()) for c in counts]], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part, texts in text_chunks(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    n, has = held.setdefault((lang, source), (Counter(), Counter()))
                    terms = _TERM.findall((text or "").encode().lower())
                    n.update(terms)
                    has.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > TALLIES:
                    yield from out()
        yield from out()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(name(lang_col), name(source_col), F.col(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (n + ADDED * v)) in exact arithmetic, whatever the counts."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    return 1 + F.call_function("div", above, (n + ADDED * v).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the terms that at least `least_docs` of its documents have. Part `pair` has each other source of the
    language with the divergence summed over all kept terms; part `term` the `top` kept terms that a source has more often
    than its language, by divergence. Ranks count from 1 by value, descending, then item in order of UTF-8.

    Null texts have no terms; null languages and sources are ''. Groups without terms take part in pairs. A language
    without kept terms has pairs of value 0 and no terms. Rows that repeat count each. An empty table gives no rows;
    other columns are ignored.
    """
    each = tallies(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term of a language has one row for each source
    term = Window.partitionBy("lang", "term")
    each = each.withColumn("docs", F.sum("docs").over(term)).withColumn("in_lang", F.sum("n").over(term))
    kept = written(each.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "terms")
    groups = kept.where("term = ''").select("lang", "source")
    kept = kept.where("term <> ''")

    of_lang = kept.groupBy("lang", "term").agg(F.max("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("has"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("n_lang"), zero("n_group"), zero("has"))
    groups = written(groups, "groups")
    small = F.broadcast if groups.count() <= MOST_GROUPS else lambda df: df

    # the terms of sources against those of their language
    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("in_lang"), F.col("n_lang"), F.col("v"))
    more = kept.join(small(groups), ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    terms = more.select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    # each pair once, its sources in order: the second's columns end in 2
    second = groups.select("lang", *[F.col(c).alias(f"{c}2") for c in ("source", "n_group", "has")])
    pairs = written(groups.drop("n_lang").join(small(second), "lang").where("source < source2"), "pairs")
    a, b = kept.select("lang", "term", "source", F.col("n").alias("c")), kept.select("lang", "term", F.col("source").alias("source2"), F.col("n").alias("c2"))
    pair, cell = ["lang", "source", "source2"], ["c", "c2"]
    both = written(a.join(b, ["lang", "term"]).where("source < source2").groupBy(*pair, *cell).agg(F.count("*").alias("times")), "joint")
    times = lambda x: F.col("times") * x
    hist = kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("times"))
    hist2 = hist.withColumnsRenamed({"source": "source2", "c": "c2"})
    none = F.lit(0).cast("long")
    cells = [
        both,
        # a source's counts are met by zero unless the other has the term
        both.withColumn("c2", none).withColumn("times", times(-1)),
        both.withColumn("c", none).withColumn("times", times(-1)),
        pairs.select(*pair).join(hist, ["lang", "source"]).select(*pair, "c", none.alias("c2"), "times"),
        pairs.select(*pair).join(hist2, ["lang", "source2"]).select(*pair, none.alias("c"), "c2", "times"),
        # terms that neither has
        both.withColumn("c", none).withColumn("c2", none),
        pairs.select(*pair, none.alias("c"), none.alias("c2"), (F.col("v") - F.col("has") - F.col("has2")).alias("times")),
    ]
    joint = cells[0].select(*pair, *cell, "times")
    for x in cells[1:]:
        joint = joint.unionByName(x.select(*pair, *cell, "times"))
    joint = joint.groupBy(*pair, *cell).agg(F.sum("times").alias("times")).where("times > 0")
    sizes = small(pairs.select(*pair, "v", "n_group", "n_group2"))
    f = apart(share(F.col("c"), F.col("n_group"), F.col("v")), share(F.col("c2"), F.col("n_group2"), F.col("v")))
    sums = joint.join(sizes, pair).groupBy(*pair).agg(F.sum(times(f)).alias("value"))
    sums = pairs.select(*pair).join(sums, pair, "left").select(*pair, zero("value"))
    # p and q may be exchanged, so a pair's value is that of both directions
    ways = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("source2").alias("item")), F.struct(F.col("source2").alias("source"), F.col("source").alias("item"))))
    sums = sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(sums, "pair").unionByName(out(terms, "term").where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
  g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
  c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
  l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1), s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
    FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
  o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
