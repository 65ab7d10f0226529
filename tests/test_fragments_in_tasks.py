"""Fragments are determinised many a task, from their text and haplotypes, without a row a node or a call a fragment between."""

import random

from pyspark.sql import functions as F
from test_fragments import KIND, shape

from loomseq.operators import fragments, graph, ranges
from loomseq.session import spool


def made(spark):
    """Haplotypes of several variants: out of order, null, empty, equal, of one name, with insertions at either end and spans of their whole."""
    r = random.Random(21)
    seqs = {"c1": "".join(r.choice("ACGT") for _ in range(700)), "c2": "".join(r.choice("ACGT") for _ in range(130)), "c3": "ACGTACGTAC"}
    haps = []
    for c, s in seqs.items():
        for k, p in enumerate(range(40, len(s) - 60, 45)):
            of = []
            for _ in range(r.randrange(4)):
                typ, at = r.choice(["single", "deletion", "insertion", "other"]), p + r.randrange(9)
                of.append((typ, at, r.randrange(1, 4), r.choice(["A", "C", "GT", "", None]) if typ != "single" else r.choice("ACGT")))
            if r.random() < 0.7:
                of.sort(key=lambda v: v[1])
            haps.append((c, f"h{k % 3}", p, p + 9, of))
            haps += [haps[-1], (c, "end", p + 2, p + 8, [("insertion", p + 8, 2, "TT")]), (c, None, p + 3, p + 3, [("deletion", p + 3, 1, None)])]
        haps.append((c, "none", 20, 22, None))
    return spark.createDataFrame(list(seqs.items()), "chrom string, seq string"), spool(spark.createDataFrame(haps, KIND), "haps")


def cuts_of(df, h, chunk):
    variants = h.select("chrom", F.explode("variants").alias("v")).select("chrom", "v.typ", "v.pos", "v.len")
    return spool(ranges.fragment_cuts(df.select("chrom", F.length("seq").cast("long").alias("length")), ranges.blocked_ranges(variants, "chrom", 14), "chrom", chunk), "cuts")


def test_as_graph_makes_them(spark):
    df, h = made(spark)
    whole = shape(*graph.determinize(*graph.with_haplotypes(*graph.backbone(df, "chrom", "seq"), h, "chrom"), "chrom"))
    for chunk in (60, 10_000):
        assert shape(*(spool(x, "graph") for x in fragments.build(df, h, cuts_of(df, h, chunk), "chrom", "seq", chunk))) == whole


def test_repeated_texts_stand_as_often(spark):
    df, h = made(spark)
    cuts = cuts_of(df, h, 60)
    nodes, edges = shape(*(spool(x, "graph") for x in fragments.build(df, h, cuts, "chrom", "seq", 60)))
    twice = shape(*(spool(x, "graph") for x in fragments.build(df.unionByName(df), h, cuts, "chrom", "seq", 60)))
    assert twice == (sorted(nodes * 2, key=str), sorted(edges * 4, key=str))


def test_no_call_a_fragment(spark, monkeypatch):
    plans = {}

    def kept(df, name="step"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return spool(df, name)

    for module in (fragments, graph):
        monkeypatch.setattr(module, "spool", kept)
    df, h = made(spark)
    fragments.build(df, h, cuts_of(df, h, 60), "chrom", "seq", 60)
    assert not [p for p in plans.values() if "FlatMapCoGroupsInPandas" in p]
    # texts and haplotypes are dealt out once, and nothing is dealt after it
    assert "MapInArrow" in plans["determinized"] and plans["determinized"].count("Exchange") == 1


def test_cuts_of_many_keys_a_call(spark):
    r = random.Random(4)
    lens = [(k, r.choice([None, 0, 1, 40, 200])) for k in (None, 1, 2, 3) for _ in range(2)]
    bad = [(k, a, a + r.randrange(1, 12)) for k in (None, 1, 3, 9) for a in range(r.randrange(20), 190, 23)]
    df = ranges.fragment_cuts(spark.createDataFrame(lens, "k long, length int"), spark.createDataFrame(bad, "k long, start long, stop long"), "k", 30)
    want = []
    for k, n in lens:
        a = 0
        while n is not None and a < n:
            b = a + 30
            b = min(n, next((y for x, s, y in bad if x == k and s <= b < y), b))
            want.append((k, a, b))
            a = b
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_cuts_of_one_table(spark):
    v = spark.createDataFrame([("c", "single", 40, 1), ("d", "single", 33, 1)], "chrom string, typ string, pos long, len long")
    blocked = ranges.blocked_ranges(v, "chrom", 3)
    cuts = ranges.fragment_cuts(v.groupBy("chrom").agg((F.max("pos") + 20).alias("length")), blocked, "chrom", 38)
    assert sorted(map(tuple, cuts.collect())) == [("c", 0, 45), ("c", 45, 60), ("d", 0, 38), ("d", 38, 53)]
    # the plan of both sides stands in it twice
    assert ranges.bad_cuts(cuts, blocked, "chrom", 16).count() == 0
