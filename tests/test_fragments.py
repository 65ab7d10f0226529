"""Graphs from fragments against graphs of whole sequences."""

import random

from pyspark.sql import functions as F

from loomseq.operators import fragments, graph, ranges
from loomseq.session import spool

KIND = "chrom string, hap string, left long, right long, variants array<struct<typ:string,pos:long,len:long,seq:string>>"


def shape(nodes, edges):
    """Nodes and edges by label and value, which any numbering keeps."""
    of = {(r["chrom"], r["id"]): (r["label"], r["value"]) for r in nodes.collect()}
    links = [(r["chrom"], *of[r["chrom"], r["src"]], *of[r["chrom"], r["dst"]]) for r in edges.collect()]
    return sorted(((k[0], *v) for k, v in of.items()), key=str), sorted(links, key=str)


def test_stitched_equals_whole(spark):
    r = random.Random(9)
    seqs = {"c1": "".join(r.choice("ACGT") for _ in range(1500)), "c2": "".join(r.choice("ACGT") for _ in range(400)), "c3": "ACGTACGTAC"}
    haps = []
    for c, s in seqs.items():
        for k, p in enumerate(range(60, len(s) - 80, 130)):
            other = "ACGT"[("ACGT".index(s[p]) + 1) % 4]
            haps += [(c, f"s{k}", p, p + 4, [("single", p, 1, other), ("single", p + 4, 1, "A" if s[p + 4] != "A" else "C")])]
            haps += [(c, f"d{k}", p + 6, p + 8, [("deletion", p + 6, 3, None)]), (c, f"i{k}", p + 12, p + 13, [("insertion", p + 12, 2, s[p + 10 : p + 12])])]
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    h = spool(spark.createDataFrame(haps, KIND), "haps")
    nodes, edges = graph.determinize(*graph.with_haplotypes(*graph.backbone(df, "chrom", "seq"), h, "chrom"), "chrom")
    whole = shape(nodes, edges)
    curve = graph.doubling(nodes, edges, "chrom")[1]
    variants = h.select("chrom", F.explode("variants").alias("v")).select("chrom", "v.typ", "v.pos", "v.len")
    blocked = spool(ranges.blocked_ranges(variants, "chrom", 30), "blocked")
    lengths = df.select("chrom", F.length("seq").cast("long").alias("length"))
    for chunk, least in ((70, 8), (333, 3), (10_000, 0)):
        cuts = spool(ranges.fragment_cuts(lengths, blocked, "chrom", chunk), "cuts")
        assert cuts.where("chrom = 'c1' and start > 0").count() >= least
        n, e = (spool(x, "graph") for x in fragments.build(df, h, cuts, "chrom", "seq", chunk))
        assert shape(n, e) == whole
        ids = sorted((x["chrom"], x["id"]) for x in n.collect())
        assert ids == [(c, i) for c in seqs for i in range(sum(x[0] == c for x in ids))]
        if chunk == 70:
            assert graph.doubling(n, e, "chrom")[1][-1] == curve[-1]
