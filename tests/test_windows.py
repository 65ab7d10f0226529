"""Windows thinned together until their index fits, against a search of each window alone."""

import random

from pyspark.sql import functions as F

from loomseq.operators import graph, index, thinning
from loomseq.session import spool

KIND = "key string, hap string, left long, right long, variants array<struct<typ:string,pos:long,len:long,seq:string>>"
CAP = 100


def haplotypes(rows):
    """A haplotype of its own for each variant (w, ix, pos, base)."""
    one = F.array(F.struct(F.lit("single").alias("typ"), F.col("pos").alias("pos"), F.lit(1).cast("long").alias("len"), F.col("base").alias("seq")))
    return rows.select("w", F.col("ix").cast("string").alias("hap"), F.col("pos").alias("left"), F.col("pos").alias("right"), one.alias("variants"))


def test_search_equals_windows_alone(spark):
    r = random.Random(3)
    texts, variants = {}, []
    for w in range(200):
        s = "".join(r.choice("ACGT") for _ in range(r.randrange(70, 90)))
        texts[f"w{w:03d}"] = s
        places = sorted(r.sample(range(2, len(s) - 2), r.randrange(1, 9)))
        variants += [(f"w{w:03d}", i, p, "ACGT"[("ACGT".index(s[p]) + 1 + r.randrange(3)) % 4]) for i, p in enumerate(places)]
    df = spark.createDataFrame(list(texts.items()), "w string, seq string")
    rows = spool(spark.createDataFrame(variants, "w string, ix long, pos long, base string"), "variants")
    got = thinning.search(rows, "w", ["pos", "ix"], lambda chosen: graph.exploded(df.join(chosen.select("w").distinct(), "w"), haplotypes(chosen), "w", "seq", CAP))
    kept = {}
    for x in got.collect():
        kept.setdefault(x["w"], []).append(x["ix"])
    # every number of variants of every window as a window of its own, in one call
    each, many, of = [], [], {}
    for w, s in texts.items():
        own = [v for v in variants if v[0] == w]
        of[w] = len(own)
        for k in range(1, len(own) + 1):
            many.append((f"{w}:{k}", s))
            each += [(f"{w}:{k}", *own[i][1:]) for i in thinning.evenly(len(own), k)]
    bad = graph.exploded(spark.createDataFrame(many, "w string, seq string"), haplotypes(spark.createDataFrame(each, "w string, ix long, pos long, base string")), "w", "seq", CAP)
    bad = {x["w"] for x in bad.collect()}
    want = {}
    for w, n in of.items():
        k = thinning.largest_fit(n, lambda k, w=w: k == 0 or f"{w}:{k}" not in bad)
        if k:
            want[w] = thinning.evenly(n, k)
    assert {w: sorted(x) for w, x in kept.items()} == want
    sizes = [len(want.get(w, ())) == n for w, n in of.items()]
    assert 20 < sum(sizes) < 180  # some fit whole, some don't


def test_bounds_equal_a_scan(spark):
    texts = {"a": "ACGTACGGT", "b": "", "c": "AC", "d": "T" * 9, "e": "".join(random.Random(1).choice("ACGT") for _ in range(200))}
    got = {(x["doc"], x["slot"]): (x["lo"], x["hi"]) for x in index.kmer_bounds(spark.createDataFrame(list(texts.items()), "doc string, t string"), "doc", "t", 2).collect()}
    for name, t in texts.items():
        order = sorted((t[i:] + "~" for i in range(len(t) + 1)))
        end, want = 0, []
        for slot in range(16):
            word = "ACGT"[slot // 4] + "ACGT"[slot % 4]
            at = [i for i, s in enumerate(order) if s.startswith(word)]
            want.append((end, at[0] if at else end))
            end = at[-1] + 1 if at else end
        assert [got[name, s] for s in range(17)] == [*want, (end, len(order))]
