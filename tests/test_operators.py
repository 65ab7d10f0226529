"""Operators against plain versions, and edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomseq import session
from loomseq.functions import sequence
from loomseq.operators import graph, index, ranges, ranks, thinning


@pytest.mark.parametrize("text", ["A", "AAAA", "GATTACA" * 30, "ACGT" * 17 + "N", "".join(random.Random(3).choices("ACGNT", k=500)), "été"])
def test_suffix_order(text):
    for end in "$~":
        full = text + end
        got = index.suffix_order(np.frombuffer(full.encode("utf-32-le"), "<u4")).tolist()
        assert got == sorted(range(len(full)), key=lambda i: full[i:])


def test_suffixes_and_kmers(spark):
    texts = {1: "GATTACAGATTACA" * 9, 2: "", 3: "A", 4: "ACGT" * 40, 5: None, 6: "NNNN"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = sorted((r["k"], r["row"], r["pos"], r["bwt"]) for r in index.bwt(df, "k", "t").collect())
    want = []
    for k, t in texts.items():
        if t is not None:
            full = t + "$"
            want += [(k, i, p, full[p - 1]) for i, p in enumerate(sorted(range(len(full)), key=lambda i: full[i:]))]
    assert got == sorted(want)
    table = {tuple(r) for r in index.kmer_table(df, "k", "t", 3).select("k", "kmer", "lo", "hi").collect()}
    assert table == {tuple(r) for r in index.kmer_trie(df, "k", "t", 3, size=8).select("k", "kmer", "lo", "hi").collect()}
    assert {(k, m): hi - lo for k, m, lo, hi in table} == Counter((k, t[i : i + 3]) for k, t in texts.items() if t for i in range(len(t) - 2))


def test_pack(spark):
    texts = ["", "A", "acgt", "T" * 31, "G" * 32, "ACGT" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sequence.unpack_text(sequence.pack_text(F.col("t")), F.length("t")).alias("back"))
    assert all(r["back"] == r["t"].upper() for r in df.collect())
    assert spark.createDataFrame([("ACN",)], "t string").select(sequence.pack2(F.col("t"))).first()[0] is None


def test_binomial_for_deep_sites(spark):
    df = spark.createDataFrame([(0, 0), (3, 10), (5, 10), (480, 1000), (2400, 5000)], "k long, n long")
    for r in df.select("k", "n", ranks.binomial_two_sided(F.col("k"), F.col("n")).alias("p")).collect():
        m = min(r["k"], r["n"] - r["k"])
        assert math.isclose(r["p"], min(1.0, 2 * sum(math.comb(r["n"], i) for i in range(m + 1)) / 2 ** r["n"]), rel_tol=1e-6)


def test_wilcoxon(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(-4, 6)) for g in (1, 2) for _ in range(40)] + [(3, 1)] * 9
    got = {r["g"]: r for r in ranks.wilcoxon(spark.createDataFrame(rows, "g long, d long"), ["g"], "d").collect()}
    assert set(got) == {1, 2}
    for g in (1, 2):
        d = pd.Series([x for k, x in rows if k == g and x])
        r, n = d.abs().rank(), len(d)
        ties = sum(t**3 - t for t in Counter(d.abs()).values())
        w = r[d > 0].sum()
        assert (got[g]["n"], got[g]["w_plus"]) == (n, w)
        assert math.isclose(got[g]["z"], (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))


def test_sign_p(spark):
    rows = spark.createDataFrame([(0, 0), (60, 40), (5, 5)], "u long, d long").select("u", "d", ranks.sign_p(F.col("u"), F.col("d")).alias("p")).collect()
    assert [round(r["p"], 6) for r in rows] == [1.0, round(math.erfc(2 / math.sqrt(2)), 6), 1.0]


def test_depth_matched(spark):
    df = spark.createDataFrame([(i, 300, 1000, 100) for i in range(200)] + [(500, 7, 7, 9), (501, 0, 5, 3)], "site long, x long, n long, depth long")
    one, two = (sorted(map(tuple, ranks.depth_matched(x, ["site"], "x", "n", "depth").collect())) for x in (df, df.repartition(3)))
    assert one == two and len(one) == 5 * 202
    assert abs(np.mean([r[-1] for r in one if r[0] < 200]) - 30) < 0.6
    assert {r[-1] for r in one if r[0] == 500} == {7} and {r[-1] for r in one if r[0] == 501} == {0}


def test_thinning(spark):
    assert thinning.largest_fit(10, lambda k: k <= 6) == 6 and thinning.largest_fit(10, lambda k: True) == 10 and thinning.largest_fit(4, lambda k: False) == 0
    assert thinning.evenly(10, 4) == [0, 2, 5, 7] and thinning.evenly(3, 0) == [] and thinning.evenly(2, 5) == [0, 1]
    df = spark.createDataFrame([(w, i, 2) for w in (1, 2) for i in range(5 * w)], "w long, ix long, len long")
    kept = sorted(tuple(r)[:2] for r in thinning.thin(df, ["w"], ["ix"], lambda rows: rows["len"].sum(), 12).collect())
    assert kept == [(1, i) for i in range(5)] + [(2, i * 10 // 6) for i in range(6)]


def test_fragments(spark):
    rng = random.Random(7)
    rows = [(c, rng.choice(["single", "deletion", "splice", "exon"]), rng.randrange(3000)) for c in "xy" for _ in range(25)]
    rows = [(c, t, p, p + 40 if t == "splice" else 3) for c, t, p in rows]
    lengths = {"x": 3100, "y": 90, "z": 700}
    bad = {c: set() for c in lengths}
    for c, t, p, n in rows:
        last = {"deletion": p + n, "splice": n + 1, "single": p + 1}.get(t)
        if last is not None:
            bad[c] |= set(range(max(0, p - 11), last + 10 + 1))
    want = []
    for c, n in lengths.items():
        a = 0
        while a < n:
            b = a + 200
            while b < n and b in bad[c]:
                b += 1
            want.append((c, a, min(b, n)))
            a = min(b, n)
    blocked = ranges.blocked_ranges(spark.createDataFrame(rows, "c string, typ string, pos long, len long"), "c", 10)
    cuts = ranges.fragment_cuts(spark.createDataFrame(list(lengths.items()), "c string, length long"), blocked, "c", 200)
    assert sorted(map(tuple, cuts.collect())) == want
    assert ranges.bad_cuts(cuts, blocked, "c", 64).count() == 0
    wrong = spark.createDataFrame([("x", min(bad["x"] - {0}), 3100)], "c string, start long, stop long")
    assert ranges.bad_cuts(wrong, blocked, "c", 64).count() == 1


def test_splice_edges(spark):
    _, edges = graph.backbone(spark.createDataFrame([("s", "ACGTACGTAC")], "k string, t string"), "k", "t")
    sites = spark.createDataFrame([("s", 3, 5, False), ("s", 2, 7, True)], "k string, left long, right long, excluded boolean")
    new = {tuple(r) for r in graph.with_splice_sites(edges, sites, "k").collect()} - {tuple(r) for r in edges.collect()}
    assert new == {("s", 3, 7)}


def test_stage_resumes(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for inputs in (["a"], ["a"], ["b"]):
        assert session.stage(spark, str(tmp_path), "nodes", inputs, build).count() == 5
    assert len(built) == 2
    next(tmp_path.glob("nodes-*/_SUCCESS")).unlink()
    for inputs in (["a"], ["b"]):
        session.stage(spark, str(tmp_path), "nodes", inputs, build)
    assert len(built) == 3
    with pytest.raises(ValueError, match="variants"):
        session.require(spark.range(0), "variants")
