"""What must not grow faster than its input: no rows for pairs, no shuffle where a text is enough."""

import random

from pyspark.sql import functions as F

from loomseq.operators import ranges


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_sums_within(spark):
    r = random.Random(3)
    pts = [(r.randrange(3), r.randrange(40), r.choice([None, 1, 5])) for _ in range(3000)]
    ivs = [(r.randrange(4), i, a, a + r.randrange(30)) for i, a in ((i, r.randrange(-5, 45)) for i in range(500))]
    p, iv = spark.createDataFrame(pts, "key long, p long, v long"), spark.createDataFrame(ivs, "key long, name long, start long, stop long")
    df = ranges.sums_within(p, iv, ["key"], "p", {"n": F.lit(1), "v": F.col("v")})
    want = [(k, i, a, b, sum(x[0] == k and a <= x[1] < b for x in pts), sum(x[2] or 0 for x in pts if x[0] == k and a <= x[1] < b)) for k, i, a, b in ivs]
    got = df.select("key", "name", "start", "stop", "n", "v").collect()
    # a key without points has nothing to sum
    assert sorted(map(tuple, got)) == sorted(want)


def places(spark, of):
    texts = {1: "NACGNNTTN", 2: "ACGT" * 700 + "N" * 300 + "TTTT", 3: "", 4: None, 5: "NNNN", 6: "N" * 60 + "A"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = of(df)
    assert shuffles(got) == 0
    return texts, sorted(tuple(r) for r in got.collect())


def test_places_without_shuffle(spark):
    texts, got = places(spark, lambda df: ranges.text_places(df, "t", 3).select("k", "pos", F.col("joined") + F.col("pos") - F.col("start")))
    assert got == sorted((k, p, sum(c != "N" for c in t[:p]) if t[p] != "N" else None) for k, t in texts.items() if t for p in range(0, len(t), 3))


def test_spans_without_shuffle(spark):
    texts, got = places(spark, lambda df: ranges.text_places(df, "t", 2, 4).where("pos + 4 < stop").select("k", "pos"))
    assert got == [(k, p) for k, t in texts.items() if t for p in range(0, len(t) - 4, 2) if "N" not in t[p : p + 5]]


def test_windows_without_shuffle(spark):
    texts, got = places(spark, lambda df: ranges.text_windows(df, "t", 50, 40))
    inside = lambda t: sum(c != "N" for c in t)
    assert got == [(k, w, inside((t or "")[: 40 * w]), inside((t or "")[40 * w : 40 * w + 50])) for k, t in texts.items() for w in range(max(1, -(-len(t or "") // 40)))]


def test_packed_in_bulk(spark):
    from loomseq.functions import sequence

    r = random.Random(7)
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 1, 30, 31, 32, 62, 100)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "A" * 31 + "N", "acgt"]], "t string").withColumn("p", sequence.pack_text(F.col("t")))
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.select("t", "p", sequence.unpack_text(F.col("p"), F.length("t")).alias("back")).collect()
    digits = lambda x: sum("ACGT".index(c) * 4 ** (len(x) - 1 - j) for j, c in enumerate(x))
    for row in rows[: len(texts)]:
        assert row["back"] == row["t"] and row["p"] == [digits(row["t"][j : j + 31]) for j in range(0, len(row["t"]), 31)]
    assert [x["p"] for x in rows[-3:]] == [None, [0, None], [27]] and [x["back"] for x in rows[-3:]] == [None, None, "ACGT"]


def test_lf_without_shuffle(spark):
    from loomseq.operators import index

    df = spark.createDataFrame([(1, "ACGTNNACGTA"), (2, ""), (3, None), (4, "A" * 300)], "k long, t string")
    got = index.text_lf(df, "k", "t")
    assert shuffles(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.lf(index.bwt(df, "k", "t"), "k").collect())) == sorted(map(tuple, index.text_lf(df, "k", "t", 20).collect()))


def test_block_counts_without_shuffle(spark):
    from loomseq.operators import index

    df = spark.createDataFrame([(1, "ACGTNNACGTA" * 9), (2, ""), (3, None), (4, "A" * 300)], "k long, t string")
    got = index.block_counts(df, "k", "t")
    assert shuffles(got) == 0
    want = index.bwt(df, "k", "t").groupBy("k", F.expr("row div 64"), "bwt").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, index.block_counts(df, "k", "t", long=200).collect()))


def test_flanks_counted_in_tasks(spark):
    r = random.Random(5)
    texts = {i: "".join(r.choice("ACGTN") for _ in range(r.choice([0, 7, 8, 9, 60]))) for i in range(40)} | {99: None}
    df = spark.createDataFrame(list(texts.items()), "k0 long, t string")
    pairs = [(i, p, t[p : p + 2], t[p + 5 : p + 7]) for i, t in texts.items() if t for p in range(len(t) - 6)]
    sites, counts = ranges.flank_sites(df, "t", 2, 3, "ACGNT", 3), ranges.flank_counts(df, "t", 2, 3, "ACGNT")
    number = lambda x: sum("ACGNT".index(c) * 5 ** (len(x) - 1 - j) for j, c in enumerate(x))
    assert shuffles(sites) == 0
    assert sorted(map(tuple, sites.collect())) == [(i, p, number(a + b)) for i, p, a, b in pairs if p % 3 == 0]
    whole = [number(a + b) for _, _, a, b in pairs]
    assert sorted(map(tuple, counts.collect())) == sorted((k, whole.count(k)) for k in set(whole))


def test_flank_pairs_as_numbers(spark):
    r = random.Random(6)
    texts = {i: "".join(r.choice("ACGTN") for _ in range(r.choice([0, 39, 40, 41, 90]))) for i in range(20)} | {99: None}
    df = spark.createDataFrame(list(texts.items()), "k0 long, t string")
    got = ranges.flank_pair_sites(df, "t", 16, 8, "ACGNT")
    assert shuffles(got) == 0
    number = lambda x: sum("ACGNT".index(c) * 5 ** (15 - j) for j, c in enumerate(x))
    assert sorted(map(tuple, got.collect())) == [(i, p, number(t[p : p + 16]), number(t[p + 24 : p + 40])) for i, t in texts.items() if t for p in range(len(t) - 39)]


def test_marker_pairs_are_made_where_counted(spark):
    from loomseq import catalog

    df = catalog.queries()["marker_jaccard"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # from the top: the pairs' count, then their making, then the deal by first side
    assert 0 < plan.index("Generate explode") < plan.index("RepartitionByExpression [sa")
