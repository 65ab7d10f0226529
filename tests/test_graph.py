"""Golden numbers of a 200-base sequence with three substitutions in two haplotypes, and of single variants."""

import pytest
from pyspark.sql import functions as F

from loomseq.operators import graph, index, ranges, ranks
from loomseq.session import spool
from loomseq.sources import readers

#: Fixed value: the published fixture sequence.
TINY = "TTTCCTCATGCAATTCAAAACCATGTCCGTAATGTAGGCGAAATAGTAAACCATTTTACGGAGGATACCAAATTCCTCCTTATTCAGGACCTAACCTGAGGTAAACCAGGTCTCTCCGCCCCCTTATAAAAGCTGTTGCACCTAGCCAAGTTCAACGGCAGCTGCAATGGAAATAGGCAATGACGGATATATATTAAAAA"


def build(spark, tmp_path, snps, haps):
    (tmp_path / "t.fa").write_text(">chrT some words\n" + "\n".join(TINY[i : i + 60] for i in range(0, 200, 60)) + "\n")
    (tmp_path / "t.snp").write_text("".join("\t".join(r) + "\n" for r in snps))
    (tmp_path / "t.haplotype").write_text("".join("\t".join(r) + "\n" for r in haps))
    seq = readers.fasta(spark, str(tmp_path / "t.fa")).select(F.col("name").alias("chrom"), "seq")
    assert seq.first()["seq"] == TINY
    nodes, edges = graph.backbone(seq, "chrom", "seq")
    hap = readers.haplotypes(spark, str(tmp_path / "t.haplotype"), readers.snp(spark, str(tmp_path / "t.snp")))
    return graph.determinize(*graph.with_haplotypes(nodes, edges, hap, "chrom"), "chrom")


def test_tiny(spark, tmp_path):
    nodes, edges = build(spark, tmp_path, [(f"rs{i}", "single", "chrT", p, "A") for i, p in enumerate(("50", "80", "120"))], [("ht0", "chrT", "50", "80", "rs0,rs1"), ("ht1", "chrT", "120", "120", "rs2")])
    assert graph.repeated_predecessors(nodes, edges, "chrom").count() == 0
    paths, curve = graph.doubling(nodes, edges, "chrom")
    assert curve[0][1] == 236
    assert curve[-1][2] == curve[-1][3] == 241
    assert len(curve) == 6  # generations 0 to 5
    assert paths.count() == 241


def test_doubling_too_short(spark, tmp_path):
    nodes, edges = build(spark, tmp_path, [("v", "single", "chrT", "50", "A")], [("h", "chrT", "50", "50", "v")])
    with pytest.raises(RuntimeError):
        graph.doubling(nodes, edges, "chrom", most=1)


def test_single_variants(spark, tmp_path):
    for row, hap, want in ((("v", "deletion", "chrT", "50", "3"), ("h", "chrT", "50", "52", "v"), 203), (("v", "single", "chrT", "50", "A"), ("h", "chrT", "50", "50", "v"), 204)):
        nodes, edges = build(spark, tmp_path, [row], [hap])
        assert graph.paths0(nodes, edges, "chrom").count() == want


def test_global_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = ranks.row_numbers(df, [F.col("x")], "n", 5).collect()
    assert all(r["x"] == r["n"] for r in rows) and len(rows) == 1000


def test_bwt_inverts(spark):
    df = spark.createDataFrame([(1, "GATTACAGATTACA"), (2, ""), (3, "A")], "k long, t string")
    rows = {(r["k"], r["row"]): r["bwt"] for r in index.bwt(df, "k", "t").collect()}
    step = {(r["k"], r["row"]): r["to"] for r in index.lf(index.bwt(df, "k", "t"), "k").collect()}
    for k, t in ((1, "GATTACAGATTACA"), (2, ""), (3, "A")):
        at, out = 0, ""
        while rows[k, at] != "$":
            out, at = rows[k, at] + out, step[k, at]
        assert out == t


def test_runs_and_empty(spark):
    df = spark.createDataFrame([(1, "NNACGTNNA"), (2, ""), (3, "NNN"), (4, None)], "k long, t string")
    got = [tuple(r) for r in ranges.text_runs(df, "t").orderBy("k", "run_ix").collect()]
    assert got == [(1, 0, 2, 6, 2, 0), (1, 1, 8, 9, 2, 4)]
    none = spark.createDataFrame([], "key long, start long, stop long")
    assert ranges.merge_intervals(none, ["key"]).count() == 0


def test_insertions(spark, tmp_path):
    # 201 edges of the backbone; two inserted bases and the base after them take four more
    def count(snps, haps):
        nodes, edges = graph.backbone(spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string"), "chrom", "seq")
        h = spark.createDataFrame(haps, "chrom string, hap string, left long, right long, variants array<struct<typ:string,pos:long,len:long,seq:string>>")
        n, e = graph.with_haplotypes(nodes, edges, h, "chrom")
        return n.count() - nodes.count(), {(r["src"], r["dst"]) for r in e.collect()} - {(r["src"], r["dst"]) for r in edges.collect()}

    ins = ("insertion", 3, 2, "GG")
    # in the middle the walk goes on over the base at its position
    assert count([], [("c", "h", 3, 4, [ins])]) == (4, {(3, 10), (10, 11), (11, 12), (12, 13), (13, 6)})
    # at the end it stops there, and a substitution at the same place isn't taken
    assert count([], [("c", "h", 3, 3, [ins, ("single", 3, 1, "A")])]) == (2, {(3, 10), (10, 11), (11, 4)})
    # out of order: no haplotype
    assert count([], [("c", "h", 3, 5, [("single", 4, 1, "A"), ("single", 4, 1, "C")])]) == (0, set())


def test_ranks_of_generations_in_many_ranges(spark, tmp_path):
    """The same curve with one range and with many, so that rows at the ends of ranges see those before them."""
    nodes, edges = build(spark, tmp_path, [(f"rs{i}", "single", "chrT", p, "A") for i, p in enumerate(("50", "80", "120"))], [("ht0", "chrT", "50", "80", "rs0,rs1"), ("ht1", "chrT", "120", "120", "rs2")])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(graph.doubling(nodes, edges, "chrom", root=str(tmp_path / f"r{n}"), publish=str(tmp_path / f"c{n}"))[1])
            assert [tuple(r) for r in spark.read.parquet(str(tmp_path / f"c{n}")).orderBy("gen").collect()] == got[-1]
            # a second run finds every generation
            assert graph.doubling(nodes, edges, "chrom", root=str(tmp_path / f"r{n}"))[1] == got[-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] and got[0][-1][2] == 241


def test_first_match_keeps_points_with_nulls(spark):
    points = spark.createDataFrame([(1, 5, None), (1, 5, "x"), (1, 5, "x"), (2, 5, "y"), (None, 5, "z"), (1, None, "n")], "key long, p long, note string")
    iv = spark.createDataFrame([(1, 0, 3, "a"), (1, 2, 9, "b"), (1, 3, 5, "c"), (None, 0, 9, "d")], "key long, b_start long, b_stop long, name string")
    got = sorted(((r["key"], r["note"], r["name"]) for r in ranges.first_match(points, iv, ["key"], "p", "name").collect()), key=str)
    assert got == sorted([(1, None, "b"), (1, "x", "b"), (1, "x", "b"), (2, "y", None), (None, "z", None), (1, "n", None)], key=str)


def test_adjusted_p_in_many_ranges(spark):
    import random

    r = random.Random(5)
    p = [round(r.random() ** 3, 3) for _ in range(400)]
    order = sorted(p)
    want = {}
    least = 1.0
    for i in range(len(order) - 1, -1, -1):
        least = min(least, order[i] * len(p) / (i + 1))
        want.setdefault(order[i], least)
        want[order[i]] = min(want[order[i]], least)
    df = spark.createDataFrame([(x,) for x in p] + [(None,)], "p double").repartition(5)
    got = ranks.benjamini_hochberg(df, "p", "q").collect()
    assert len(got) == 401
    for row in got:
        assert row["q"] is None if row["p"] is None else abs(row["q"] - want[row["p"]]) < 1e-9
    assert ranks.benjamini_hochberg(df.where("p > 2"), "p", "q").count() == 0


TINY_SNPS = [(f"rs{i}", "single", "chrT", p, "A") for i, p in enumerate(("50", "80", "120"))]
TINY_HAPS = [("ht0", "chrT", "50", "80", "rs0,rs1"), ("ht1", "chrT", "120", "120", "rs2")]


@pytest.fixture(scope="module")
def tiny_index(spark, tmp_path_factory):
    nodes, edges = (spool(x, "tiny") for x in build(spark, tmp_path_factory.mktemp("tiny"), TINY_SNPS, TINY_HAPS))
    rows, at = graph.edge_rows(nodes, edges, graph.doubling(nodes, edges, "chrom")[0], "chrom")
    return nodes, edges, spool(rows, "rows"), spool(at, "at")


def test_rows_of_tiny(tiny_index):
    """The published numbers of this fixture: 240 nodes, 242 rows, 81 A, 58 C, 42 G and 60 T."""
    _, edges, rows, at = tiny_index
    assert at.count() == 240 and rows.count() == 242
    labels = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert labels == {"A": 81, "C": 58, "G": 42, "T": 60, "Z": 1}
    assert rows.where("f").count() == rows.where("m").count() == 240
    assert [r["row"] for r in rows.orderBy("row").collect()] == list(range(242))
    assert at.agg(F.sum(F.greatest("outdeg", F.lit(1)))).first()[0] == 242


def test_steps_spell_the_graph(spark, tiny_index):
    """Backward steps over a word find just the nodes from which the graph spells it."""
    nodes, edges, rows, at = tiny_index
    label = {r["id"]: r["label"] for r in nodes.collect()}
    after = {}
    for r in edges.collect():
        after.setdefault(r["src"], []).append(r["dst"])

    def starts(word):
        return {i for i in label if any(True for _ in walks(i, word))}

    def walks(i, word):
        if label[i] == word[0]:
            if len(word) == 1:
                yield i
            for j in after.get(i, ()):
                if len(word) > 1:
                    yield from walks(j, word[1:])

    words = {TINY[i : i + n] for i in range(0, 190, 7) for n in (1, 2, 3, 5, 9, 14)} | {TINY[45:50] + "A" + TINY[51:56], TINY[75:80] + "A" + TINY[81:90], "GGGGG", "ACGTN", "A" * 12, TINY[44:50] + "A" + TINY[51:80] + "A" + TINY[81:85], TINY[44:50] + "A" + TINY[51:90]}
    df = spark.createDataFrame([("chrT", w) for w in sorted(words)] + [("chrT", ""), ("chrT", None), ("chrU", "ACG")], "chrom string, word string")
    index = graph.tallied(rows, "chrom")
    got = {}
    for r in graph.nodes_of(graph.spelled(df, index, "chrom"), index, at, "chrom").collect():
        got.setdefault(r["word"], set()).add(r["src"])
    assert got == {w: s for w in words if (s := starts(w))}


def test_pointer_moves_on_mismatch_only(spark):
    """Streams in which sources recur in several runs on both sides, against one pointer over whole lists, in small ranges."""
    import random

    r = random.Random(7)
    for places in (3, 40, 1 << 20):
        nodes, edges, want = [], [], []
        for key in ("a", "b", "c", "d"):
            n = [r.choice("pqrs") for _ in range(r.randrange(1, 60))]
            kept = [x for x in n if r.random() < 0.6]
            e = [x for x in kept for _ in range(r.randrange(1, 3))]
            if key == "d":
                e.insert(len(e) // 2, "none")
            i, deg = 0, [0] * len(n)
            for x in e:
                while i < len(n) and n[i] != x:
                    i += 1
                if i == len(n):
                    break
                deg[i] += 1
            nodes += [(key, i, x) for i, x in enumerate(n)]
            edges += [(key, i, x) for i, x in enumerate(e)]
            want += [(key, i, x, d) for i, (x, d) in enumerate(zip(n, deg, strict=True))]
        got = graph.positional_out_degree(spark.createDataFrame(nodes, "key string, at long, src string").repartition(3), spark.createDataFrame(edges, "key string, no long, src string").repartition(3), "key", ["at"], ["no"], places)
        assert sorted((x["key"], x["at"], x["src"], x["outdeg"]) for x in got.collect()) == sorted(want)
