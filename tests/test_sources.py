from pyspark.sql import functions as F

from loomseq.operators import graph, ranges
from loomseq.sources import readers, writers
from loomseq.streaming import telemetry


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_text_formats(spark, tmp_path):
    p = put(tmp_path, "a.mpileup", "chr1\t5\tA\t4\t^]A$c+2GTg-1a*T\nchr1\t6\tA\t0\t*\n")
    assert rows(readers.mpileup(spark, p)) == [("chr1", 5, 1, 1, 1, 1)]
    p = put(tmp_path, "a.gtf", '#x\nchr1\ts\texon\t11\t20\t.\t-\t.\tgene_id "g1"; gene_name "N1";\nchr1\ts\texon\t1\t2\t.\t+\t.\tgene_id "g2";\nshort\n')
    assert rows(readers.gtf(spark, p)) == [("chr1", "exon", 0, 2, "+", "g2"), ("chr1", "exon", 10, 20, "-", "N1")]
    p = put(tmp_path, "a.vcf", "#h\n1\t9\tr1\tA\tC\t.\t.\tRS=1;FREQ=x:0.9,0.1|y:1,.\n1\t10\tr2\tA\tC\t.\t.\tFREQ=x:0.999,0.001\n1\t11\tr3\tA\t<DEL>\t.\t.\tFREQ=x:0.5,0.5\n")
    assert [r["id"] for r in readers.common(readers.vcf(spark, p)).collect()] == ["r1"]
    p = put(tmp_path, "a.sam", "@HD\nr1\t0\tchr1\t7\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tNH:i:1\tGN:Z:abc\nbad\n")
    r = readers.sam(spark, p).first()
    assert (r["pos"], r["tags"]) == (7, {"NH": "1", "GN": "abc"})
    p = put(tmp_path, "a.log", "x\nGeneration 4 (10 -> 8 nodes, 7 ranks)\n95.5% overall alignment rate\n")
    assert rows(readers.build_log(spark, p)) == [(4, 10, 8, 7)]
    assert rows(readers.alignment_rate(spark, p)) == [(95.5,)]
    p = put(tmp_path, "a.tsv", "chr1\t5\tA\tC\nchr1\t5\tA\nchrX\t9\tG\tT\n")
    assert rows(readers.sites(spark, p)) == [("1", 5, "A", "C"), ("X", 9, "G", "T")]
    assert readers.dropped(readers.lines(spark, p), "\t", 4) == 1
    p = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@I\n")
    assert rows(readers.fastq(spark, p)) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@I")]


def test_matrix(spark, tmp_path):
    put(tmp_path, "matrix.mtx", "%%MatrixMarket\n%x\n2 2 3\n1 1 5\n2 2 7\n1 2 0\n")
    put(tmp_path, "features.tsv", "g1.4\tA\tkind\ng2\tB\tkind\n")
    put(tmp_path, "barcodes.tsv", "AAA-1\nCCC-1\n")
    assert rows(readers.matrix(spark, str(tmp_path))) == [("g1", "A", "AAA", 5.0), ("g2", "B", "CCC", 7.0)]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 40), ("b", "N")], "name string, seq string")
    writers.fasta(df, str(tmp_path / "o.fa"))
    assert rows(readers.fasta(spark, str(tmp_path / "o.fa")).select("name", "seq")) == rows(df)


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = telemetry.windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    of = lambda df: rows(df.select(F.col("start").cast("string"), "event_type", "n", F.round("total", 6)))
    assert of(spark.table("w")) == of(telemetry.windows(table))


def test_fasta_header_with_mark(spark, tmp_path):
    p = put(tmp_path, "h.fa", ">c1 a>b desc\r\nAC\r\nGT\r\n>c2\nnn\n>c3")
    assert rows(readers.fasta(spark, p).select("header", "name", "seq")) == [("c1 a>b desc", "c1", "ACGT"), ("c2", "c2", "NN"), ("c3", "c3", "")]


def test_fastq_folder_and_pairs(spark, tmp_path):
    (tmp_path / "q").mkdir()
    a = put(tmp_path / "q", "a.fq", "@r1/1\nAC\n+\nII\n@r2/1\nGT\n+\nII\n")
    b = put(tmp_path / "q", "b.fq", "@r1/2\nTT\n+\nJJ\n@r2/2\nGG\n+\nJJ\n")
    assert [r["name"] for r in readers.fastq(spark, str(tmp_path / "q")).orderBy("name").collect()] == ["r1/1", "r1/2", "r2/1", "r2/2"]
    got = rows(readers.fastq_pairs(spark, a, b))
    assert got == [(0, "r1/1", "AC", "II", "TT", "JJ"), (1, "r2/1", "GT", "II", "GG", "JJ")]


def test_lines_keep_their_place(spark, tmp_path):
    p = put(tmp_path, "n.txt", "".join(f"{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = readers.numbered_lines(spark, p).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5000 and all(str(r["n"]) == r["line"] for r in got)


def test_rows_outside_runs_are_dropped(spark, tmp_path):
    runs = spark.createDataFrame([("c", 10, 20, 0, 0), ("c", 30, 40, 10, 1)], "chrom string, start long, stop long, joined long, run_ix long")
    p = put(tmp_path, "v.snp", "v1\tsingle\tc\t12\tA\nv2\tsingle\tc\t25\tA\nv3\tsingle\tc\t31\tA\nv1\tsingle\tc\t11\tG\n")
    v = readers.snp(spark, p, runs)
    assert rows(v.select("id", "pos", "joined_pos")) == [("v1", 11, 1), ("v1", 12, 2), ("v3", 31, 11)]
    p = put(tmp_path, "h.ht", "h1\tc\t11\t15\tv1\nh2\tc\t12\t31\tv1,v3\nh3\tc\t9\t12\tv1\nh4\tc\t11\t12\tv2\nh5\tc\t11\t12\t\n")
    got = readers.haplotypes(spark, p, v, runs).collect()
    # the last v1 of the file counts, though its position is the smaller one
    assert [(r["hap"], [(x["pos"], x["seq"]) for x in r["variants"]]) for r in got] == [("h1", [(11, "G")])]
    # both ends of the row and the converted ones; exons only the converted
    p = put(tmp_path, "s.ss", "#x\nc\t10\t19\t+\nc\t9\t19\t+\nc\t15\t35\t-\n")
    assert rows(readers.splice_sites(spark, p, runs)) == [("c", 11, 18, "+")]
    assert rows(readers.splice_sites(spark, p, runs, exons=True)) == [("c", 10, 18, "+"), ("c", 11, 18, "+")]


def test_small_tables(spark, tmp_path):
    p = put(tmp_path, "i.tsv", "r1\tsingle\tchr1 x\t4\tA\nr2\tdeletion\tchr1\t9\t3\n")
    assert rows(readers.index_variants(spark, p)) == [("chr1", 5, "A")]
    p = put(tmp_path, "p.tsv", "chr1\t4\tA\nchr2\t4\tAC\n")
    assert rows(readers.snp_positions(spark, p)) == [("1", 5, "A")]
    p = put(tmp_path, "c.tsv", "g1\t5\ng2\t6\tx\n")
    assert rows(readers.counts(spark, p)) == [("g1", 5)]
    p = put(tmp_path, "time.log", "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tMaximum resident set size (kbytes): 2048\n\tExit status: 0\n")
    r = readers.resources(spark, p).first()
    assert (r["elapsed"], r["rss_kb"], r["status"]) == ("1:02.50", 2048, 0)
    p = put(tmp_path, "many.sam", "r1\t0\tchr1\t7\t60\t5M\t*\t0\t0\tACGTA\tIIIII\t" + "\t".join(f"{a}{b}:i:1" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijk") + "\n")
    assert len(readers.sam(spark, p).first()["tags"]) == 26 * 47


def test_no_local_folder_on_a_cluster():
    from loomseq import session

    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    class Table:
        sparkSession = Session

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
    try:
        session.spool(Table)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError


def test_lines_that_repeat_or_are_wrong(spark, tmp_path):
    """Each reader on repeated lines, short lines, words for numbers, numbers too long, repeated tags, blanks and a carriage return."""
    p = put(tmp_path, "v.snp", "a\tsingle\tc\t5\tA\na\tsingle\tc\t6\tC\nb\tdeletion\tc\tx\t2\nshort\tsingle\nc\tdeletion\tc\t9\tlong\r\n")
    variants = readers.snp(spark, p)
    assert [tuple(r) for r in variants.orderBy("n").select("id", "pos", "allele").collect()] == [("a", 5, "A"), ("a", 6, "C"), ("b", None, "2"), ("c", 9, "long")]
    p = put(tmp_path, "h.txt", "h0\tc\t5\t6\ta\nh0\tc\t5\t6\ta\nh0\tc\t5\t7\ta\nh1\tc\t5\t6\ta,none\nh2\tc\tx\t6\ta\nh3\tc\t5\t6\t\nh4\tc\n")
    got = readers.haplotypes(spark, p, variants)
    assert rows(got.select("hap", "left", "right"))[:2] == [("h0", 5, 6), ("h0", 5, 6)] and got.count() == 4
    p = put(tmp_path, "b.sam", "r\tx\tc\t99999999999999999999\t?\t5M\t*\t0\t0\tA\tI\tNH:i:1\tNH:i:2\tbad\tGN:Z:\n" + "r\t0\tc\t1\t60\t5M\t*\t0\t0\tA\tI\n" * 2)
    got = [tuple(r) for r in readers.sam(spark, p).select("flag", "pos", "mapq", "tags").collect()]
    assert got == [(None, None, None, {"NH": "1", "GN": ""}), (0, 1, 60, {}), (0, 1, 60, {})]
    p = put(tmp_path, "c.txt", "g\t1\ng\t1\nh\tx\ni\t99999999999999999999\nj\n")
    assert rows(readers.counts(spark, p)) == [("g", 1), ("g", 1), ("h", None), ("i", None)]
    p = put(tmp_path, "t.log", "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.5\n\tMaximum resident set size (kbytes): 99999999999999999999\n\tExit status: 0\nGeneration 4 (1 -> 99999999999999999999 nodes, 7 ranks)\n1.2.3% overall alignment rate\n")
    assert [tuple(r)[1:] for r in readers.resources(spark, p).collect()] == [("1:02.5", None, 0)]
    assert rows(readers.build_log(spark, p)) == [(4, 1, None, 7)] and rows(readers.alignment_rate(spark, p)) == [(None,)]
    p = put(tmp_path, "s.txt", "# x\nc 5 9 +\nc 5 9 +\nc five 9 +\nc 5\n")
    assert rows(readers.splice_sites(spark, p)) == [("c", None, 8, "+"), ("c", 6, 8, "+"), ("c", 6, 8, "+")]
    p = put(tmp_path, "b.bed", "chr1\t1\t2\nchr1\t1\t2\nchr1\tx\t2\n\n")
    assert rows(readers.bed(spark, p)) == [("1", None, 2), ("1", 1, 2), ("1", 1, 2)]
    p = put(tmp_path, "x.fai", "a\t5\t0\na\tfive\t0\n")
    assert [tuple(r) for r in readers.fai(spark, p).collect()] == [("a", 5), ("a", None)]
    p = put(tmp_path, "g.gtf", 'c\ts\texon\tx\t20\t.\t-\t.\tgene_id "g"; gene_id "h";\n' * 2)
    assert rows(readers.gtf(spark, p)) == [("c", "exon", None, 20, "-", "g")] * 2
    p = put(tmp_path, "p.txt", "c\t1\t2\t3\t4\tx\nc\t1\t2\n")
    assert [tuple(r) for r in readers.pileups(spark, p).collect()] == [("c", 1, 2, 3, 4, None)]
    p = put(tmp_path, "m.txt", "c\t5\tA\t4\tA+999999999999C\nc\tx\tA\t1\tA\nc\t7\n")
    assert [r["pos"] for r in readers.mpileup(spark, p).collect()] == [5, None]
    p = put(tmp_path, "q.fq", "@r\nAC\n+\nII\n@r\nAC\n+\nII\n@cut\n")
    assert rows(readers.fastq(spark, p)) == [("r", "AC", "II")] * 2
    p = put(tmp_path, "v.vcf", "1\tx\tr\tA\tC\t.\t.\tFREQ=s:x,0.5\n" * 2 + "1\t2\n")
    got = readers.vcf(spark, p)
    assert got.count() == 2 and readers.common(got).count() == 2
    p = put(tmp_path, "i.snp", "r\tsingle\tchr1 x\tfive\tA\nr\tsingle\tchr1 x\t5\tA\n")
    assert rows(readers.index_variants(spark, p)) == [("chr1", None, "A"), ("chr1", 6, "A")]
    p = put(tmp_path, "f.fa", ">a x\nAC\n>a x\nAC\n>e\n")
    assert rows(readers.fasta(spark, p).select("name", "seq")) == [("a", "AC"), ("a", "AC"), ("e", "")]


def test_haplotypes_that_repeat_make_one_path(spark):
    nodes, edges = graph.backbone(spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string"), "chrom", "seq")
    kind = "chrom string, hap string, left long, right long, variants array<struct<typ:string,pos:long,len:long,seq:string>>"
    one = ("c", "h", 2, 4, [("single", 3, 1, "A")])
    other = ("c", "h", 2, 4, [("single", 3, 1, "C")])
    size = lambda haps: tuple(x.count() for x in graph.with_haplotypes(nodes, edges, spark.createDataFrame(haps, kind), "chrom"))
    assert size([one, one]) == size([one]) and size([one, other])[0] == size([one])[0] + 3


def test_writers_round_trip(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    df = spark.createDataFrame([("r1", "ACGT", "IIII"), ("r2", "G", "@")], "name string, seq string, qual string")
    writers.fastq(df.coalesce(1), at("a.fq"))
    assert rows(readers.fastq(spark, at("a.fq"))) == rows(df)
    df = spark.createDataFrame([("1", 3, 9), ("X", 0, 1)], "chrom string, start long, stop long")
    writers.bed(df, at("a.bed"))
    assert rows(readers.bed(spark, at("a.bed"))) == rows(df)
    df = spark.createDataFrame([("c", "exon", 0, 5, "+", "g1"), ("c", "gene", 7, 9, "-", "g 2")], "chrom string, feature string, start long, stop long, strand string, gene string")
    writers.gtf(df, at("a.gtf"))
    assert rows(readers.gtf(spark, at("a.gtf"))) == rows(df)
    df = spark.createDataFrame([("a", "x", 1.5), ("b", "y", None)], "k string, l string, v double")
    for gzip in (False, True):
        writers.tsv(df, at(f"t{gzip}"), gzip)
        assert rows(spark.read.option("sep", "\t").option("header", True).schema(df.schema).csv(at(f"t{gzip}"))) == rows(df)
    writers.keyed_json(df, at("j"), ["k", "l"], "v")
    assert rows(spark.read.text(at("j"))) == [('{"a|x":1.5}',), ('{"b|y":null}',)]


def test_intervals_that_touch_merge(spark):
    """Closed and half-open intervals alike: an end that equals the next start joins them, one more base doesn't."""
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 7), ("c", 8, 9), ("c", 2, 3), ("d", 5, 6)], "key string, start long, stop long")
    assert rows(ranges.merge_intervals(df, ["key"])) == [("c", 1, 7), ("c", 8, 9), ("d", 5, 6)]
