"""Readers of the text formats; rows that lack fields are dropped, as `dropped` counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import placed
from ..session import spool


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without a trailing carriage return."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (0-based place in its file) and line, for any number of files and of splits of a file.

    Lines are numbered within their split; what lies before it is the sum over the splits of its file, a row each.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = spool(rows, "lines")
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("file").orderBy("start")) - F.col("k")
    splits = splits.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("n"), "line")


def _fields(rows: DataFrame, sep: str, names: list[tuple[str, str]], *keep: str) -> DataFrame:
    parts = rows.select(*keep, F.split("line", sep).alias("f")).where(F.size("f") >= len(names))
    return parts.select(*[F.get("f", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)], *keep)


def dropped(rows: DataFrame, sep: str, least: int) -> int:
    return rows.where(F.size(F.split("line", sep)) < least).count()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header (whole line), name (its first word), seq: a record a row, read by the line that begins with '>'."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.expr("substring(value, instr(value, '\n') + 1)")
    return rows.select(header.alias("header"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.when(F.contains("value", F.lit("\n")), F.upper(F.regexp_replace(body, r"\s", ""))).otherwise("").alias("seq"))


def snp(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """id, typ, chrom, pos (0-based), allele, file, n (place in the file); a deletion's allele is its length.

    With `runs` (chrom, start, stop, joined, run_ix) variants outside a run are dropped, and joined_pos is added.
    """
    rows = _fields(numbered_lines(spark, path), "\t", [("id", "string"), ("typ", "string"), ("chrom", "string"), ("pos", "long"), ("allele", "string")], "file", "n")
    return rows if runs is None else placed(rows, runs, ["chrom"], {"pos": "joined_pos"}).where("joined_pos is not null").drop("joined_pos_run")


def index_variants(spark: SparkSession, path: str) -> DataFrame:
    """chrom (up to its first space), pos (1-based), alt of the substitutions of an index's variant table."""
    rows = _fields(lines(spark, path), "\t", [("id", "string"), ("typ", "string"), ("chrom", "string"), ("pos", "long"), ("allele", "string")])
    return rows.where("typ = 'single'").select(F.substring_index("chrom", " ", 1).alias("chrom"), (F.col("pos") + 1).alias("pos"), F.col("allele").alias("alt"))


def snp_positions(spark: SparkSession, path: str) -> DataFrame:
    """chrom without chr, pos (1-based), alt of a table chrom, pos (0-based), alt; other alleles than a base are dropped."""
    rows = _fields(lines(spark, path), "\t", [("chrom", "string"), ("pos", "long"), ("alt", "string")]).where(F.col("alt").isin(*"ACGT"))
    return rows.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), (F.col("pos") + 1).alias("pos"), "alt")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """gene, count of lines with two columns; lines of another width are ignored."""
    return _fields(lines(spark, path).where(F.size(F.split("line", "\t")) == 2), "\t", [("gene", "string"), ("count", "long")])


def resources(spark: SparkSession, path: str) -> DataFrame:
    """file, elapsed (h:mm:ss or m:ss), rss_kb, status of logs of a timing command, a row a file; null where a line is missing."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    of = lambda pattern: F.max(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    out = rows.groupBy("file").agg(of(r"Elapsed \(wall clock\) time .*: ([0-9:.]+)$").alias("elapsed"), of(r"Maximum resident set size \(kbytes\): (\d+)").alias("rss"), of(r"Exit status: (\d+)").alias("exit"))
    return out.select("file", "elapsed", F.col("rss").try_cast("long").alias("rss_kb"), F.col("exit").try_cast("int").alias("status"))


def haplotypes(spark: SparkSession, path: str, variants: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """hap, chrom, left, right (closed) and the array of variants; those that name an unknown id or none are dropped.

    Of variants with one id the last in the file counts. With `runs` so are those of which an end lies outside a run or
    that span two. Each line is a row, lines that repeat too.
    """
    rows = _fields(numbered_lines(spark, path), "\t", [("hap", "string"), ("chrom", "string"), ("left", "long"), ("right", "long"), ("ids", "string")], "file", "n")
    rows = rows.where("ids <> ''").withColumn("ids", F.split("ids", ","))
    size = F.when(F.col("typ") == "deletion", F.col("allele").try_cast("long")).otherwise(F.length("allele"))
    byid = variants.groupBy("id").agg(F.max_by(F.struct("typ", "pos", size.cast("long").alias("len"), F.col("allele").alias("seq")), F.struct("file", "n")).alias("v"))
    if runs is not None:
        rows = _within(rows, runs, ["left", "right"])
    each = rows.select("*", F.posexplode("ids").alias("i", "id")).join(byid, "id")
    out = each.groupBy("file", "n", "hap", "chrom", "left", "right", "ids").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"))
    return out.where(F.size("vs") == F.size("ids")).select("hap", "chrom", "left", "right", F.col("vs.v").alias("variants"))


def _within(rows: DataFrame, runs: DataFrame, ends: list[str]) -> DataFrame:
    """Rows whose `ends` all lie in one run of their chromosome."""
    out = placed(rows, runs, ["chrom"], {c: f"_{c}_at" for c in ends})
    same = [F.col(f"_{c}_at_run") == F.col(f"_{ends[0]}_at_run") for c in ends]
    for test in same:
        out = out.where(test)
    return out.select(rows.columns)


def splice_sites(spark: SparkSession, path: str, runs: DataFrame | None = None, exons: bool = False) -> DataFrame:
    """chrom, left, right, strand, with flanking bases turned into the first and last intron base; '#' lines are skipped.

    With `runs` a row stays if its own ends and the converted ones lie in one run; of `exons`, tables of the same form,
    only the converted ends count, and those without a base between are dropped.
    """
    rows = _fields(lines(spark, path).where("line not like '#%'"), r"\s+", [("chrom", "string"), ("left", "long"), ("right", "long"), ("strand", "string")])
    if runs is not None and not exons:
        rows = _within(rows, runs, ["left", "right"])
    rows = rows.withColumn("left", F.col("left") + 1).withColumn("right", F.col("right") - 1)
    if exons:
        rows = rows.where("left > 1 and right >= 0 and left < right")
    return rows if runs is None else _within(rows, runs, ["left", "right"])


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, start (0-based), stop, strand, gene (gene_name, else gene_id)."""
    rows = _fields(lines(spark, path).where("line not like '#%'"), "\t", [(c, "string") for c in ("chrom", "source", "feature", "start", "stop", "score", "strand", "frame", "attr")])
    of = lambda k: F.regexp_extract("attr", f'{k} "([^"]+)"', 1)
    return rows.select("chrom", "feature", (F.col("start").try_cast("long") - 1).alias("start"), F.col("stop").try_cast("long").alias("stop"), "strand", F.when(of("gene_name") != "", of("gene_name")).otherwise(of("gene_id")).alias("gene"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom without chr, start, stop."""
    return _fields(lines(spark, path), "\t", [("chrom", "string"), ("start", "long"), ("stop", "long")]).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def fai(spark: SparkSession, path: str) -> DataFrame:
    return _fields(lines(spark, path), "\t", [("name", "string"), ("length", "long")])


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """gene (no version), name, cell (no -1), cnt from matrix.mtx, features.tsv and barcodes.tsv; zeros are left out."""

    def numbered(name: str) -> DataFrame:
        # line numbers by file order; such lists are one file each
        rows = spark.read.text(f"{folder}/{name}", wholetext=True)
        return rows.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)

    features = numbered("features.tsv").select("i", F.substring_index(F.split("line", "\t")[0], ".", 1).alias("gene"), F.get(F.split("line", "\t"), F.lit(1)).alias("name"))
    cells = numbered("barcodes.tsv").select(F.col("i").alias("j"), F.regexp_replace("line", "-1$", "").alias("cell"))
    rows = lines(spark, f"{folder}/matrix.mtx").where("line not like '\\%%'").withColumn("id", F.monotonically_increasing_id())
    head = rows.agg(F.min("id").alias("id"))
    rows = rows.join(F.broadcast(head), "id", "left_anti")
    entries = _fields(rows.select("line"), r"\s+", [("i", "int"), ("j", "int"), ("cnt", "double")]).where("cnt <> 0")
    return entries.join(features, "i").join(cells, "j").select("gene", "name", "cell", "cnt")


def pileups(spark: SparkSession, path: str) -> DataFrame:
    return _fields(lines(spark, path), "\t", [("chrom", "string"), ("pos", "long"), *[(b, "long") for b in "acgt"]])


def sites(spark: SparkSession, path: str, phased: bool = False) -> DataFrame:
    """chrom without chr, pos, ref, alt and with `phased` gt; rows of another width are dropped."""
    names = [("chrom", "string"), ("pos", "long"), ("ref", "string"), ("alt", "string")] + ([("gt", "string")] if phased else [])
    rows = lines(spark, path).where(F.size(F.split("line", "\t")) == len(names))
    return _fields(rows, "\t", names).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, chrom, pos, mapq, cigar and a map of tags from the twelfth field on; of equal tags the first counts.

    What is no number where one belongs is null; lines of fewer than eleven fields are dropped.
    """
    f = F.split("line", "\t")
    rows = lines(spark, path).where("line not like '@%'").where(F.size(f) >= 11)
    found = F.filter(F.slice(f, F.lit(12), F.size(f)), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:.:"))
    names = F.transform(found, lambda t: F.substring(t, 1, 2))
    first = F.filter(found, lambda t, i: F.array_position(names, F.substring(t, 1, 2)) == i + 1)
    tags = F.map_from_entries(F.transform(first, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    return rows.select(f[0].alias("name"), f[1].try_cast("int").alias("flag"), f[2].alias("chrom"), f[3].try_cast("long").alias("pos"), f[4].try_cast("int").alias("mapq"), f[5].alias("cigar"), tags.alias("tags"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt and freqs: an array of (source, frequencies by allele) from the FREQ field."""
    rows = _fields(lines(spark, path).where("line not like '#%'"), "\t", [("chrom", "string"), ("pos", "long"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "string"), ("filter", "string"), ("info", "string")])
    freq = F.regexp_extract("info", r"(?:^|;)FREQ=([^;]*)", 1)
    one = lambda s: F.struct(F.substring_index(s, ":", 1).alias("source"), F.transform(F.split(F.substring_index(s, ":", -1), ","), lambda x: x.try_cast("double")).alias("f"))
    return rows.select("chrom", "pos", "id", "ref", "alt", F.when(freq == "", F.array().cast("array<struct<source:string,f:array<double>>>")).otherwise(F.transform(F.split(freq, r"\|"), one)).alias("freqs"))


def common(rows: DataFrame, low: float = 0.01, high: float = 0.99, longest: int = 50) -> DataFrame:
    """Variants that some source gives an alternative frequency between the limits; no symbolic or long alleles."""
    seen = F.exists("freqs", lambda s: F.exists(F.slice(s["f"], F.lit(2), F.size(s["f"])), lambda x: F.coalesce(x.between(low, high), F.lit(False))))
    return rows.where(seen & (F.length("ref") <= longest) & ~F.col("alt").contains("<") & (F.array_max(F.transform(F.split("alt", ","), F.length)) <= longest))


def fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of four-line records, with the file and the record's place in it: file, record."""
    at = numbered_lines(spark, path).select("file", F.expr("n div 4").alias("record"), (F.col("n") % 4).alias("k"), "line")
    part = [F.max(F.when(F.col("k") == k, F.col("line"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))]
    out = at.groupBy("file", "record").agg(*part).where("seq is not null and head like '@%'")
    return out.select(F.regexp_extract("head", r"^@(\S+)", 1).alias("name"), "seq", F.coalesce("qual", F.lit("")).alias("qual"), "file", "record")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of four-line records of any number of files."""
    return fastq_records(spark, path).select("name", "seq", "qual")


def fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Mates by the place of their records in two files: record, name, seq1, qual1, seq2, qual2; records without a mate are dropped."""
    a = fastq_records(spark, first).select("record", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    return a.join(fastq_records(spark, second).select("record", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "record")


def build_log(spark: SparkSession, path: str) -> DataFrame:
    """gen, temp, nodes, ranks of lines such as 'Generation 4 (10 -> 8 nodes, 7 ranks)'."""
    pattern = r"Generation (\d+) \((\d+) -> (\d+) nodes, (\d+) ranks\)"
    rows = lines(spark, path).where(F.col("line").rlike(pattern))
    return rows.select(*[F.regexp_extract("line", pattern, i + 1).try_cast("long").alias(c) for i, c in enumerate(("gen", "temp", "nodes", "ranks"))])


def alignment_rate(spark: SparkSession, path: str) -> DataFrame:
    rate = F.regexp_extract("line", r"([0-9.]+)% overall alignment rate", 1)
    return lines(spark, path).where(rate != "").select(rate.try_cast("double").alias("percent"))


def mpileup(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos and a, c, g, t of mpileup lines; positions without any are left out.

    Read starts (^ and a quality), ends ($) and indels (+n or -n and n letters) don't count. An indel's length can't be
    used inside a regular expression, so the letters are folded with a count of those still to skip.
    """
    rows = _fields(lines(spark, path), "\t", [("chrom", "string"), ("pos", "long"), ("ref", "string"), ("depth", "long"), ("bases", "string")])
    text = F.regexp_replace(F.regexp_replace("bases", r"\^.", ""), r"\$", "")
    tokens = F.regexp_extract_all(text, F.lit(r"([+-][0-9]+|[^+0-9-])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("skip"), *[F.lit(0).cast("long").alias(b) for b in "acgt"])

    def step(s, x):
        up = F.upper(x)
        return F.when(x.rlike("^[+-]"), s.withField("skip", F.abs(x.try_cast("int")))).when(s["skip"] > 0, s.withField("skip", s["skip"] - 1)).otherwise(F.struct(F.lit(0).alias("skip"), *[(s[b] + (up == b.upper()).cast("long")).alias(b) for b in "acgt"]))

    out = rows.select("chrom", "pos", F.aggregate(tokens, zero, step).alias("n")).select("chrom", "pos", *[f"n.{b}" for b in "acgt"])
    return out.where("a + c + g + t > 0")


