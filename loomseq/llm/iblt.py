"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, in DataFrame functions only.

A paragraph is a line, or a stretch of at most PIECE characters of a longer one. A table has CELLS cells in three parts,
and a digest is added to one cell of each part: the cell counts it and holds the exclusive or of its digests and of their
check values. A sketch of level n has 2**n tables, chosen by the leading bits of the digest, so that each takes few
digests; sketches of other levels are folded to the lower one. Two sketches are subtracted cell by cell, so common
paragraphs vanish; peeling then takes cells with a single digest, removes it from its other cells, and goes on until
nothing is left but the digests that only one of them has. A sketch is made larger until it can itself be peeled; so where
a difference is too large to peel, both sketches are peeled and what they hold is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Ranges, partitions

PIECE = 192
CELLS, PART, LOAD, ROUNDS, TRIES = 48, 16, 12, 10, 4
SALT, CHECK = 11, 77
LEAST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of the paragraphs (pieces of lines that aren't empty, cut at white space if there is any)."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}(?!\S)|[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.cast("long").alias("k"), h.cast("int").alias("h"))


def _check(key: Column) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(CHECK)), 32).cast("int")


def _entry(key: Column, sign: Column) -> Column:
    """A digest with its check value and its cells, one of each part, as the bits of a number."""

    def of(g: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1 << PART * i).cast("long"), F.pmod(F.shiftright(g, 8 * i), F.lit(PART)).cast("int"))
        return F.struct(sign.cast("int").alias("c"), key.alias("k"), _check(key).alias("h"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).alias("m"))

    return let(F.xxhash64(key, F.lit(SALT)), of)


def _bits() -> Column:
    return F.array(*[F.lit(1 << i).cast("long") for i in range(CELLS)])


def _add(x: Column, y: Column, sign: int) -> Column:
    return _cell(x["c"] + sign * y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"]))


def _put(cell: Column, entries: Column, bit: Column, sign: int) -> Column:
    """A cell with those entries added (1) or removed (-1) that belong to it."""
    return F.aggregate(F.filter(entries, lambda e: e["m"].bitwiseAND(bit) != 0), cell, lambda x, e: _add(x, e, sign))


def table(keys: Column) -> Column:
    """The cells of a set of digests."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))
    return let(F.transform(keys, lambda d: _entry(d, F.lit(1))), lambda es: F.transform(_bits(), lambda bit: _put(zero, es, bit, 1)))


def peel(cells: Column) -> Column:
    """The digests of a table or of a difference as an array of struct(c, k), c -1 for the second's; null if it gets stuck."""
    state = lambda cells, found, more: F.struct(cells.alias("cells"), found.alias("found"), F.lit(more).alias("more"))
    none = F.array().cast("array<struct<c:int,k:bigint>>")

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))

        def remove(es: Column) -> Column:
            rest = F.zip_with(s["cells"], _bits(), lambda cell, bit: _put(cell, es, bit, -1))
            more = F.transform(es, lambda e: F.struct(e["c"].alias("c"), e["k"].alias("k")))
            return F.when(F.size(es) == 0, s.withField("more", F.lit(False))).otherwise(state(rest, F.concat(s["found"], more), True))

        return F.when(s["more"], let(F.array_distinct(F.transform(pure, lambda x: _entry(x["k"], x["c"]))), remove)).otherwise(s)

    empty = lambda s: F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, True), step, lambda s: F.when(empty(s), s["found"]))


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _numbers(bits: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), _power(bits) - 1)


def _tables(keys: Column, level: Column) -> Column:
    """The cells of 2**level tables, one after another; keys are dealt out in two steps, by half of the bits each."""

    def part(keys: Column, bits: Column, skip: Column, p: Column) -> Column:
        """Digests whose bits after the first `skip` are p."""
        mine = lambda d: F.pmod(F.call_function("shiftrightunsigned", d, F.lit(64) - bits - skip), _power(bits)) == p
        return F.when(bits == 0, keys).otherwise(F.filter(keys, mine))

    def split(level: Column) -> Column:
        high = F.ceil(level / 2).cast("int")
        low = (level - high).cast("int")
        inner = lambda some: F.flatten(F.transform(_numbers(low), lambda q: table(part(some, low, high, q))))
        return F.flatten(F.transform(_numbers(high), lambda p: let(part(keys, high, F.lit(0), p), inner)))

    return let(level, split)


def _at(cells: Column, p: Column) -> Column:
    return F.slice(cells, (p * CELLS + 1).cast("int"), F.lit(CELLS))


def _decoded(cells: Column, level: Column) -> Column:
    """The digests that a sketch's cells hold, null if some table gets stuck."""
    each = F.transform(_numbers(level), lambda p: peel(_at(cells, p)))
    return let(each, lambda x: F.when(F.forall(x, lambda t: t.isNotNull()), F.transform(F.flatten(x), lambda e: e["k"])))


def sketch(keys: Column) -> Column:
    """struct(level, n, cells): the smallest sketch of a set of n digests from about LOAD digests a table that can be peeled.

    Should TRIES levels fail (digests that share all their cells), level is -1 and the cells are the digests themselves.
    """
    size = F.size(keys)
    least = F.when(size <= LOAD, F.lit(0)).otherwise(F.least(F.ceil(F.log2(size / F.lit(LOAD))).cast("int"), F.lit(40)))

    def attempt(n: int) -> Column:
        level = (least + F.lit(n)).cast("int")
        made = lambda cells: F.when(_decoded(cells, level).isNotNull(), F.struct(level.alias("level"), size.alias("n"), cells.alias("cells")))
        return let(_tables(keys, level), made)

    listed = F.transform(F.array_sort(keys), lambda d: _cell(F.lit(1), d, F.lit(0)))
    return F.coalesce(*[attempt(n) for n in range(TRIES)], F.struct(F.lit(-1).alias("level"), size.alias("n"), listed.alias("cells")))


def _held(s: Column) -> Column:
    """The digests of a sketch."""
    return F.when(s["level"] < 0, F.transform(s["cells"], lambda x: x["k"])).otherwise(_decoded(s["cells"], s["level"]))


def _folded(s: Column, level: Column, p: Column) -> Column:
    """Table p of a sketch folded to a level: the tables that it is split into are added up cell by cell."""
    many = _power(s["level"] - level)
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))
    of = lambda i: F.aggregate(F.sequence(F.lit(0).cast("long"), many - 1), zero, lambda x, j: _add(x, F.get(s["cells"], ((p * many + j) * CELLS + i).cast("int")), 1))
    return F.when(s["level"] == level, _at(s["cells"], p)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), of))


def difference(a: Column, b: Column) -> Column:
    """struct(a, b): how many digests only the first sketch has, only the second; from the sketches alone."""
    count = lambda es, sign: F.size(F.filter(es, lambda e: e["c"] == sign))
    pair = lambda x, y: F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"))

    def subtracted(level: Column) -> Column:
        one = lambda p: peel(F.zip_with(_folded(a, level, p), _folded(b, level, p), lambda x, y: _add(x, y, -1)))
        each = F.transform(_numbers(level), one)
        # a difference has as many digests as the sketches differ in size, at least; tables that can't hold them aren't tried
        fits = (level >= 0) & (F.abs(a["n"] - b["n"]) <= F.lit(2 * LOAD) * _power(level))
        return F.when(fits, let(each, lambda x: F.when(F.forall(x, lambda t: t.isNotNull()), let(F.flatten(x), lambda es: pair(count(es, 1), count(es, -1))))))

    compared = lambda x: pair(F.size(F.array_except(x["a"], x["b"])), F.size(F.array_except(x["b"], x["a"])))
    return F.coalesce(let(F.least(a["level"], b["level"]), subtracted), let(F.struct(_held(a).alias("a"), _held(b).alias("b")), compared))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of what two sketches hold; 1 for two empty ones."""
    return let(difference(a, b), lambda d: F.when(a["n"] + d["b"] == 0, F.lit(1.0)).otherwise((a["n"] - d["a"]) / (a["n"] + d["b"])))


def text_of(s: Column) -> Column:
    """A sketch as text: level and number of digests, then place, count, digests and check values of cells in use."""
    cells = F.transform(s["cells"], lambda x, i: F.when((x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0), F.concat_ws(":", i.cast("string"), x["c"].cast("string"), F.hex(x["k"]), F.hex(F.pmod(x["h"].cast("long"), F.lit(1 << 32))))))
    return F.concat_ws(" ", s["level"].cast("string"), s["n"].cast("string"), F.array_compact(cells))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Callable[[str], Column]]:
    """Rows (doc_id, text, guest) and `after`, which gives a column's value in the next document.

    Documents follow each other in descending order of id, hash of the text and text; after the last comes the first. They
    are dealt into ranges of about equal size, several for an id that many rows share. The first document of each range is
    also sent to the range before it, as a guest, so the only exchange of texts is the one by range.
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    ranges = Ranges(docs.select(key.alias("key")), "key", 4 * partitions(docs.sparkSession))
    bucket = ranges.number(F.col("key"), F.col("tag") / F.lit(2.0**64) + 0.5)
    order = F.struct(F.coalesce("key", F.lit(LEAST)).alias("key"), F.col("key").isNotNull().alias("given"), "tag")
    # one row a range, and the number of ranges is set above
    firsts = rows.select(order.alias("x"), bucket.alias("bucket")).groupBy("bucket").agg(F.max("x").alias("x"), F.count("*").alias("n")).orderBy(F.desc("bucket")).collect()
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))
    sent = F.array(own)
    if firsts:
        # by the number of a range: the key and the hash of its first document, and the range before it
        by = {r["bucket"]: (r["x"]["key"] if r["x"]["given"] else None, r["x"]["tag"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
        table_of = lambda j: F.get(F.array(*[F.lit(by[k][j] if k in by else None).cast("long") for k in range(max(by) + 1)]), bucket)
        guest = F.struct(table_of(2).cast("int").alias("bucket"), F.lit(True).alias("guest"))
        sent = F.when(F.col("key").eqNullSafe(table_of(0)) & (F.col("tag") == table_of(1)), F.array(own, guest)).otherwise(sent)
    rows = rows.select("doc_id", "key", "tag", "text", F.explode(sent).alias("to")).select("doc_id", "key", "tag", "text", "to.bucket", "to.guest")
    window = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("key"), F.desc("tag"), F.desc("text"))
    return rows, lambda c: F.lead(c).over(window)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by the beginning of the next document. Null texts count
    as empty, and empty texts have an empty sketch that is like (1.0) any other empty one. Null ids come last in the
    order; rows with one id follow each other by a hash of their text. A single row is its own next.
    """
    rows, after = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("next", after("text"))
    rows = rows.select("*", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"))
    rows = rows.select("*", sketch(digests(F.col("text"))).alias("a"), F.when(~F.col("guest"), sketch(digests(F.col("edited")))).alias("e"))
    rows = rows.select("*", after("a").alias("n")).where("not guest")
    a, e = F.col("a"), F.col("e")
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_of(a).alias("sketch"), text_of(e).alias("edited_sketch"), likeness(a, e).alias("near_edited"), likeness(a, F.col("n")).alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("sketch").alias("fingerprint"), F.col("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")
