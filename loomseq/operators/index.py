"""Suffix order, BWT, LF steps and k-mer tables of whole sequences, a sequence per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, spool
from . import suffix_rows
from .graph import BLOCK, from_first, graph_step, tallied
from .ranks import row_numbers

#: Rows that a task hands on together.
ROWS = 1 << 17


def coded(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letters in order, and the place of each among them: what np.unique sorts for, by counts where codes are small."""
    if len(letters) and letters.max() > max(len(letters), 256):
        return np.unique(letters, return_inverse=True)
    there = np.bincount(letters) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[letters]


def suffix_order(letters: np.ndarray) -> np.ndarray:
    """Places in order of their suffixes, by prefix doubling; where one suffix begins another, the shorter comes first."""
    n = len(letters)
    _, rank = coded(letters)
    rank = rank.astype(np.int64) + 1
    # as many letters as fit make up the first key; 0 stands past the end
    bits = int(rank.max()).bit_length()
    step = max(1, 62 // bits)
    padded = np.concatenate([rank, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    # a rank is the place at which its group begins, so it changes within its group only
    at = np.arange(n)
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))] + 1
        at = at[~(head & np.r_[head[1:], True])]
        if not len(at):
            return order
        # only places that share a rank are ordered again
        pos = order[at]
        ahead = pos + step
        key = rank[pos] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        by = np.argsort(key)
        order[at], key = pos[by], key[by]
        step *= 2


#: Letters up to which a text is ordered within one task.
LONG = 1 << 22


def of_order(df: DataFrame, key: str, text: str, end: str, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], more: str) -> DataFrame:
    """The rows that `of` makes of each text's letters (`end` after them) and their suffix order; strings are given as code points."""
    fields = [f.split() for f in more.split(", ")]

    def column(parts: list[np.ndarray], kind: str) -> pa.Array:
        whole = np.concatenate(parts)
        if kind != "string":
            return pa.array(whole, pa.int64())
        codes, at = coded(whole)
        return pa.array([chr(c) for c in codes], pa.string()).take(pa.array(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of_row, size = [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer((t + end).encode("utf-32-le"), "<u4")
                got = of(letters, suffix_order(letters))
                held.append(got)
                of_row.append(np.full(len(got[0]), i))
                size += len(got[0])
                if size >= ROWS or i == len(batch) - 1:
                    cols = [batch.column(0).take(pa.array(np.concatenate(of_row))), *(column(x, k) for x, (_, k) in zip(zip(*held, strict=True), fields, strict=True))]
                    whole = pa.RecordBatch.from_arrays(cols, [key, *(n for n, _ in fields)])
                    for a in range(0, len(whole), ROWS):
                        yield whole.slice(a, ROWS)
                    held, of_row, size = [], [], 0

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, {more}")


def suffixes(df: DataFrame, key: str, text: str, end: str, long: int = LONG, letters: str | None = None) -> DataFrame:
    """key, row (place in order), pos (0-based, the empty suffix included) and bwt, the letter before it.

    `end` is put after the text and compares as a letter: '$' sorts ends first, '~' last. Null texts give no rows.
    Whole-text suffixes as strings would take quadratic room. Texts of up to `long` letters are ordered by numpy in
    linear room, each in one task; longer ones (below 0: all) with a row for each position, in many (`suffix_rows`). `letters` names the
    letters of the latter, which are looked up otherwise.
    """
    n = F.length(text)
    if df.where(n > long).limit(1).count():
        far = suffix_rows.ordered(df.where(n > long), key, text, end, letters)
        return suffixes(df.where(n <= long), key, text, end, long).unionByName(far) if long >= 0 else far
    return of_order(df, key, text, end, lambda letters, order: [np.arange(len(order)), order, letters[order - 1]], "row long, pos long, bwt string")


def text_lf(df: DataFrame, key: str, text: str, long: int = LONG) -> DataFrame:
    """`lf` of the rows of `bwt`: texts of up to `long` letters are stepped where they are ordered, without a shuffle."""
    n = F.length(text)
    if df.where(n > long).limit(1).count():
        return text_lf(df.where(n <= long), key, text, long).unionByName(lf(suffix_rows.ordered(df.where(n > long), key, text, "$"), key))

    def of(letters: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        to = np.empty(len(order), np.int64)
        to[np.argsort(letters[order - 1], kind="stable")] = np.arange(len(order))
        return [np.arange(len(order)), to]

    return of_order(df, key, text, "$", of, "row long, to long")


def block_counts(df: DataFrame, key: str, text: str, size: int = 64, long: int = LONG) -> DataFrame:
    """key, block, bwt, n: how often each letter of the BWT stands in each block of `size` rows, tallied where texts are ordered."""
    n = F.length(text)
    if df.where(n > long).limit(1).count():
        far = suffix_rows.ordered(df.where(n > long), key, text, "$").groupBy(key, F.floor(F.col("row") / size).alias("block"), "bwt").agg(F.count("*").alias("n"))
        return block_counts(df.where(n <= long), key, text, size, long).unionByName(far)

    def of(letters: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        codes, at = coded(letters[order - 1])
        count = np.bincount(np.arange(len(order)) // size * len(codes) + at)
        some = np.flatnonzero(count)
        return [some // len(codes), codes[some % len(codes)], count[some]]

    return of_order(df, key, text, "$", of, "block long, bwt string, n long")


def bwt(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, pos and the letter before each suffix ($ before the whole text)."""
    return suffixes(df, key, text, "$")


def lf(rows: DataFrame, key: str) -> DataFrame:
    """key, row and the row of the suffix one letter longer: the place of the row by its letter, then its place."""
    return from_first(row_numbers(rows.select(key, "row", "bwt"), [F.col(key), F.col("bwt"), F.col("row")], "to"), key, "to").select(key, "row", "to")


def inverse(rows: DataFrame, key: str, end: str = "$") -> DataFrame:
    """key, row and pos from key, row and bwt alone: how many letters stand before each suffix, by pointer jumping.

    A row's step leads to the suffix one letter longer, at last to the whole text, whose letter is the end. Every round
    doubles the steps behind a pointer, so the longest text takes as many joins as its length has bits.
    """
    steps = rows.join(lf(rows, key), [key, "row"])
    at = spool(steps.select(key, "row", (F.col("bwt") != end).cast("long").alias("pos"), F.when(F.col("bwt") != end, F.col("to")).alias("to")), "pointers")
    while at.where("to is not null").limit(1).count():
        ahead = at.select(key, F.col("row").alias("to"), F.col("pos").alias("_more"), F.col("to").alias("_next"))
        open_ = at.where("to is not null").join(ahead, [key, "to"]).select(key, "row", (F.col("pos") + F.col("_more")).alias("pos"), F.col("_next").alias("to"))
        old, at = at, spool(open_.unionByName(at.where("to is null")), "pointers")
        forget(old)
    return at.select(key, "row", "pos")


def bwt_text(text: Column, end: str = "$") -> Column:
    """The letters of a text's BWT in order of its rows; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            letters = np.frombuffer(((t or "") + end).encode("utf-32-le"), "<u4")
            out.append(None if t is None else letters[suffix_order(letters) - 1].tobytes().decode("utf-32-le"))
        return pa.array(out, pa.string())

    return run(text)


def inverse_text(bwt: Column, end: str = "$") -> Column:
    """The text of a BWT's letters, by the pointer jumping of `inverse` within the text; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            letters = np.frombuffer((t or end).encode("utf-32-le"), "<u4")
            to = np.empty(len(letters), np.int64)
            to[np.argsort(letters, kind="stable")] = np.arange(len(letters))
            pos, last = (letters != ord(end)).astype(np.int64), int(np.flatnonzero(letters == ord(end))[0])
            # the whole text's row leads to itself, and nothing is added there
            to[last] = last
            for _ in range(len(letters).bit_length()):
                pos, to = pos + pos[to], to[to]
            back = np.empty(len(letters), letters.dtype)
            back[pos] = letters
            out.append(None if t is None else back[1:].tobytes().decode("utf-32-le"))
        return pa.array(out, pa.string())

    return run(bwt)


def search(rows: DataFrame, key: str, letters: str) -> tuple[DataFrame, DataFrame, str]:
    """What `graph.spelled` looks up in a text's rows, which are those of a graph without branches; ends must sort last."""
    same = rows.select(key, "row", F.col("bwt").alias("label"), F.lit(True).alias("f"), F.lit(True).alias("m"))
    return tallied(same, key, letters)


def located(found: DataFrame, index: tuple[DataFrame, DataFrame, str], sampled: DataFrame, key: str) -> DataFrame:
    """`found` with a row for each of its rows [top, bot) and its pos.

    `sampled` (key, row, pos) has the rows of every so many positions, 0 among them. Rows that aren't there take backward
    steps together, a letter of the text a round, until they are.
    """
    names = [c for c in found.columns if c not in ("top", "bot")]
    at = found.select("*", F.explode(F.sequence(F.col("top"), F.col("bot") - 1)).alias("row")).select(*names, "row", F.lit(0).cast("long").alias("_steps"))
    out, blocks = None, index[0].select(key, "block", F.col("label").alias("_text"))
    while True:
        known = spool(at.join(sampled.select(key, "row", "pos"), [key, "row"], "left"), "located")
        here = known.where("pos is not null").select(*names, (F.col("pos") + F.col("_steps")).alias("pos"))
        out = here if out is None else out.unionByName(here)
        open_ = known.where("pos is null").drop("pos").withColumn("block", F.floor(F.col("row") / BLOCK)).join(blocks, [key, "block"])
        if not open_.limit(1).count():
            return out
        letter = F.substring(F.col("_text"), (F.col("row") - F.col("block") * BLOCK + 1).cast("int"), F.lit(1))
        open_ = open_.select(*names, "_steps", letter.alias("label"), F.col("row").alias("top"), (F.col("row") + 1).alias("bot"))
        at = graph_step(open_, index, key).select(*names, F.col("top").alias("row"), (F.col("_steps") + 1).alias("_steps"))


def found(df: DataFrame, key: str, text: str, words: str, letters: str, every: int = 8) -> DataFrame:
    """key, word, pos: all places of each text's own `words` (an array) in it, `search` and `located` within the text.

    Words take backward steps over the rows of the text's suffixes; rows that aren't sampled (each `every`-th position is)
    take steps until they are. Words with other letters than `letters` have no places.
    """

    def places(t: str, of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        full = np.frombuffer((t + "~").encode("utf-32-le"), "<u4")
        order = suffix_order(full)
        last = full[order - 1]
        upto = {c: np.r_[0, np.cumsum(last == ord(c))] for c in letters}
        first = {c: int((full < ord(c)).sum()) for c in letters}
        lf = np.zeros(len(full), np.int64)
        for c in letters:
            lf[last == ord(c)] = first[c] + np.arange(upto[c][-1])
        known = np.where(order % every == 0, order, -1)
        which, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(of):
            lo, hi = (0, len(full)) if w and set(w) <= set(letters) else (0, 0)
            for c in reversed(w):
                if lo < hi:
                    lo, hi = first[c] + int(upto[c][lo]), first[c] + int(upto[c][hi])
            rows.append(np.arange(lo, max(lo, hi)))
            which.append(np.full(len(rows[-1]), i))
        at, row = np.concatenate(which), np.concatenate(rows)
        pos, steps = known[row], np.zeros(len(row), np.int64)
        while (open_ := np.flatnonzero(pos < 0)).size:
            row[open_] = lf[row[open_]]
            steps[open_] += 1
            pos[open_] = known[row[open_]]
        return at, pos + steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, of) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if of:
                    at, pos = places(t, of)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(of, pa.string()).take(pa.array(at)), pa.array(pos)], [key, "word", "pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text, words).mapInArrow(run, f"{key} {kind}, word string, pos long")


def text_trie(df: DataFrame, key: str, text: str, k: int, letters: str = "ACGNT", long: int = LONG) -> DataFrame:
    """`kmer_trie` (key, kmer, lo, hi) with the steps taken where texts of up to `long` letters are ordered, without a shuffle.

    Letters before a row are counted by its place among the rows of that letter.
    """
    n = F.length(text)
    if df.where(n > long).limit(1).count():
        far = kmer_trie(df.where(n > long), key, text, k, letters).select(key, "kmer", "lo", "hi")
        return text_trie(df.where(n <= long), key, text, k, letters, long).unionByName(far)

    def of(full: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        last = full[order - 1]
        at = [np.flatnonzero(last == ord(c)) for c in letters]
        first = np.array([np.count_nonzero(full < ord(c)) for c in letters])
        names, lo, hi = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(full)])

        def occurrences(row: np.ndarray) -> np.ndarray:
            return np.stack([np.searchsorted(x, row) for x in at], axis=1)

        for i in range(k):
            a, b = first + occurrences(lo), first + occurrences(hi)
            names = (np.arange(len(letters)) * len(letters) ** i + names[:, None]).ravel()
            some = (a < b).ravel()
            names, lo, hi = names[some], a.ravel()[some], b.ravel()[some]
        return [names, lo, hi]

    rows = of_order(df, key, text, "$", of, "name long, lo long, hi long")
    # a name's digits are its letters
    word = F.concat(*[F.substring(F.lit(letters), (F.floor(F.col("name") / len(letters) ** i) % len(letters) + 1).cast("int"), F.lit(1)) for i in reversed(range(k))])
    return rows.select(key, word.alias("kmer"), "lo", "hi")


def kmer_table(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, kmer, lo, hi: the rows [lo, hi) whose suffixes begin with each k-mer that occurs (suffixes of k letters and more).

    Beginnings are counted and summed in their order; no suffix is sorted.
    """
    begin = F.regexp_extract_all(F.concat(F.col(text), F.lit("$")), F.lit(f"(?=(.{{1,{k}}}))"), F.lit(1))
    n = df.select(key, F.explode(begin).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    hi = F.sum("n").over(Window.partitionBy(key).orderBy("kmer").rowsBetween(Window.unboundedPreceding, 0))
    return n.select(key, "kmer", (hi - F.col("n")).alias("lo"), hi.alias("hi")).where(~F.col("kmer").contains("$"))


def blocks(df: DataFrame, key: str, text: str, letters: str, size: int = 64) -> DataFrame:
    """The BWT in blocks of `size` rows: key, block, n (rows of the sequence), text (the block's letters), before and first.

    before holds how often each of `letters` stands in the blocks before, first how many suffixes begin with a smaller
    letter. A sequence is ordered within one task, so its tallies need no shuffle.
    """
    codes = [ord(c) for c in letters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                full = np.frombuffer((t + "$").encode("utf-32-le"), "<u4")
                last = full[suffix_order(full) - 1]
                n, at = len(full), np.arange(0, len(full), size)
                flat = last.tobytes().decode("utf-32-le")
                before = np.stack([np.cumsum(np.r_[0, last == c])[at] for c in codes], axis=1)
                first = [int((full < c).sum()) for c in codes]
                offsets = pa.array(np.arange(0, (len(at) + 1) * len(codes), len(codes)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (before.ravel(), first * len(at))]
                cols = [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at // size), pa.array(np.full(len(at), n)), pa.array([flat[j : j + size] for j in at.tolist()], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(cols, [key, "block", "n", "text", "before", "first"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, block long, n long, text string, before array<long>, first array<long>")


def kmer_bounds(df: DataFrame, key: str, text: str, k: int, letters: str = "ACGT") -> DataFrame:
    """key, slot, lo, hi: the bounds of every k-mer of `letters`, in order from 0, and one more slot for the last end.

    Rows are suffixes with the end after all letters. Those of fewer than k letters stand between k-mers: the next k-mer
    that occurs takes them in, so its bound is a pair, from where the k-mer before ended (lo) to its own first row (hi);
    the last slot takes what is left. Other bounds have lo = hi, the overflow table is what remains where lo < hi. Slots of
    k-mers that don't occur stand where the last one ended. Texts must be of `letters`.
    """
    begin = F.regexp_extract_all(F.concat(F.col(text), F.lit("~")), F.lit(f"(?=(.{{1,{k}}}))"), F.lit(1))
    n = df.where(F.col(text).isNotNull()).select(key, F.explode(begin).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("kmer")
    n = n.withColumn("hi", F.sum("n").over(w) - F.col("n")).withColumn("end", F.col("hi") + F.col("n"))
    long = ~F.col("kmer").contains("~")
    before = F.last(F.when(long, F.col("end")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    digits = F.translate("kmer", letters, "".join(map(str, range(len(letters)))))
    seen = n.withColumn("lo", F.coalesce(before, F.lit(0))).where(long).select(key, F.conv(digits, len(letters), 10).cast("long").alias("slot"), "lo", "hi", "end")
    total = n.groupBy(key).agg(F.sum("n").alias("_all"))
    size = len(letters) ** k
    slots = total.select(key, "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long"))).alias("slot")).join(seen, [key, "slot"], "left")
    last = F.coalesce(F.last("end", ignorenulls=True).over(Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hi = F.when(F.col("slot") == size, F.col("_all")).otherwise(F.coalesce("hi", last))
    return slots.select(key, "slot", F.coalesce("lo", last).alias("lo"), hi.alias("hi"))


def kmer_trie(df: DataFrame, key: str, text: str, k: int, letters: str = "ACGNT", size: int = 64) -> DataFrame:
    """The same table by k backward steps over all ranges at once; ranges without rows drop out at each step.

    Letters before a row are counted by its block's tally and the part of the block before it.
    """
    tally = spool(blocks(df, key, text, letters, size), "blocks")
    whole = tally.where("block = 0")
    step = whole.select(key, F.posexplode("first").alias("at", "first")).withColumn("bwt", F.substring(F.lit(letters), F.col("at") + 1, F.lit(1)))
    ranges = whole.select(key, F.lit("").alias("kmer"), F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    for _ in range(k):
        side = lambda c: tally.select(key, F.col("block").alias(f"_b{c}"), F.col("text").alias(f"_t{c}"), F.col("before").alias(f"_n{c}"))
        # an end at the first row of a block that isn't there is counted from the last block
        at = lambda c: F.floor(F.greatest(F.col(c) - 1, F.lit(0)) / size)
        ends = ranges.withColumn("_blo", at("lo")).withColumn("_bhi", at("hi")).join(side("lo"), [key, "_blo"]).join(side("hi"), [key, "_bhi"]).join(step, key)

        def occurrences(c: str) -> Column:
            part = F.substring(F.col(f"_t{c}"), F.lit(1), (F.col(c) - F.col(f"_b{c}") * size).cast("int"))
            return F.get(f"_n{c}", F.col("at")) + F.length(part) - F.length(F.replace(part, F.col("bwt"), F.lit("")))

        ranges = ends.select(key, F.concat("bwt", "kmer").alias("kmer"), (F.col("first") + occurrences("lo")).alias("lo"), (F.col("first") + occurrences("hi")).alias("hi")).where("lo < hi")
    return ranges.where(~F.col("kmer").contains("$"))


def sample(rows: DataFrame, every: int) -> DataFrame:
    return rows.where(F.col("row") % every == 0)


def spread(n: Column, k: int, i: Column) -> Column:
    """Which of n items the i-th of k evenly spaced ones is."""
    return F.floor(i * n / k)
