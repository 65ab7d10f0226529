"""Personal data: fixed patterns, and bootstrapped contextual extraction beyond them.

What the fixed patterns find are seed entities. The words around a seed induce lexical patterns (two words before; the
word before and the word after). Spark scores the graph of patterns and instances in turns: a pattern is as good as the
share of its occurrences that are seeds of one kind or instances believed to be, and an instance is believed through the
patterns around it; believed instances support further patterns, until none is new. Confident patterns turn strings that
the fixed patterns missed into further spans: runs of digits and identifiers with letters of any kind, emails with other
letters than ASCII's or with at and dot in words, IPv6 addresses. Secrets have no fixed pattern and no names: long strings
of letters and digits that look drawn at random support the patterns around them, but are spans only where a confident
pattern says so, as is whatever else stands in its slot.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_with, text_chunks, written

KINDS = ("email", "ip", "card", "phone")
#: What supports a pattern of secrets: strings of this many characters, with letters and digits, and bits of entropy a character.
RANDOM_CHARS, RANDOM_BITS = 20, 3.0
#: The base patterns. A run of digits is entered at its start only, which finds the same leftmost matches.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = re.compile(r"[0-9](?:[ ().+-]{0,2}[0-9]){5,}")
#: Loose shapes beside digits: the at and dot of an email, what its parts may be, IPv6, identifiers with letters.
_AT = re.compile(r"@|\b[aA][tT]\b")
_AT_LEFT, _AT_RIGHT = re.compile(r"(?:\s?[(\[{<]\s?|\s+)$"), re.compile(r"\s?[)\]}>]\s?|\s+")
_NAME = re.compile(r"[^\s@<>()\[\]{},;:\"]+$")
_HOST = re.compile(r"[^\W_][\w-]*(?:(?:\.|\s?[(\[{<]\s?(?:[dD][oO][tT]|\.)\s?[)\]}>]\s?|\s+[dD][oO][tT]\s+)[^\W_][\w-]*)+")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?:[0-9]*(?:\.[0-9]+){3})?(?![\w:])")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*")
_GROUPS = re.compile(r"(?<![^\W_])[0-9A-Z]{2,8}(?:[ -][0-9A-Z]{1,8}){1,8}(?![^\W_])")
_EDGE = ".,;:!?\"'`()[]{}<>*|=#$%&~^«»“”„‘’…。，、"
_QUOTES = "\"'`“”„«»"
_DIGITS = re.compile(r"[^0-9]")
_BEFORE, _AFTER = re.compile(r"(?:(\S+)\s+)?(\S+)\s*$"), re.compile(r"\s*(\S+)")
#: Characters before and after a string in which the words of its patterns are looked for; longer words give no pattern.
CONTEXT = 80

#: Distinct seeds or believed instances that a pattern needs, the confidence from which it finds instances, and the turns
#: of scoring of each pattern from the first that supports it.
MIN_SEEDS, CONFIDENT, TURNS = 5, 0.9, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start; matches that fail a check are dropped."""
    out: list[tuple[str, int, int]] = []
    at, least = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            least = m.end()
        else:
            least = at + 1
        at = text.find("@", least)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def random_looking(found: str) -> bool:
    """Whether a string looks drawn at random: long, of letters and digits, and its characters spread widely."""
    n = len(found)
    if n < RANDOM_CHARS or not (any(map(str.isalpha, found)) and any(map(str.isdigit, found))):
        return False
    return -sum(c / n * log2(c / n) for c in Counter(found).values()) >= RANDOM_BITS


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode()) - (1 << 63)


def loose_spans(text: str) -> list[tuple[str | None, int, int]]:
    """(kind that its shape allows or None for any, start, end) of strings that may be personal data."""
    out: list[tuple[str | None, int, int]] = []
    for m in _AT.finditer(text):
        s, e = m.span()
        left, right = _AT_LEFT.search(text[max(0, s - 4) : s]), _AT_RIGHT.match(text[e : e + 4])
        if m[0] != "@" and not (left and right):
            continue
        e += right.end() if right else 0
        s -= len(left[0]) if left else 0
        host = _HOST.match(text[e : e + 256])
        name = _NAME.search(text[max(0, s - CONTEXT) : s]) if host else None
        if name and (word := name[0].lstrip(_EDGE)):
            out.append(("email", s - len(word), e + host.end()))
    if ":" in text:
        for m in _IPV6.finditer(text):
            if "::" in m[0] and len(m[0]) > 2 or m[0].count(":") == (6 if "." in m[0] else 7):
                out.append(("ip", *m.span()))
    shaped = sorted((s, e) for _, s, e in out)
    named: set[tuple[int, int]] = set()
    for m in _TOKEN.finditer(text):
        word = m[0].lstrip(_EDGE)
        s = m.end() - len(word)
        named.add((s, s + len(word.rstrip(_EDGE))))
    if named:
        named.update(m.span() for m in _GROUPS.finditer(text))
    i = 0
    for s, e in sorted(named):
        while i < len(shaped) and shaped[i][1] <= s:
            i += 1
        word, j, free = text[s:e], i, True
        while free and j < len(shaped) and shaped[j][0] < e:
            free, j = shaped[j][1] <= s, j + 1
        if free and sum(map(str.isalnum, word)) >= 4 and any(map(str.isalpha, word)) and any("0" <= c <= "9" for c in word):
            out.append((None, s, e))
    # digits that are part of a word are no string of their own
    return out + [(None, *m.span()) for m in _LOOSE.finditer(text) if not text[max(0, m.start() - 1) : m.start()].isalnum() and not text[m.end() : m.end() + 1].isalnum()]


def _instance(kind: str | None, found: str) -> int:
    """Emails and strings with letters are known by their whole text, others by their digits."""
    if kind == "email" or any(map(str.isalpha, found)):
        return _hash(found.lower())
    return _hash(_DIGITS.sub("", found) or found)


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str | None, str | None, str | None, list[int]]]:
    """(start, end, instance, kind or None, kind of the shape or None, kind that it supports or None, patterns) of base and loose spans.

    Loose spans lie apart from base spans, or hold more than base spans of their own kind.
    """
    rows: list[tuple[int, int, str | None, str | None]] = [(s, e, k, k) for k, s, e in spans]
    taken = sorted((s, e, k) for k, s, e in spans)
    reach = max((e - s for s, e, _ in taken), default=0)
    starts = [s for s, _, _ in taken]
    for kind, s, e in sorted(loose_spans(text), key=lambda x: x[1:]):
        over = [x for x in taken[bisect_left(starts, s - reach) : bisect_left(starts, e)] if s < x[1]]
        if all(k == kind and s <= a and b <= e and (a, b) != (s, e) for a, b, k in over):
            rows.append((s, e, None, kind))
    out = []
    for s, e, kind, shape in rows:
        # quotes about a string belong to neither side's words
        left = _BEFORE.search(text[max(0, s - CONTEXT) : s].rstrip(_QUOTES))
        right = _AFTER.match(text[e : e + CONTEXT].lstrip(_QUOTES))
        a, b = ((left[1] or "").lower(), left[2].lower()) if left else ("", "")
        c = right[1].lower() if right else ""
        patterns = [_hash("L2", a, b)] if a else []
        if b and c:
            patterns.append(_hash("L1R1", b, c))
        if patterns or kind:
            hint = "secret" if not shape and random_looking(text[s:e]) else kind
            out.append((s, e, _instance(shape, text[s:e]), kind, shape, hint, patterns))
    return out


_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _grow(seen: DataFrame) -> DataFrame:
    """doc_id, tag and the spans found through confident patterns."""
    each = seen.select("doc_id", "tag", F.explode("contexts").alias("c")).select("doc_id", "tag", "c.start", "c.stop", "c.instance", "c.kind", "c.shape", "c.hint", F.explode("c.patterns").alias("pattern"))
    graph = written(each.groupBy("pattern", "instance", "kind", "shape", "hint").agg(F.count("*").cast("double").alias("n")), "graph")
    # patterns of too few instances, or that never stand beside anything but seeds, lead nowhere
    able = graph.groupBy("pattern").agg(F.sum("n").alias("all"), F.count("kind").alias("seeds"), F.count("*").alias("edges")).where((F.col("edges") >= MIN_SEEDS) & (F.col("edges") > F.col("seeds")))
    able = written(able.select("pattern", "all"), "able")
    seeds = written(graph.where("hint is not null").join(able, "pattern").select("pattern", F.col("hint").alias("kind"), "instance", F.col("n").alias("hits")), "seeds")
    others = written(graph.where("kind is null").join(able, "pattern").select("pattern", "instance", "shape", "n"), "others")
    good, support = None, seeds
    while True:
        # an instance that is believed and supports by itself counts once
        support = support.groupBy("pattern", "kind", "instance").agg(F.max("hits").alias("hits"))
        scored = support.groupBy("pattern", "kind").agg(F.sum("hits").alias("hits"), F.count("*").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).join(able, "pattern")
        scored = scored.select("pattern", "kind", (F.col("hits") / F.col("all")).alias("trust")).where("trust >= 0.5")
        if good is None:
            good = scored.withColumn("turn", F.lit(1))
        else:
            # a pattern is scored in TURNS turns and then keeps its trust, so that believed instances don't raise it without end
            old = good.withColumnRenamed("trust", "before")
            good = scored.join(old, ["pattern", "kind"], "full").select("pattern", "kind", F.when(F.col("turn") >= TURNS, F.col("before")).otherwise(F.greatest("trust", "before")).alias("trust"), F.least(F.coalesce("turn", F.lit(0)) + 1, F.lit(TURNS)).alias("turn"))
        good = written(good, "good")
        if not good.where(F.col("turn") < TURNS).limit(1).count():
            break
        doubt = F.sum(F.log(1.0 - F.least("trust", F.lit(0.999))))
        believed = others.join(good, "pattern").where("shape is null or shape = kind").groupBy("instance", "kind").agg((1.0 - F.exp(doubt)).alias("belief"))
        believed = written(believed, "believed")
        support = seeds.unionByName(others.join(believed, "instance").where("shape is null or shape = kind").select("pattern", "kind", "instance", (F.col("n") * F.col("belief")).alias("hits")))
    good = written(good.where(F.col("trust") >= CONFIDENT).select("pattern", "kind", "trust"), "confident")
    hit = each.where("kind is null").drop("kind").join(good, "pattern").where("shape is null or shape = kind")
    return hit.groupBy("doc_id", "tag", "start", "stop").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind")).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, tag (a hash of the text), base and spans (arrays of kind, start, stop).

    Starts and stops count code points, stops are exclusive; spans are base and what patterns add, in order of kind (as in
    KINDS, then secret) and start. Null and empty texts have none. Rows with equal id and text have equal spans. An empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        near = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("kind", pa.string()), ("shape", pa.string()), ("hint", pa.string()), ("patterns", pa.list_(pa.int64()))]))
        for batch in batches:
            for part, texts in text_chunks(batch, 2):
                base = [base_spans(t) if t else [] for t in texts]
                around = [contexts(t, b) if t else [] for t, b in zip(texts, base, strict=True)]
                spans = [[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in base]
                rows = [[{"start": s, "stop": e, "instance": i, "kind": k, "shape": f, "hint": h, "patterns": p} for s, e, i, k, f, h, p in x] for x in around]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, span), pa.array(rows, near)], ["doc_id", "tag", "base", "contexts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    seen = written(rows.mapInArrow(run, f"doc_id {kind}, tag long, base {_SPAN}, contexts array<struct<start:int,stop:int,instance:bigint,kind:string,shape:string,hint:string,patterns:array<bigint>>>"), "contexts")
    more = _grow(seen).withColumnRenamed("doc_id", "id").withColumnRenamed("tag", "tag2")
    # more holds no span of base, since strings that overlap a base span are looked at only if they hold more than it
    order = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    joined = seen.drop("contexts").join(more, seen["doc_id"].eqNullSafe(more["id"]) & (seen["tag"] == more["tag2"]), "left")
    whole = F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))), lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return joined.select("doc_id", "tag", "base", F.transform(F.array_sort(whole), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced by its kind, as in <EMAIL>; where spans overlap, by the first's."""
    spans = find(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias("id2"), F.col("tag").alias("tag2"), "spans").dropDuplicates(["id2", "tag2"])
    rows = rows_with(docs, id=F.col(id_col), tag=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text=F.col(text_col))
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["id2"]) & (rows["tag"] == spans["tag2"]), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None:
                parts, at = [], 0
                for s in sorted(found, key=lambda s: (s["start"], s["stop"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["stop"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return texts.__class__(out, dtype=object)

    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("spans")))
    return joined.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
