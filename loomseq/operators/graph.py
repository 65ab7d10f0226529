"""Path doubling over a labelled graph: rounds of self-joins with ranking, to a fixpoint."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import boundary, exists, forget, spool, stage
from . import ranks
from .ranges import last_start

LABELS = "ACGTYZ"


def backbone(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The linear graph of each sequence: nodes (key, id, label, value) from Y at 0 to Z at the end, and chain edges."""
    full = F.concat(F.lit("Y"), F.col(text), F.lit("Z"))
    nodes = df.select(key, F.posexplode(F.split(full, "")).alias("id", "label")).where("label <> ''")
    nodes = nodes.select(key, F.col("id").cast("long").alias("id"), "label", F.when(~F.col("label").isin("Y", "Z"), F.col("id").cast("long") - 1).alias("value"))
    edges = df.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.length(full).cast("long") - 2)).alias("src")).select(key, "src", (F.col("src") + 1).alias("dst"))
    return nodes, edges


def with_variants(nodes: DataFrame, edges: DataFrame, variants: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Adds substitutions (key, ix, pos, base) and deletions (key, ix, pos, len) with a typ column to backbones.

    A substitution is a node of its own between the neighbours of its position; a deletion is an edge past its bases.
    """
    last = nodes.groupBy(key).agg(F.max("id").alias("last"))
    single = variants.where("typ = 'single'").join(last, key).withColumn("id", F.col("last") + F.row_number().over(Window.partitionBy(key).orderBy("ix")))
    more = single.select(key, "id", F.col("base").alias("label"), F.col("pos").alias("value"))
    into = single.select(key, F.col("pos").alias("src"), F.col("id").alias("dst"))
    out = single.select(key, F.col("id").alias("src"), (F.col("pos") + 2).alias("dst"))
    gone = variants.where("typ = 'deletion'").select(key, F.col("pos").alias("src"), (F.col("pos") + F.col("len") + 1).alias("dst"))
    return nodes.unionByName(more), edges.unionByName(into).unionByName(out).unionByName(gone).distinct()


def fits(x: Column, y: Column) -> Column:
    """Whether the variant y (typ, pos, len) may follow x in one haplotype."""
    after = F.when(x["typ"] == "insertion", y["pos"] >= x["pos"]).when(x["typ"] != "deletion", y["pos"] > x["pos"])
    return after.otherwise(y["pos"] > x["pos"] + x["len"] - F.when(y["typ"] == "deletion", 0).otherwise(1))


def in_order(variants: Column) -> Column:
    """Whether each variant of an array may follow the one before it."""
    pairs = F.arrays_zip(F.slice(variants, F.lit(1), F.greatest(F.size(variants) - 1, F.lit(0))).alias("x"), F.slice(variants, F.lit(2), F.size(variants)).alias("y"))
    return F.forall(pairs, lambda p: fits(p["x"], p["y"]))


def with_haplotypes(nodes: DataFrame, edges: DataFrame, haplotypes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Adds for each haplotype (key, hap, left, right, variants) a path over its whole closed span, so phase is kept.

    `variants` is an array of structs (typ, pos, len, seq): a substitution changes the base at pos, a deletion leaves out
    `len` bases from pos, an insertion puts `seq` before pos. An insertion at the span's last position ends the walk: its
    base, and other variants there, are not taken. Haplotypes whose variants aren't in order are left out; of equal rows one
    counts, and rows of one name that differ are haplotypes of their own.
    """
    own = F.concat_ws("/", "hap", F.sha2(F.to_json(F.struct("left", "right", "variants")), 256))
    haplotypes = haplotypes.where(in_order(F.col("variants"))).withColumn("hap", own).dropDuplicates([key, "hap"])
    spine = nodes.where("value is not null").groupBy(key, F.col("value").alias("pos")).agg(F.min_by("label", "id").alias("base"))
    at = haplotypes.select(key, "hap", "left", "right", "variants", F.explode(F.sequence("left", "right")).alias("pos")).join(spine.hint("merge"), [key, "pos"])
    here = lambda typ: F.filter("variants", lambda v: (v["typ"] == typ) & (v["pos"] == F.col("pos")))
    gone = F.exists("variants", lambda v: (v["typ"] == "deletion") & (v["pos"] <= F.col("pos")) & (F.col("pos") < v["pos"] + v["len"]))
    ends = (F.col("pos") == F.col("right")) & (F.size(here("insertion")) > 0)
    puts = F.transform(here("insertion"), lambda v: v["seq"])
    put = F.when(ends, F.get(puts, F.lit(0))).otherwise(F.array_join(puts, ""))
    base = F.when(gone | ends, F.lit("")).when(F.size(here("single")) > 0, F.element_at(here("single"), -1)["seq"]).otherwise(F.col("base"))
    piece = F.concat(F.transform(F.filter(F.split(put, ""), lambda c: c != ""), lambda c: F.struct(c.alias("label"), F.lit(None).cast("long").alias("value"))), F.transform(F.filter(F.array(base), lambda c: c != ""), lambda c: F.struct(c.alias("label"), F.col("pos").alias("value"))))
    path = at.select(key, "hap", "left", "right", "pos", ends.alias("ends"), F.posexplode(piece).alias("i", "n"))
    last = nodes.groupBy(key).agg(F.max("id").alias("last"))
    one = Window.partitionBy(key, "hap").orderBy("pos", "i")
    path = path.join(last.hint("merge"), key).withColumn("id", F.col("last") + F.row_number().over(Window.partitionBy(key).orderBy("hap", "pos", "i")))
    links = path.select(key, "hap", "left", "right", "ends", "id", F.lag("id").over(one).alias("before"), F.lead("id").over(one).alias("after"))
    into = links.select(key, F.coalesce("before", "left").alias("src"), F.col("id").alias("dst"))
    out = links.where("after is null").select(key, F.col("id").alias("src"), (F.col("right") + F.when(F.col("ends"), 1).otherwise(2)).alias("dst"))
    empty = haplotypes.join(path.select(key, "hap").distinct().hint("merge"), [key, "hap"], "left_anti").select(key, F.col("left").alias("src"), (F.col("right") + 2).alias("dst"))
    new = path.select(key, "id", "n.label", "n.value")
    return nodes.unionByName(new), edges.unionByName(into).unionByName(out).unionByName(empty).distinct()


def with_splice_sites(edges: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Adds an edge past each intron [left, right] (closed) of `sites`, from the base before it to the base after it.

    Sites whose `excluded` holds add nothing; no nodes are added.
    """
    new = sites.where(~F.col("excluded")).select(key, F.col("left").alias("src"), (F.col("right") + 2).alias("dst"))
    return edges.unionByName(new).distinct()


def _subsets(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Backward subset construction from Z over one fragment, then numbers in topological order from Y."""
    label = dict(zip(nodes["id"], nodes["label"], strict=True))
    value = {i: None if v is None or pd.isna(v) else int(v) for i, v in zip(nodes["id"], nodes["value"], strict=True)}
    before: dict[int, set[int]] = {}
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        before.setdefault(b, set()).add(a)
    return states(label, value, before)


def states(label: dict[int, str], value: dict[int, int | None], before: dict[int, set[int]]) -> tuple[list[tuple], list[tuple]]:
    """The same of nodes by id and the predecessors of each: rows (number, label, value) in order, and links."""
    end = frozenset(i for i, x in label.items() if x == "Z")
    known, todo, after = {end: 0}, [end], {}
    while todo:
        state = todo.pop()
        if len(state) == 1:
            # most states are one node with one predecessor
            (m,) = state
            if len(only := before.get(m, ())) == 1:
                new = frozenset(only)
                if new not in known:
                    known[new] = len(known)
                    todo.append(new)
                after.setdefault(known[new], set()).add(known[state])
                continue
        by: dict[str, set[int]] = {}
        for a in set().union(*(before.get(m, ()) for m in state)):
            by.setdefault(label[a], set()).add(a)
        for x in sorted(by):
            new = frozenset(by[x])
            if new not in known:
                known[new] = len(known)
                todo.append(new)
            after.setdefault(known[new], set()).add(known[state])
    waiting = [0] * len(known)
    for targets in after.values():
        for t in targets:
            waiting[t] += 1
    members = {i: s for s, i in known.items()}
    ready = [i for i, w in enumerate(waiting) if not w]
    number: dict[int, int] = {}
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        number[i] = len(number)
        for t in after.get(i, ()):
            waiting[t] -= 1
            if not waiting[t]:
                heapq.heappush(ready, t)
    rows = []
    for i, n in number.items():
        values = [value[m] for m in members[i] if value[m] is not None]
        rows.append((n, label[next(iter(members[i]))], max(values) if values else None))
    return rows, [(number[a], number[b]) for a, bs in after.items() for b in bs]


def determinize(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Reverse-deterministic graphs: no node keeps two predecessors of one label. A key is a fragment of bounded size."""
    kind = nodes.schema[key].dataType.simpleString()

    def run(k, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows, links = _subsets(n, e)
        out = [(k[0], i, x, v, None) for i, x, v in rows] + [(k[0], a, None, None, b) for a, b in links]
        return pd.DataFrame(out, columns=[key, "id", "label", "value", "dst"]).astype({"value": "Int64", "dst": "Int64"})

    nodes, edges = spool(nodes, "nodes"), spool(edges, "edges")
    both = spool(nodes.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, id long, label string, value long, dst long"), "determinized")
    return both.where("label is not null").drop("dst"), both.where("label is null").select(key, F.col("id").alias("src"), "dst")


def code(label: Column) -> Column:
    """A, C, G, T, Y, Z as 0 to 5."""
    return (F.instr(F.lit(LABELS), label) - 1).cast("long")


def repeated_predecessors(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Where reverse determinism fails: targets that two predecessors of one label lead to."""
    labels = nodes.select(key, F.col("id").alias("src"), "label")
    return edges.join(labels, [key, "src"]).groupBy(key, "dst", "label").agg(F.count("*").alias("n")).where("n > 1")


def paths0(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Generation 0: a path for each edge under its source's label, and one for the tail."""
    labels = nodes.select(key, F.col("id").alias("src"), "label")
    first = edges.join(labels, [key, "src"]).select(key, "src", "dst", code(F.col("label")).alias("k0"))
    tail = nodes.where("label = 'Z'").select(key, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(5).cast("long").alias("k0"))
    return first.unionByName(tail).select(key, "src", "dst", F.lit(False).alias("done"), "k0", F.lit(0).cast("long").alias("k1"))


def double(paths: DataFrame, generation: int, key: str) -> DataFrame:
    """Paths joined end to start; done ones pass. Columns beside the path's own stay those of its first half."""
    more = [c for c in paths.columns if c not in (key, "src", "dst", "done", "k0", "k1")]
    right = paths.select(key, F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("k0").alias("next"))
    both = paths.where("not done").withColumnRenamed("dst", "mid").join(right, [key, "mid"])
    if generation <= 3:
        shift = 3 * (1 << (generation - 1))
        k0, k1 = F.shiftleft("k0", shift) + F.col("next"), F.lit(0).cast("long")
    else:
        k0, k1 = F.col("k0"), F.col("next")
    joined = both.select(key, "src", F.col("to").alias("dst"), "done", k0.alias("a"), k1.alias("b"), *more).select(key, "src", "dst", "done", F.col("a").alias("k0"), F.col("b").alias("k1"), *more)
    return joined.unionByName(paths.where("done").select(joined.columns))


#: Rows of paths that a part should hold, and the bits of a rank below its part's number.
PART_ROWS, PART_BITS = 1 << 20, 33


def parted(paths: DataFrame, key: str, parts: int = 0) -> DataFrame:
    """`paths` with the number of their part: ranges of (key, k0) in order, so that no k0 of a key is in two parts.

    Later generations only refine this order, so a path stays in its part for good and nothing is sampled again.
    """
    n = parts or max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), paths.count() // PART_ROWS)
    return paths.repartitionByRange(n, key, "k0").withColumn("part", F.spark_partition_id())


def _ends(paths: DataFrame, key: str, generation: int) -> DataFrame | None:
    """key, k0, extra: the rows that other parts must see, and the parts that must.

    What is folded depends on the two groups of keys before. The last two k0 of all parts before a part hold those, and
    matter only if they are of the key that the part begins with. The driver sees four values a part.
    """
    got = paths.groupBy("part").agg(F.min(key).alias("low"), F.max(F.struct(key, "k0")).alias("last")).orderBy("part").collect()
    out, before = {}, []
    for r in got:
        for k, k0 in before[-2:]:
            if k == r["low"]:
                out.setdefault((k, k0), []).append(r["part"])
        last = (r["last"][key], r["last"]["k0"])
        # ranks of a part have no gaps
        before += [(last[0], last[1] - 1), last] if generation > 4 and last[1] & ((1 << PART_BITS) - 1) else [last]
    if not out:
        return None
    kind = paths.schema[key].dataType.simpleString()
    return paths.sparkSession.createDataFrame([(k, k0, parts) for (k, k0), parts in out.items()], f"`_key` {kind}, `_k0` long, extra array<int>")


def _fold4(key: np.ndarray, k0: np.ndarray, k1: np.ndarray, src: np.ndarray, done: np.ndarray, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each group of equal keys keeps one row, and whether it goes: after a group of one source, that source's next."""
    hom = src[head] == src[last]
    again = np.zeros(len(head), bool)
    again[1:] = hom[1:] & hom[:-1] & (key[head][1:] == key[head][:-1]) & (src[last][1:] == src[last][:-1])
    return hom, again


def _fold5(key: np.ndarray, k0: np.ndarray, k1: np.ndarray, src: np.ndarray, done: np.ndarray, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for later generations: within blocks of equal first keys, and once after such a block.

    A group is looked at with the two before it: whether the one before counts as folded depends on its own predecessor.
    """
    k, first, to = key[head], k0[head], src[last]
    block = np.cumsum(np.r_[True, (first[1:] != first[:-1]) | (k[1:] != k[:-1])]) - 1
    many = np.bincount(block, last - head + 1)[block] > 1
    hom = src[head] == to
    folded = many & hom | done[last]
    near = np.r_[False, (k[1:] == k[:-1]) & (to[1:] == to[:-1])]
    prev = lambda x: np.r_[False, x[:-1]]
    solo = ~many & prev(many) & prev(folded) & near
    return hom & many, solo | many & hom & near & (prev(folded) | prev(solo))


def ranked(joined: DataFrame, key: str, generation: int, ends: DataFrame | None) -> DataFrame:
    """Paths of a generation: `joined` with new ranks (part, then place in it) and without what is folded.

    Every part also has a row without src, whose dst is how many rows it had before. Parts are folded on their own, with
    the last groups of earlier parts beside them (`ends`), and ranks need nothing from other parts.
    """
    kind = joined.schema[key].dataType.simpleString()
    fold = _fold4 if generation == 4 else _fold5

    def run(table: pa.Table) -> pa.Table:
        part = table.column("to")[0].as_py()
        code = ranks.codes_of(table.column(key))
        src, dst, done, k0, k1 = (table.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "done", "k0", "k1"))
        own = table.column("part").to_numpy() == part
        order = np.lexsort((done.astype(bool), dst, src, k1, k0, code))
        code, src, dst, done, k0, k1, own = (x[order] for x in (code, src, dst, done, k0, k1, own))
        head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
        last = np.r_[head[1:], len(src)] - 1
        one, gone = fold(code, k0, k1, src, done.astype(bool), head, last)
        count = last - head + 1
        mine = own[head]
        rank = np.cumsum(~gone & mine) - 1 + (part << PART_BITS)
        keep = np.repeat(mine & ~gone & ~one, count)
        keep[head[mine & ~gone & one]] = True
        group = np.repeat(np.arange(len(head)), count)[keep]
        at = order[keep]  # rows of the table as it came
        new_k1 = np.zeros(len(at), np.int64) if generation == 4 else k1[keep]
        cols = [pa.concat_arrays([table.column(key).combine_chunks().take(pa.array(at)), pa.nulls(1, table.column(key).type)])]
        values = [src[keep], dst[keep], done[keep].astype(bool) | one[group], rank[group], new_k1]
        for x, t, mark in zip(values, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), (None, int(own.sum()), None, None, None), strict=True):
            cols.append(pa.concat_arrays([pa.array(x, t), pa.array([mark], t)]))
        cols.append(pa.array(np.full(len(at) + 1, part), pa.int32()))
        return pa.table(cols, [key, "src", "dst", "done", "k0", "k1", "part"])

    rows = joined.withColumn("to", F.col("part"))
    if ends is not None:
        seen = joined.join(F.broadcast(ends), (F.col(key) == F.col("_key")) & (F.col("k0") == F.col("_k0")), "left")
        rows = seen.withColumn("to", F.explode(F.concat(F.array("part"), F.coalesce("extra", F.array().cast("array<int>"))))).drop("_key", "_k0", "extra")
    return rows.groupBy("to").applyInArrow(run, f"{key} {kind}, src long, dst long, done boolean, k0 long, k1 long, part int")


def dense(paths: DataFrame) -> DataFrame:
    """`paths` of a generation from 4 on, with ranks that rise through all parts without gaps."""
    total, offsets = 0, {}
    for r in paths.groupBy("part").agg(F.max("k0").alias("top")).orderBy("part").collect():
        offsets[r["part"]] = total
        if r["top"] is not None:
            total += (r["top"] & ((1 << PART_BITS) - 1)) + 1
    text = ",".join(str(offsets.get(p, 0)) for p in range(max(offsets, default=0) + 1))
    before = F.get(F.split(F.lit(text), ",").cast("array<long>"), F.col("part"))
    return paths.withColumn("k0", F.col("k0").bitwiseAND(F.lit((1 << PART_BITS) - 1)) + before)


def doubling(nodes: DataFrame, edges: DataFrame, key: str, most: int = 64, root: str | None = None, inputs: tuple[str, ...] = (), publish: str | None = None, parts: int = 0, until: int = 0, cap: int = 0, over: list[DataFrame] | None = None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """The paths at the fixpoint (or of generation `until`), and for each generation (generation, joined, kept, ranks).

    A generation is one written table: a join of paths, one shuffle into parts, which are folded and ranked on their own.
    So lineage stays short and a lost executor costs one generation; the driver sees a few numbers a part. With `root` a
    run resumes after the last generation that an earlier one with equal `inputs` finished there; with `publish` the
    curve is appended to that table while it grows. Graphs of several keys are doubled together and end when all are
    done; an error if they aren't after `most` generations. With `cap` a key drops out once it has so many ranks or more
    after generation 4; tables of such keys are put into `over`.
    """
    spark = nodes.sparkSession

    def step(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return spool(build(), name) if root is None else stage(spark, root, name, list(inputs), build)

    def say(*row: int) -> None:
        boundary(f"generation{row[0]}:counted")
        curve.append(row)
        if publish and row[0] not in told:
            spark.createDataFrame([row], "gen long, temp long, nodes long, ranks long").coalesce(1).write.mode("append").parquet(publish)
        boundary(f"generation{row[0]}:published")

    # a run that is resumed doesn't publish again what an earlier one did
    told = {r["gen"] for r in spark.read.schema("gen long").parquet(publish).collect()} if publish and exists(spark, publish) else set()
    curve: list[tuple[int, int, int, int]] = []
    paths = old = step("paths0", lambda: paths0(nodes, edges, key))
    n = paths.count()
    say(0, n, n, 0)
    for g in range(1, most + 1):
        if g < 4:
            new = table = step(f"paths{g}", lambda p=paths, g=g: double(p, g, key))
            temp = n = new.count()
            places = 0
        else:
            if g == 4:
                paths = step("parts", lambda p=paths: parted(p, key, parts))
                if root is None:
                    forget(old)
                old = paths
            ends = _ends(paths, key, g)
            table = step(f"paths{g}", lambda p=paths, g=g, e=ends: ranked(double(p, g, key), key, g, e))
            low = F.col("k0").bitwiseAND(F.lit((1 << PART_BITS) - 1))
            temp, n, places = table.groupBy("part").agg(F.sum(F.when(F.col("src").isNull(), F.col("dst"))).alias("t"), F.count("src").alias("n"), F.coalesce(F.max(low) + 1, F.lit(0)).alias("r")).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in "tnr"]).first()
            new = table.where("src is not null")
            if cap and g > 4:
                many = spool(new.groupBy(key).agg(F.countDistinct("k0").alias("n")).where(F.col("n") >= cap).select(key), "over")
                if many.limit(1).count():
                    over.append(many)
                    new = new.join(many, key, "left_anti")
                    n, places = new.agg(F.count("*"), F.countDistinct("k0")).first()
        if root is None:
            forget(old)
        old, paths = table, new
        say(g, temp, n, places)
        if n == 0 or g > 3 and places == n or g == until:
            break
    else:
        if n:
            raise RuntimeError(f"paths still double after {most} generations")
    return (dense(paths) if len(curve) > 4 else paths).drop("part"), curve


def _runs(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, src, run (rising through the order), first (the number of its first row) and n: runs of rows of equal src."""
    rows, w = ranks.after_others(df.select(key, "src", *[c for c in order if c != "src"]), [F.col(c) for c in (key, *order)], 1)
    old = (F.lag(key).over(w) == F.col(key)) & (F.lag("src").over(w) == F.col("src"))
    rows = ranks.numbered(rows.withColumn("_new", ~F.coalesce(old, F.lit(False))), w, F.col("_new"), "run")
    return rows.groupBy(key, "src", "run").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in order[:1]])


#: Places that a task of a merge should hold.
PLACES = 1 << 20


def merged_runs(nodes: DataFrame, edges: DataFrame, key: str, places: int = 0) -> DataFrame:
    """Which run of nodes each run of edges meets, where a pointer into the nodes moves on only where sources differ.

    Both tables have key, src and run. A run of edges meets the first run of its source after the one that the run before
    it met; where there is none, it and all later runs of its key meet none. Columns: key, run, met.

    Runs are walked in ranges of about `places` places where they may land. What a range of a long key makes of the
    pointer that it is handed is found first, for all ranges at once: a rising step function with as many steps as the
    range's rarest source has places at most. The driver strings these together; keys of one range never reach it.
    """
    most = places or PLACES
    kind = edges.schema[key].dataType.simpleString()
    known = spool(nodes.groupBy(key, "src").agg(F.count("*").alias("_b")), "known")
    sized = edges.select(key, "src", "run").join(known, [key, "src"], "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
    sized = spool(ranks.running_sum(sized, [F.col(key), F.col("run")], "_b", "_upto").withColumn("_range", F.floor((F.col("_upto") - 1) / most)), "sized")
    # a run whose source no node has still has a row: it ends its key's walk
    landing = spool(sized.join(nodes.select(key, "src", F.col("run").alias("met")), [key, "src"], "left").select(key, "run", "met", "_range", F.lit(-1).cast("long").alias("_start")), "landing")
    long = sized.groupBy(key).agg(F.min("_range").alias("a"), F.max("_range").alias("b")).where("a < b")
    first = (1 << 62) - 1

    def walks(rows: pd.DataFrame):
        """The runs of each key in order with their places in order: key, pointer, runs, bounds of places, places."""
        rows = rows.sort_values([key, "run", "met"])
        run, met, name, start = rows["run"].to_numpy(), rows["met"].fillna(-1).to_numpy(np.int64), rows[key].to_numpy(), rows["_start"].to_numpy()
        heads = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (run[1:] != run[:-1])])
        tails = np.r_[heads[1:], len(run)]
        keys = np.flatnonzero(np.r_[True, name[heads][1:] != name[heads][:-1]])
        for a, b in zip(keys.tolist(), [*keys[1:].tolist(), len(heads)], strict=True):
            yield name[heads[a]], int(start[heads[a]]), run[heads[a:b]], heads[a:b], tails[a:b], met

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, _, _, heads, tails, met in walks(rows):
            after = nxt = None
            for h, t in zip(heads[::-1].tolist(), tails[::-1].tolist(), strict=True):
                at = met[h:t]
                if at[0] < 0:
                    at, after = at[:0], at[:0]
                elif after is None:
                    after = at
                else:
                    # where each place leads, by the places of the next run that lie beyond it
                    i = np.searchsorted(nxt, at, side="right")
                    ok = i < len(nxt)
                    at, after = at[ok], after[i[ok]]
                    if len(at):
                        last = np.r_[after[1:] != after[:-1], True]
                        at, after = at[last], after[last]
                nxt = at
            out += [(name, int(rows["_range"].iloc[0]), int(x), int(y)) for x, y in zip(nxt.tolist(), after.tolist(), strict=True)] or [(name, int(rows["_range"].iloc[0]), first, first)]
        return pd.DataFrame(out, columns=[key, "range", "at", "after"])

    table: dict = {}
    got = landing.join(long.select(key), key, "left_semi").groupBy("_range").applyInPandas(steps, f"{key} {kind}, range long, at long, after long")
    for r in got.collect():
        table.setdefault(r[key], {}).setdefault(r["range"], []).append((r["at"], r["after"]))
    starts = []
    for name, parts in table.items():
        pointer = -1
        for part in sorted(parts):
            starts.append((name, part, pointer))
            if pointer < first:
                pointer = min((p for p in parts[part] if p[0] > pointer), default=(first, first))[1]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, pointer, runs, heads, tails, met in walks(rows):
            where = met.tolist()
            for r, h, t in zip(runs.tolist(), heads.tolist(), tails.tolist(), strict=True):
                i = bisect.bisect_right(where, pointer, h, t)
                if i == t or where[i] < 0:
                    break
                pointer = where[i]
                out.append((name, r, pointer))
        return pd.DataFrame(out, columns=[key, "run", "met"])

    handed = edges.sparkSession.createDataFrame(starts, f"`_key` {kind}, _part long, _handed long")
    landing = landing.join(F.broadcast(handed), (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_part")), "left")
    return landing.select(key, "run", "met", "_range", F.coalesce("_handed", "_start").alias("_start")).groupBy("_range").applyInPandas(walk, f"{key} {kind}, run long, met long")


def positional_out_degree(nodes: DataFrame, edges: DataFrame, key: str, order: list[str], edge_order: list[str] | None = None, places: int = 0) -> DataFrame:
    """`nodes` with outdeg: nodes are read in `order` and edges in `edge_order` (total orders within each key), both have src.

    The edges of a run of equal src belong to the first node of the run that it meets (`merged_runs`); other nodes have 0.
    """
    n = spool(_runs(nodes, key, order), "node_runs")
    e = spool(_runs(edges, key, edge_order or order), "edge_runs")
    met = merged_runs(n, e, key, places).join(e.select(key, "run", F.col("n").alias("outdeg")), [key, "run"]).select(key, F.col("met").alias("run"), "outdeg")
    firsts = n.join(met, [key, "run"]).select(key, "src", order[0], "outdeg")
    return nodes.join(firsts, [key, "src", order[0]], "left").withColumn("outdeg", F.coalesce("outdeg", F.lit(0)).cast("long"))


def indexed(build: Callable[[], tuple[DataFrame, DataFrame]], key: str, root: str, inputs: tuple[str, ...], publish: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and nodes of the index of the graphs that `build` makes, every stage resumed from `root` where it ended before.

    The stages are the graph's nodes and edges, the generations of paths, and the index's rows and nodes. `inputs` says
    what the graph is made of; other inputs, or other code of this library, build anew.
    """
    made: list[tuple[DataFrame, DataFrame]] = []

    def once(i: int, of: Callable[[], tuple[DataFrame, DataFrame]]) -> DataFrame:
        if not made:
            made.append(of())
        return made[0][i]

    def pair(names: tuple[str, str], of: Callable[[], tuple[DataFrame, DataFrame]]) -> list[DataFrame]:
        made.clear()
        return [stage(spark, root, name, list(inputs), lambda i=i: once(i, of)) for i, name in enumerate(names)]

    spark = SparkSession.active()
    nodes, edges = pair(("nodes", "edges"), build)
    paths = doubling(nodes, edges, key, root=root, inputs=inputs, publish=publish)[0]
    rows, at = pair(("rows", "index_nodes"), lambda: edge_rows(nodes, edges, paths, key))
    return rows, at


def exploded(texts: DataFrame, haplotypes: DataFrame, key: str, text: str, cap: int) -> DataFrame:
    """The keys whose index is too large: `cap` ranks or more after generation 4, or more than `cap` rows.

    All graphs are built and doubled together; those that reach the cap drop out on the way.
    """
    nodes, edges = (spool(x, "window") for x in determinize(*with_haplotypes(*backbone(texts, key, text), haplotypes, key), key))
    over: list[DataFrame] = []
    paths = doubling(nodes, edges, key, cap=cap, over=over)[0]
    rows = edges.join(paths.select(key, F.col("src").alias("dst")), [key, "dst"]).groupBy(key).agg(F.count("*").alias("n"))
    out = rows.where(F.col("n") > cap).select(key)
    for x in over:
        out = out.unionByName(x)
    return out


def path_edges(nodes: DataFrame, edges: DataFrame, paths: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Path nodes (key, rank, src, value) and path edges (key, rank, src, dst, k) of paths at their fixpoint.

    A base edge has a path edge for every path node that hangs off its target: the rank is that node's, the label's code
    k is that of the edge's source. Ranks count from 0 in each key.
    """
    at = spool(from_first(paths.select(key, F.col("src").alias("id"), F.col("k0").alias("rank")), key, "rank"), "ranks")
    path_nodes = at.join(nodes.select(key, "id", "value"), [key, "id"]).select(key, "rank", F.col("id").alias("src"), "value")
    labelled = edges.join(nodes.select(key, F.col("id").alias("src"), code(F.col("label")).alias("k")), [key, "src"])
    return path_nodes, labelled.join(at.withColumnRenamed("id", "dst"), [key, "dst"]).select(key, "rank", "src", "dst", "k")


def edge_rows(nodes: DataFrame, edges: DataFrame, paths: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a graph index (key, row, label, f, m), and its nodes (key, rank, outdeg, src, value), from doubled paths.

    Path edges in order of label and rank meet path nodes in order of rank, which gives out-degrees. The node before the
    last one (the head, whose rows nobody reads) goes: its out-degree stays with the last node, whose rank falls by one.
    Rows are path edges by rank, ties as they stood before; f marks the first of each node, m the first of as many rows
    as each node has outgoing edges, one at least. The head's label is written as the tail's.
    """
    at, rows = (spool(x, name) for x, name in zip(path_edges(nodes, edges, paths, key), ("path_nodes", "path_edges"), strict=True))
    size = spool(at.groupBy(key).agg(F.count("*").alias("_n")), "sizes")
    deg = positional_out_degree(at, rows, key, ["rank"], ["k", "rank", "src", "dst"])
    deg = beside(deg, size, key)
    # of the last two nodes one is left: the out-degree of the first, the value of the second
    two = F.col("rank") >= F.col("_n") - 2
    last = F.max(F.struct("rank", "src", "value"))
    tail = deg.where(two).groupBy(key).agg(F.min("rank").alias("rank"), F.min_by("outdeg", "rank").alias("outdeg"), last["src"].alias("src"), last["value"].alias("value"))
    left = spool(deg.where(~two).select(key, "rank", "outdeg", "src", "value").unionByName(tail), "index_nodes")
    moved = (F.col("k") != 4) & (F.col("rank") >= F.col("_n") - 1)
    rows = beside(rows, size, key).select(key, (F.col("rank") - moved.cast("long")).alias("rank"), F.when(F.col("k") == 4, 5).otherwise(F.col("k")).alias("k"), moved.alias("moved"), "src", "dst")
    first = Window.partitionBy(key, "rank").orderBy("k", "moved", "src", "dst")
    rows = rows.withColumn("f", F.row_number().over(first) == 1).withColumn("label", F.substring(F.lit(LABELS), (F.col("k") + 1).cast("int"), F.lit(1)))
    rows = from_first(ranks.row_numbers(rows, [F.col(c) for c in (key, "rank", "k", "moved", "src", "dst")], "row"), key, "row").select(key, "row", "label", "f")
    spans = left.select(key, "rank", F.greatest("outdeg", F.lit(1)).alias("n"))
    starts = ranks.running_sum(spans, [F.col(key), F.col("rank")], "n", "_upto").withColumn("row", F.col("_upto") - F.col("n"))
    starts = from_first(starts, key, "row").select(key, "row", F.lit(True).alias("m"))
    return rows.join(starts, [key, "row"], "left").select(key, "row", "label", "f", F.coalesce("m", F.lit(False)).alias("m")), left


#: Keys up to which a table of one row a key is broadcast.
MOST_KEYS = 1 << 18


def beside(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """`rows` joined with a table of one row a key, which is broadcast if it is counted to be small: no key is a task then."""
    return rows.join(F.broadcast(small) if small.limit(MOST_KEYS + 1).count() <= MOST_KEYS else small, key)


def from_first(rows: DataFrame, key: str, number: str) -> DataFrame:
    """`rows` with a number that rises through all keys counted from 0 in each key."""
    low = spool(rows.groupBy(key).agg(F.min(number).alias("_low")), "low")
    return beside(rows, low, key).withColumn(number, F.col(number) - F.col("_low")).drop("_low")


def rank_flags(rows: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """`rows` with how many rows of its key before each have the flag."""
    rows = ranks.running_sum(rows.withColumn("_one", F.col(flag).cast("long")), [F.col(key), F.col("row")], "_one", name)
    return from_first(rows.withColumn(name, F.col(name) - F.col("_one")).drop("_one"), key, name)


def selected(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """key, k, row: the row of the k-th flag, counted from 1."""
    return rank_flags(rows, key, flag, "k").where(flag).select(key, (F.col("k") + 1).alias("k"), "row")


#: Rows of a block of tallies, and the letters that are tallied.
BLOCK, LETTERS = 64, "ACGT"


def tallied(rows: DataFrame, key: str, letters: str = LETTERS) -> tuple[DataFrame, DataFrame, str]:
    """What backward steps look up, written once: blocks of rows, the row of each node's first edge, and the letters.

    Blocks: key, block, labels and marks (a letter a row), before (how often each letter stands in earlier blocks), marked
    (marks in earlier blocks), first (rows with a smaller letter) and size (rows of the key). Nodes: key, k (from 1), row.
    """
    mark = F.when(F.col("m"), "1").otherwise("0")
    text = lambda c: F.array_join(F.transform("_rows", lambda x: x[c]), "").alias(c)
    blocks = rows.groupBy(key, F.floor(F.col("row") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "label", mark.alias("mark")))).alias("_rows")).select(key, "block", text("label"), text("mark"))
    of = lambda c, x: (F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))).cast("long")
    counts = {f"_{x}": of("label", x) for x in letters} | {"_m": of("mark", "1")}
    blocks = ranks.running_sums(blocks.select("*", *[v.alias(k) for k, v in counts.items()]), [F.col(key), F.col("block")], list(counts))
    own = rows.where(F.col("label").isin(list(letters)))
    sums = rows.select(key).groupBy(key).agg(F.count("*").alias("size"))
    sums = sums.join(own.groupBy(key).agg(*[F.count_if(F.col("label") < x).alias(f"_below{x}") for x in letters]), key, "left")
    sums = spool(sums.select(key, "size", F.array(*[F.coalesce(f"_below{x}", F.lit(0)) for x in letters]).alias("first")), "sums")
    # running sums rise through all keys and hold the block itself
    low = blocks.groupBy(key).agg(*[F.min(F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_low") for c in counts])
    blocks = beside(beside(blocks, spool(low, "low"), key), sums, key)
    upto = {c: F.col(f"{c}_upto") - F.col(c) - F.col(f"{c}_low") for c in counts}
    blocks = blocks.select(key, "block", "label", "mark", F.array(*[upto[f"_{x}"] for x in letters]).alias("before"), upto["_m"].alias("marked"), "first", "size")
    return spool(blocks, "blocks"), spool(selected(rows, key, "f"), "nodes"), letters


def graph_step(ranges: DataFrame, index: tuple[DataFrame, DataFrame, str], key: str) -> DataFrame:
    """Ranges (key, label, top, bot) of rows a backward step later, by the label; those that become empty drop out.

    Rows of the label before either end, after all rows of smaller labels, give a range of nodes by the m flags before
    it; the f flags give the rows of those nodes. Everything is looked up by equal blocks and equal node numbers.
    """
    blocks, nodes, letters = index
    names = [c for c in ranges.columns if c not in ("top", "bot")]
    letter = F.instr(F.lit(letters), F.col("label"))

    def looked(rows: DataFrame, at: Column, side: str) -> DataFrame:
        """`rows` with the block of row `at`, its columns ending in `side`."""
        right = blocks.select(key, *[F.col(c).alias(f"_{c}{side}") for c in blocks.columns if c != key])
        return rows.withColumn(f"_block{side}", F.floor(at / BLOCK)).join(right, [key, f"_block{side}"])

    def upto(c: str, x: Column, end: Column, side: str) -> Column:
        """How often x stands in the block before row `end`."""
        part = F.substring(F.col(f"_{c}{side}"), F.lit(1), (end - F.col(f"_block{side}") * BLOCK).cast("int"))
        return F.length(part) - F.length(F.replace(part, x, F.lit("")))

    # an end at the first row of a block that isn't there is counted from the last block
    at = ranges.where((letter > 0) & (F.col("top") < F.col("bot")))
    at = looked(looked(at, F.greatest(F.col("top") - 1, F.lit(0)), "a"), F.col("bot") - 1, "b")
    ends = {s: F.get(f"_before{s}", letter - 1) + upto("label", F.col("label"), F.col(e), s) for s, e in (("a", "top"), ("b", "bot"))}
    at = at.withColumn("_lo", F.get("_firsta", letter - 1) + ends["a"]).withColumn("_hi", F.get("_firsta", letter - 1) + ends["b"] - 1).where("_lo <= _hi")
    at = at.select(*names, "_lo", "_hi", F.col("_sizea").alias("_size"))
    at = looked(looked(at, F.col("_lo"), "a"), F.col("_hi"), "b")
    # the flags up to a row number its node from 1
    node = {s: F.col(f"_marked{s}") + upto("mark", F.lit("1"), F.col(e) + 1, s) for s, e in (("a", "_lo"), ("b", "_hi"))}
    at = at.select(*names, "_size", node["a"].alias("_p"), (node["b"] + 1).alias("_q"))
    for k, end in (("_p", "_top"), ("_q", "_bot")):
        at = at.join(nodes.select(key, F.col("k").alias(k), F.col("row").alias(end)), [key, k], "left")
    out = at.select(*names, F.coalesce("_top", "_size").alias("top"), F.coalesce("_bot", "_size").alias("bot"))
    return out.where("top < bot")


def spelled(words: DataFrame, index: tuple[DataFrame, DataFrame, str], key: str, word: str = "word") -> DataFrame:
    """`words` with the rows [top, bot) of the nodes from which the graph of their key spells them.

    All words take a backward step a round, from their last letter on; those whose range is empty drop out, those that
    are through are put aside. Empty and null words, and words with other letters, have no rows.
    """
    size = index[0].select(key, "size").distinct()
    names = words.columns
    open_ = beside(words.where(F.length(word) > 0), spool(size, "sizes"), key).select(*names, F.lit(0).cast("long").alias("top"), F.col("size").alias("bot"))
    most = words.agg(F.coalesce(F.max(F.length(word)), F.lit(0))).first()[0]
    done = None
    for i in range(most):
        here = open_.where(F.length(word) > i).withColumn("label", F.substring(F.col(word), F.length(word) - i, F.lit(1)))
        open_ = spool(graph_step(here, index, key).drop("label"), "spelled")
        through = open_.where(F.length(word) == i + 1)
        done = through if done is None else done.unionByName(through)
    return open_ if done is None else done


def nodes_of(found: DataFrame, index: tuple[DataFrame, DataFrame, str], nodes: DataFrame, key: str) -> DataFrame:
    """`found` with a row for each node of its rows [top, bot): the columns of `nodes` beside it."""
    names = [c for c in found.columns if c not in ("top", "bot")]
    k = index[1].select(key, F.col("row").alias("top"), F.col("k").alias("_k"))
    end = index[1].select(key, F.col("row").alias("bot"), F.col("k").alias("_end"))
    last = spool(index[1].groupBy(key).agg((F.max("k") + 1).alias("_all")), "last")
    of = beside(found.join(k, [key, "top"]).join(end, [key, "bot"], "left"), last, key)
    ranked = of.select(*names, F.explode(F.sequence(F.col("_k") - 1, F.coalesce("_end", "_all") - 2)).alias("rank"))
    return ranked.join(nodes, [key, "rank"])
