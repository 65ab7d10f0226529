"""Graphs built fragment by fragment and stitched: no task holds a chromosome's graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spool
from . import graph
from .ranges import containment_join


def pieces(df: DataFrame, cuts: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each fragment of `cuts` (key, start, stop): key, frag, start, stop, final, piece and part, its own name.

    Sequences are cut as bytes, so they must be ASCII. A sequence without cuts has no rows.
    """
    lists = cuts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    raw = F.col(text).cast("binary")
    cut = F.transform("_cuts", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.substr(raw, (c["start"] + 1).cast("int"), (c["stop"] - c["start"]).cast("int")).cast("string").alias("piece")))
    rows = df.select(key, text).join(lists.hint("merge"), key).select(key, F.size("_cuts").alias("_n"), F.posexplode(cut).alias("frag", "_c"))
    return rows.select(key, "frag", "_c.start", "_c.stop", (F.col("frag") == F.col("_n") - 1).alias("final"), "_c.piece", F.concat_ws(":", F.col(key).cast("string"), F.col("frag").cast("string")).alias("part"))


def placed_haplotypes(haplotypes: DataFrame, parts: DataFrame, key: str, chunk: int) -> DataFrame:
    """Haplotypes (key, hap, left, right, variants) in their fragment's own positions: part, hap, left, right, variants.

    Cuts lie clear of variants, so a haplotype lies in one fragment; those that don't are left out.
    """
    a = haplotypes.withColumn("a_start", F.col("left")).withColumn("a_stop", F.col("right") + 1)
    b = parts.select(key, "part", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    rows = containment_join(a, b.hint("merge"), [key], chunk)
    own = F.transform("variants", lambda v: v.withField("pos", v["pos"] - F.col("b_start")))
    return rows.select("part", "hap", (F.col("left") - F.col("b_start")).alias("left"), (F.col("right") - F.col("b_start")).alias("right"), own.alias("variants"))


def _path(variants: list[dict | None], left: int, right: int, base: dict[int, str]) -> list[tuple[str, int | None, bool]]:
    """The nodes of a haplotype's path in order: label, value and whether the walk ends there, by the rules of `graph.with_haplotypes`."""
    single, put, gone = {}, {}, []
    for v in variants:
        if v is None or v["pos"] is None:
            continue
        if v["typ"] == "single":
            single[v["pos"]] = v["seq"]
        elif v["typ"] == "insertion":
            put.setdefault(v["pos"], []).append(v["seq"])
        elif v["typ"] == "deletion" and v["len"] is not None:
            gone.append((v["pos"], v["pos"] + v["len"]))
    out = []
    for pos in range(min(left, right), max(left, right) + 1):
        if pos not in base:
            continue
        puts = put.get(pos, [])
        ends = pos == right and bool(puts)
        out += [(c, None, ends) for c in (puts[0] or "" if ends else "".join(filter(None, puts)))]
        if not ends and not any(a <= pos < b for a, b in gone) and (x := single.get(pos, base[pos])):
            out.append((x, pos, False))
    return out


def _graph(pieces: list[str], haplotypes: list[dict]) -> tuple[dict[int, str], dict[int, int | None], dict[int, set[int]]]:
    """Label and value of each node and its predecessors: the graph of `graph.backbone` and `graph.with_haplotypes`."""
    label, value, before = {}, {}, {}
    for piece in pieces:
        full = f"Y{piece}Z"
        label.update(enumerate(full))
        for i in range(1, len(full)):
            before.setdefault(i, set()).add(i - 1)
    value = {i: None if c in "YZ" else i - 1 for i, c in label.items()}
    base = {v: label[i] for i, v in value.items() if v is not None}
    new, seen = max(label) + 1, set()
    for h in haplotypes:
        left, right = h["left"], h["right"]
        path = _path(h["variants"], left, right, base)
        # of equal paths one is enough: they would be one path of states
        if (own := (left, right, *path)) in seen:
            continue
        seen.add(own)
        last, to = left, right + 2
        for x, v, ends in path:
            label[new], value[new] = x, v
            before.setdefault(new, set()).add(last)
            last, to, new = new, right + (1 if ends else 2), new + 1
        before.setdefault(to, set()).add(last)
    return label, value, before


def _cut(rows: list[tuple], links: list[tuple], frag: int, start: int, final: bool, copies: int) -> tuple[list, ...]:
    """A fragment's graph without the heads and tails that stand for a neighbour's base: label, value, src, dst, out and into.

    Nodes are places among those that stay. `out` are those that led into the tail, `into` what the head led to: the node
    of the first base. A fragment that stands there several times has its nodes as often, one after the other.
    """
    lead = [x == "Y" and frag > 0 for _, x, _ in rows]
    trail = [x == "Z" and not final for _, x, _ in rows]
    place, n = [], [0, 0]
    for x, y in zip(lead, trail, strict=True):
        place.append(n[x or y])
        n[x or y] += 1
    more = range(copies)
    kept = [(x, None if v is None else v + start) for (_, x, v), a, b in zip(rows, lead, trail, strict=True) if not a and not b for _ in more]
    src, dst, out, into = [], [], set(), set()
    for a, b in links:
        if not lead[a] and not trail[b]:
            src += [place[a] * copies + i for i in more for _ in more]
            dst += [place[b] * copies + j for _ in more for j in more]
        elif not lead[a]:
            out.update(place[a] * copies + i for i in more)
        elif not trail[b] and rows[b][2] == 0:
            into.update(place[b] * copies + j for j in more)
    return [x for x, _ in kept], [v for _, v in kept], src, dst, sorted(out), sorted(into)


#: Nodes and edges of fragments that a task makes before it hands them on.
ROWS = 1 << 17


def determinized(parts: DataFrame, haplotypes: DataFrame, key: str) -> DataFrame:
    """The reverse-deterministic graph of each fragment with its haplotypes, a row a fragment: key, frag, part, n and `_cut`'s lists.

    A fragment's text and haplotypes meet in one task, which takes many fragments one after the other, so no row a node is
    shuffled. Fragments of which no node stays have no row.
    """
    spark = parts.sparkSession
    kind = parts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, frag int, part string, n long, label array<string>, value array<bigint>, src array<bigint>, dst array<bigint>, out array<bigint>, into array<bigint>"
    lists = [pa.list_(pa.string()), *[pa.list_(pa.int64())] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, frag, part, start, final, copies, pieces, haps = batch.columns
            at, held, size = [], [], 0
            for i in range(len(batch)):
                texts = sorted(x.decode("utf-8", "replace") for x in pieces[i].as_py())
                if texts:
                    rows, links = graph.states(*_graph(texts, haps[i].as_py()))
                    got = _cut(rows, links, frag[i].as_py(), start[i].as_py(), final[i].as_py(), copies[i].as_py())
                    if got[0]:
                        at.append(i)
                        held.append(got)
                        size += len(got[0]) + len(got[2])
                if held and (size >= ROWS or i == len(batch) - 1):
                    own = pa.array(at)
                    cols = [name.take(own), frag.take(own), part.take(own), pa.array([len(x[0]) for x in held], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, t) for x, t in zip(zip(*held, strict=True), lists, strict=True))], [c.split()[0] for c in schema.split(", ")])
                    at, held, size = [], [], 0

    own = parts.select("part", F.struct(key, "frag", "start", "final").alias("_at"), F.col("piece").cast("binary").alias("_piece"))
    rows = own.unionByName(haplotypes.select("part", F.struct("left", "right", "variants").alias("_hap")), allowMissingColumns=True)
    # dealt out by number, since a fragment's work outgrows its bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "part").groupBy("part").agg(F.first("_at", ignorenulls=True).alias("_at"), F.count("_at").alias("_copies"), F.collect_list("_piece").alias("_pieces"), F.collect_list("_hap").alias("_haps"))
    return rows.select(f"_at.{key}", "_at.frag", "part", "_at.start", "_at.final", "_copies", "_pieces", "_haps").mapInArrow(run, schema)


def stitched(graphs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One graph of each key from the graphs of its fragments (`determinized`): nodes (key, id, label, value), edges (key, src, dst).

    Ids are those of the fragment after the nodes of all fragments before. What led into a fragment's tail leads to what
    the next one's head led to, the node of the base at which the next one starts.
    """
    w = Window.partitionBy(key).orderBy("frag")
    rows = graphs.select(key, "frag", "part", "n", "into").withColumn("_before", F.sum("n").over(w) - F.col("n"))
    rows = rows.withColumn("_next", F.lead(F.struct("frag", "into", "_before")).over(w))
    into = F.when(F.col("_next.frag") == F.col("frag") + 1, F.transform("_next.into", lambda x: x + F.col("_next._before")))
    offsets = spool(rows.select("part", "_before", F.coalesce(into, F.array().cast("array<bigint>")).alias("_into")), "offsets")
    # there are as many fragments as text, so nothing of a row a fragment may be broadcast through the driver
    rows = graphs.join(offsets.hint("merge"), "part")
    before = F.col("_before")
    nodes = rows.select(key, "_before", F.posexplode(F.arrays_zip("label", "value")).alias("_place", "_n")).select(key, (before + F.col("_place")).alias("id"), "_n.label", "_n.value")
    inside = F.transform(F.arrays_zip("src", "dst"), lambda e: F.struct((e["src"] + before).alias("src"), (e["dst"] + before).alias("dst")))
    seam = F.flatten(F.transform("out", lambda a: F.transform("_into", lambda b: F.struct((a + before).alias("src"), b.alias("dst")))))
    return nodes, rows.select(key, F.explode(F.concat(inside, seam)).alias("_e")).select(key, "_e.src", "_e.dst")


def build(df: DataFrame, haplotypes: DataFrame, cuts: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The reverse-deterministic graph of each sequence with its haplotypes, determinised a fragment at a time."""
    parts = spool(pieces(df, cuts, key, text), "pieces")
    placed = spool(placed_haplotypes(haplotypes.where(graph.in_order(F.col("variants"))), parts, key, chunk), "placed")
    return stitched(spool(determinized(parts, placed, key), "determinized"), key)
