"""Graphs of bounded size, many at once in a task: made, doubled, indexed and searched where their texts are read.

A graph is a row (key, text, and its variants as lists), and tasks number the nodes of all their graphs through, so that
joins are look-ups in arrays and only texts are shuffled. Longer texts take the way of `graph`, with a row for each node.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import LABELS, LETTERS, _fold4, _fold5, _subsets

#: Letters up to which a text's graph is one task's, letters of the graphs that are worked on together, and rows handed on together.
LONG, TOGETHER, ROWS = 1 << 20, 1 << 18, 1 << 17

_CODE = np.full(256, -1, np.int64)
_CODE[[*LABELS.encode()]] = np.arange(len(LABELS))


class Graphs(NamedTuple):
    """Nodes numbered through all graphs: `first` of each graph (and their number), the graph and label code of each, and edges."""

    first: np.ndarray
    of: np.ndarray
    label: np.ndarray
    src: np.ndarray
    dst: np.ndarray


def ranges_of(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def letters(label: np.ndarray) -> pa.Array:
    """Label codes as letters."""
    return pa.array(list(LABELS)).take(pa.array(label))


def made(texts: list[str], single: pa.ListArray, base: list[str], gone: pa.ListArray, size: pa.ListArray) -> Graphs:
    """The graphs of texts of ACGT with variants, as `graph.backbone` and `graph.with_variants` make them, of equal ids."""
    n = np.array([len(t) for t in texts], np.int64)
    ones, cuts = (x.value_lengths().to_numpy().astype(np.int64) for x in (single, gone))
    first = np.r_[0, np.cumsum(n + ones + 2)]
    at = first[:-1]
    label = np.empty(first[-1], np.int64)
    label[at], label[at + n + 1] = LABELS.index("Y"), LABELS.index("Z")
    label[ranges_of(at + 1, n)] = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    more = ranges_of(at + n + 2, ones)
    label[more] = _CODE[np.frombuffer("".join(base).encode(), np.uint8)]
    chain = ranges_of(at, n + 1)
    pos, out = np.repeat(at, ones) + single.flatten().to_numpy(), np.repeat(at, cuts) + gone.flatten().to_numpy()
    src = np.concatenate([chain, pos, more, out])
    dst = np.concatenate([chain + 1, more, pos + 2, out + size.flatten().to_numpy() + 1])
    return edged(Graphs(first, np.repeat(np.arange(len(n)), n + ones + 2), label, src, dst))


def edged(g: Graphs) -> Graphs:
    """`g` with its distinct edges in order."""
    pair = np.unique(g.src * g.first[-1] + g.dst)
    return g._replace(src=pair // max(g.first[-1], 1), dst=pair % max(g.first[-1], 1))


def repeated(g: Graphs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets that several predecessors of one label lead to: node, label and how many."""
    pair, n = np.unique(g.dst * 8 + g.label[g.src], return_counts=True)
    return pair[n > 1] // 8, pair[n > 1] % 8, n[n > 1]


def sure(g: Graphs) -> Graphs:
    """`g` with only the backbone's edges into targets of several predecessors of one label."""
    keep = ~np.isin(g.dst, repeated(g)[0]) | (g.dst == g.src + 1)
    return g._replace(src=g.src[keep], dst=g.dst[keep])


def determinized(g: Graphs) -> Graphs:
    """Reverse-deterministic graphs, each by `graph.determinize`'s construction."""
    labels, src, dst, first = [], [], [], [0]
    of = np.searchsorted(g.src, g.first)
    for i, (a, b) in enumerate(zip(g.first[:-1].tolist(), g.first[1:].tolist(), strict=True)):
        e = slice(of[i], of[i + 1])
        nodes = {"id": range(b - a), "label": [LABELS[x] for x in g.label[a:b].tolist()], "value": [None] * (b - a)}
        rows, links = _subsets(nodes, {"src": (g.src[e] - a).tolist(), "dst": (g.dst[e] - a).tolist()})
        labels += [LABELS.index(x) for _, x, _ in rows]
        src += [x + first[-1] for x, _ in links]
        dst += [x + first[-1] for _, x in links]
        first.append(len(labels))
    first = np.array(first)
    return edged(Graphs(first, np.repeat(np.arange(len(first) - 1), np.diff(first)), np.array(labels, np.int64), np.array(src, np.int64), np.array(dst, np.int64)))


def doubled(g: Graphs, until: int = 0, most: int = 64) -> tuple[dict[str, np.ndarray], list[tuple[int, int, int, int]]]:
    """Paths (src, dst, done, k0) at the fixpoint or of generation `until`, and the curve, as `graph.doubling` has them.

    From generation 4 on paths stand in order of k0, their rank through all graphs. A graph whose ranks are all different
    stays as it is, so graphs that end early wait for the others.
    """
    nodes = int(g.first[-1])
    tail = np.flatnonzero(g.label == LABELS.index("Z"))
    src, dst = np.r_[g.src, tail], np.r_[g.dst, tail]
    k0, done = g.label[src], np.zeros(len(src), bool)
    curve = [(0, len(src), len(src), 0)]
    for gen in range(1, most + 1):
        by = np.argsort(src, kind="stable")
        count = np.bincount(src, minlength=nodes)
        begin = np.cumsum(count) - count
        n = np.where(done, 1, count[dst])
        left = np.repeat(np.arange(len(src)), n)
        # a path that is done stands for itself
        place = ranges_of(np.where(done, 0, begin[dst]), n)
        passed = done[left]
        right = np.where(passed, left, by[place])
        ahead = k0[right]
        src, dst, k0, done = src[left], dst[right], k0[left], passed
        if gen <= 3:
            k0 = (k0 << 3 * (1 << gen - 1)) + ahead
            curve.append((gen, len(src), len(src), 0))
        else:
            ahead[passed] = 0
            of = g.of[src]
            if gen == 4:
                _, k0 = np.unique(of << 24 | k0, return_inverse=True)
            whole = k0 * (1 << 24 if gen == 4 else int(k0[-1]) + 1 if len(k0) else 1) + ahead
            order = np.argsort(whole, kind="stable")
            sorted_ = whole[order]
            new = np.r_[True, sorted_[1:] != sorted_[:-1]][: len(order)]
            tied = np.flatnonzero(~(new & np.r_[new[1:], True][: len(order)]))
            order[tied] = order[tied][np.lexsort(((src * nodes + dst)[order[tied]], sorted_[tied]))]
            src, dst, done, k0, k1, of = (x[order] for x in (src, dst, done, k0, ahead, of))
            head = np.flatnonzero(new)
            last = np.r_[head[1:], len(src)][: len(head)] - 1
            temp = len(src)
            if temp:
                one, gone = (_fold4 if gen == 4 else _fold5)(of, k0, k1, src, done, head, last)
                group = np.cumsum(new) - 1
                keep = ~gone[group] & (~one[group] | new)
                src, dst, done, k0 = src[keep], dst[keep], (done | one[group])[keep], (np.cumsum(~gone) - 1)[group][keep]
            places = int(k0[-1]) + 1 if len(k0) else 0
            curve.append((gen, temp, len(src), places))
            if places == len(src):
                break
        if not len(src) or gen == until:
            break
    else:
        raise RuntimeError(f"paths still double after {most} generations")
    return {"src": src, "dst": dst, "done": done, "k0": k0}, curve


def of_first(g: Graphs, src: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks that rise through all graphs, counted from 0 in each."""
    low = np.full(len(g.first) - 1, np.iinfo(np.int64).max)
    np.minimum.at(low, g.of[src], rank)
    return rank - low[g.of[src]]


def path_edges(g: Graphs, src: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rank, src and dst of an edge for every path node (rank through all graphs: place in `src`) that hangs off its target."""
    by = np.argsort(src, kind="stable")
    count = np.bincount(src, minlength=int(g.first[-1]))
    n = count[g.dst]
    return by[ranges_of((np.cumsum(count) - count)[g.dst], n)], np.repeat(g.src, n), np.repeat(g.dst, n)


def _nth(of: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each run (of a source), how many runs of that source come before it."""
    by = np.argsort(label, kind="stable")
    head = np.r_[True, label[by][1:] != label[by][:-1]][: len(by)]
    at = np.arange(len(by))
    out = np.empty(len(by), np.int64)
    out[by] = at - np.maximum.accumulate(np.where(head, at, 0)) if len(by) else at
    return out


def out_degrees(g: Graphs, src: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The out-degree of each path node, as `graph.positional_out_degree` gives it.

    Where the k-th run of each source among edges and its k-th run among nodes rise together, they meet; only graphs in
    which they don't are walked.
    """
    out = np.zeros(len(src), np.int64)
    rank, a, b = edges
    if not len(a):
        return out
    order = np.lexsort((b, a, rank, g.label[a], g.of[a]))
    a = a[order]
    start = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])  # node runs
    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[head, len(a)])
    node, edge = src[start], a[head]
    most = int(g.first[-1])
    count = np.bincount(node, minlength=most)
    by = np.argsort(node, kind="stable")
    nth = _nth(g.of[edge], edge)
    there = nth < count[edge]
    met = np.where(there, by[np.minimum((np.cumsum(count) - count)[edge] + nth, len(by) - 1)], -1)
    of = g.of[edge]
    wrong = ~there | np.r_[False, (met[1:] <= met[:-1]) & (of[1:] == of[:-1])]
    for i in np.unique(of[wrong]).tolist():
        mine = np.flatnonzero(of == i)
        met[mine] = -1
        own = {}
        for r in np.flatnonzero(g.of[node] == i).tolist():
            own.setdefault(int(node[r]), []).append(r)
        pointer = -1
        for r in mine.tolist():
            runs = own.get(int(edge[r]), [])
            j = bisect.bisect_right(runs, pointer)
            if j == len(runs):
                break
            met[r] = pointer = runs[j]
    out[start[met[met >= 0]]] = size[met >= 0]
    return out


class Index(NamedTuple):
    """Rows of the graphs' indexes in order: graph, row, label code, flags f and m; and nodes: graph, rank and src."""

    of: np.ndarray
    row: np.ndarray
    label: np.ndarray
    f: np.ndarray
    m: np.ndarray
    node_of: np.ndarray
    rank: np.ndarray
    src: np.ndarray


def indexed(g: Graphs) -> Index:
    """The index of reverse-deterministic graphs, by the rules of `graph.edge_rows`."""
    src = doubled(g)[0]["src"]
    edges = path_edges(g, src)
    deg = out_degrees(g, src, edges)
    of = g.of[src]
    n = np.bincount(of, minlength=len(g.first) - 1)
    base = np.cumsum(n) - n
    rank = np.arange(len(src)) - base[of]
    # of the last two nodes one is left: the out-degree of the first, the source of the second
    left = (rank < n[of] - 1) | (n[of] == 1)
    at = np.minimum(np.arange(len(src)) + ((rank == n[of] - 2) & (n[of] > 1)), max(len(src) - 1, 0))
    node_of, node_rank, node_src, deg = of[left], rank[left], src[at][left], deg[left]
    r, a, b = edges
    eo, k = g.of[a], g.label[a]
    er = r - base[eo]
    moved = (k != 4) & (er >= n[eo] - 1)
    er, k = er - moved, np.where(k == 4, 5, k)
    order = np.lexsort((b, a, moved, k, er, eo))
    eo, er, k = eo[order], er[order], k[order]
    count = np.bincount(eo, minlength=len(n))
    begin = np.cumsum(count) - count
    row = np.arange(len(eo)) - begin[eo]
    f = np.r_[True, (er[1:] != er[:-1]) | (eo[1:] != eo[:-1])][: len(eo)]
    spans = np.maximum(deg, 1)
    upto = np.cumsum(spans) - spans
    head = np.r_[True, node_of[1:] != node_of[:-1]][: len(node_of)]
    starts = upto - np.maximum.accumulate(np.where(head, upto, 0))
    m = np.zeros(len(eo), bool)
    ok = starts < count[node_of]
    m[(begin[node_of] + starts)[ok]] = True
    return Index(eo, row, k, f, m, node_of, node_rank, node_src)


def spelled(x: Index, graphs: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Graph and node for each node from which a graph spells its word, by backward steps over the rows of all graphs at once."""
    size = np.bincount(x.of, minlength=graphs)
    begin = np.cumsum(size) - size
    upto = {c: np.r_[0, np.cumsum(x.label == i)] for i, c in enumerate(LETTERS)}
    marks, fs = np.r_[0, np.cumsum(x.m)], np.flatnonzero(x.f)
    some = np.bincount(x.of[fs], minlength=graphs)
    f0 = np.cumsum(some) - some
    all_ = begin + size
    smaller = np.cumsum([np.zeros(graphs, np.int64), *(upto[c][all_] - upto[c][begin] for c in LETTERS)], axis=0)
    top, bot = np.zeros(graphs, np.int64), size.copy()
    bot[[not w for w in words]] = 0

    def row_of(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The row of the k-th flag f, from 1; the number of rows where there is none."""
        out = size[i].copy()
        ok = (k > 0) & (k <= some[i])
        out[ok] = fs[f0[i[ok]] + k[ok] - 1] - begin[i[ok]]
        return out

    for step in range(max(map(len, words), default=0)):
        for j, c in enumerate(LETTERS):
            i = np.array([w for w, t in enumerate(words) if len(t) > step and t[-1 - step] == c and top[w] < bot[w]], np.int64)
            lo, hi = (smaller[j][i] + upto[c][begin[i] + e[i]] - upto[c][begin[i]] for e in (top, bot))
            none = lo >= hi
            p = marks[begin[i] + np.minimum(lo, size[i] - 1) + 1] - marks[begin[i]]
            q = marks[begin[i] + np.minimum(np.maximum(hi, 1), size[i])] - marks[begin[i]] + 1
            top[i], bot[i] = row_of(i, p), np.where(none, 0, row_of(i, q))
        bad = [w for w, t in enumerate(words) if len(t) > step and t[-1 - step] not in LETTERS]
        bot[bad] = 0
    nodes = np.bincount(x.node_of, minlength=graphs)
    base = np.cumsum(nodes) - nodes
    i = np.flatnonzero(top < bot)
    number = lambda e: np.searchsorted(fs, begin[i] + e[i]) - f0[i]  # noqa: E731  flags f before a row
    a, b = number(top), np.minimum(number(bot), nodes[i])
    n = np.maximum(b - a, 0)
    return np.repeat(i, n), x.src[ranges_of(base[i] + a, n)]


def each(graphs: DataFrame, key: str, of: Callable[[Graphs, list[str]], tuple[np.ndarray | None, list]], more: str, keyed: bool = True, together: int = TOGETHER) -> DataFrame:
    """The rows that `of` makes of many graphs at once: the graph of each row and columns `more`, beside the graph's key.

    `graphs` has the key, text, single and base (places and letters of substitutions), gone and size (places and lengths
    of deletions). Rows that aren't `keyed` are of all graphs that were worked on together.
    """
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            upto = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + together, side="right")))
                part = batch.slice(a, b - a)
                single, gone, size = (part.column(i) for i in (2, 4, 5))
                g = made(texts[a:b], single, part.column(3).to_pylist(), gone, size)
                at, cols = of(g, texts[a:b])
                cols = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)]
                names = [n for n, _ in fields]
                if keyed:
                    cols, names = [part.column(0).take(pa.array(at)), *cols], [key, *names]
                whole = pa.RecordBatch.from_arrays(cols, names)
                for i in range(0, len(whole), ROWS):
                    yield whole.slice(i, ROWS)
                a = b

    kind = graphs.schema[key].dataType.simpleString()
    # texts are dealt out anew, as a small file or one of few row groups would be few tasks
    dealt = graphs.select(key, "text", "single", "base", "gone", "size").repartition(int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.mapInArrow(run, f"{key} {kind}, {more}" if keyed else more)


def curve_of(graphs: DataFrame, key: str) -> list[tuple[int, int, int, int]]:
    """The curve of all graphs together, made deterministic and doubled: what `graph.doubling` counts for each generation.

    Graphs that end early go on with the counts of their last generation; the driver sees a row or two a generation.
    """

    def of(g: Graphs, _: list[str]) -> tuple[None, list]:
        curve = doubled(determinized(g))[1]
        return None, [*(np.array(c) for c in zip(*curve, strict=True)), np.arange(len(curve)) == len(curve) - 1]

    got = each(graphs, key, of, "gen long, temp long, nodes long, ranks long, last boolean", keyed=False)
    return joined_curve([tuple(r) for r in got.groupBy("gen", "last").agg(*[F.sum(c) for c in ("temp", "nodes", "ranks")]).collect()])


def joined_curve(parts: list[tuple[int, bool, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Sums (generation, whether it was the last, joined, kept, ranks) as one curve; what ended goes on as it was."""
    most = max((p[0] for p in parts), default=1)
    out = np.zeros((most + 1, 3), np.int64)
    for gen, last, *sums in parts:
        out[gen] += sums
        if last:
            # a finished graph's paths pass as they are
            out[gen + 1 :] += [sums[1], sums[1], sums[2]]
    return [(i, *row) for i, row in enumerate(out.tolist())]
