"""SimHash near-duplicates through an index of byte positions with count filtering.

Fingerprints that differ in at most 3 of 64 bits agree in 5 of 8 bytes at least. Posting lists of single bytes would
hold a 256th of all fingerprints each, so lists are kept for byte triples: the eight triples inside either half of the
bytes contain one of any five positions. Within a list the agreeing bytes of each pair are tallied, pairs with fewer
than five are dropped, and the rest are verified by their differing bits. Lists over HOT fingerprints are replaced
by lists of five bytes (56 a fingerprint), and such a list over HOT is dealt out as pairs of blocks. A task hands on a
spanning forest of the links that it found, never the pairs; components are joined by large-star/small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, text_chunks, written
from .substring import gram_hashes, word_hashes

BITS, LEAST_BYTES = 3, 5
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(8), LEAST_BYTES))
#: Fingerprints in one posting list that a task compares with each other.
HOT = 4096
#: Documents of a group of candidates whose shingles a task compares with each other.
SETS = 1024
#: Jaccard likeness of near-duplicates.
ALIKE = 0.8
#: MinHash values of a text, and how many of them a band has: texts alike by 0.8 have no band in common with a chance
#: of (1 - 0.8 ** ROWS) ** (HASHES / ROWS) = 4e-8, wherever their shingles differ.
HASHES, ROWS = 128, 4
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: MinHash values that candidates have in common: six standard deviations below those expected at ALIKE, 75 of 128.
COMMON = int(HASHES * ALIKE - 6 * math.sqrt(HASHES * ALIKE * (1 - ALIKE)))


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of word shingles, repeats included; 0 for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = len(found) - words + 1
    if n < 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        flat = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        digest = xxhash.xxh64_intdigest
        starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
        hashes = [digest(flat[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    flat = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(flat), 1 << 16):
        count += np.unpackbits(flat[a : a + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; a row for each row of `docs`, null texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_chunks(batch, 1)):
            fp = np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _key(positions: tuple[int, ...], number: int) -> Column:
    """The bytes at some positions of fp, and which positions they are."""
    parts = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * i) for i, p in enumerate(positions)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.lit(number << 8 * len(positions)).cast("long"), *parts])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that it is linked to through the links a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _close(fp: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Count filter and verification for pairs of 64-bit fingerprints."""

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = fp[i] ^ fp[j]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        return (tally >= LEAST_BYTES) & (np.bitwise_count(x) <= BITS)

    return near


def _linked(group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 1 << 20, hold: int = 1 << 20, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal groups (rows in order of group): each with the least place of its forest.

    Pairs that are connected already aren't tested; links are looked through for that when there are more than `hold`.
    The rows of a group that are `joined` are connected from the start.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    end = np.repeat(starts + sizes, sizes)
    at, root, shift, found, held = np.arange(n), np.arange(n), 0, [], 0
    if joined is not None:
        those = np.flatnonzero(joined)
        _, first, of = np.unique(group[those], return_index=True, return_inverse=True)
        root[those] = those[first[of]]
    while True:
        shift += 1
        at = at[at + shift < end[at]]
        if not len(at):
            break
        for part in np.array_split(at, -(-len(at) // step)):
            part = part[root[part] != root[part + shift]]
            part = part[near(part, part + shift)]
            found.append((part, part + shift))
            held += len(part)
        if held > hold:
            root = forest(n, np.concatenate([np.arange(n), *(a for a, _ in found)]), np.concatenate([root, *(b for _, b in found)]))
            found, held = [], 0
    root = forest(n, np.concatenate([np.arange(n), *(a for a, _ in found)]), np.concatenate([root, *(b for _, b in found)]))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _agree(sketches: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of sketches have COMMON of their bytes in common."""
    v = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, HASHES)
    return lambda i, j: (v[i] == v[j]).sum(1, dtype=np.int32) >= COMMON


def _alike(sketches: list[bytes], sets: list[bytes], likeness: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs have COMMON bytes of their sketches in common and sets of this Jaccard likeness at least."""
    agree, found = _agree(sketches), [np.frombuffer(x, "<u8") for x in sets]

    def alike(i: int, j: int) -> bool:
        x, y = found[i], found[j]
        if min(len(x), len(y)) < likeness * max(len(x), len(y)) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= likeness * (len(x) + len(y) - both) - 1e-9

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = agree(i, j)
        at = np.flatnonzero(out)
        out[at] = [alike(a, b) for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True)]
        return out

    return near


def _links(batches: Iterator[pa.RecordBatch], near: Callable | None = None, hold: int = 1 << 20, some_joined: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, node and, with `near`, columns of bytes that it tests) in that order, a group within one task.

    A group ends where key or block changes. Without `near` the node is the fingerprint itself. With `some_joined` a last
    column says which rows of a group are connected already.
    """

    def out(key: np.ndarray, block: np.ndarray, node: np.ndarray, *data: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        if near:
            joined = data[-1].astype(bool) if some_joined else None
            u, v = _linked(group, near(*(x.tolist() for x in (data[:-1] if some_joined else data))), 1 << 16, hold, joined)
        else:
            u, v = _linked(group, _close(node.view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], ["u", "v"])

    parts: list[tuple] = []
    size = room = 0

    def held() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        if len(batch):
            parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += len(batch)
            room += batch.nbytes
        if size < 1 << 16 and room < 1 << 25:
            continue
        key, block, *rest = held()
        last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield out(key[:cut], block[:cut], *(x[:cut] for x in rest))
        parts, size, room = [(key[cut:], block[cut:], *(x[cut:] for x in rest))], len(key) - cut, 0
    if parts:
        yield out(*held())


def _blocks(node: str, hot: int) -> Column:
    """The pairs of blocks in which a row of a list of n rows meets all others; [0] for a list of one block."""
    blocks = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o) * blocks + F.greatest(own, o)))
    return F.when(F.col("n") <= hot, F.array(F.lit(0))).otherwise(pairs)


def large_links(rows: DataFrame, data: list[str], near: Callable, hot: int, hold: int = 1 << 20) -> DataFrame:
    """Links (u, v) within groups (key, node, hub and columns `data` that `near` tests) of more than `hot` rows.

    Every row is tested against the group's hub first, its least node. Rows that are linked to it are connected, so pairs
    of them need no test: what is left, which copies of one template leave none of, is dealt into blocks of its own that
    meet each other and the blocks of linked rows. So a group of n rows of which r aren't linked to the hub costs r * n
    tests in parts of `hot` by `hot`, not n * n.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "node", "hub", *data)}

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = len(batch), [batch.column(3 + i).to_pylist() for i in range(len(data))]
            other = [batch.column(3 + len(data) + i).to_pylist() for i in range(len(data))]
            test = near(*(a + b for a, b in zip(own, other, strict=True)))
            joined = np.zeros(n, bool)
            for a in range(0, n, 1 << 12):
                at = np.arange(a, min(n, a + (1 << 12)))
                joined[at] = test(at, at + n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 3 + len(data)], pa.array(joined)], ["key", "node", "hub", *data, "joined"])

    hubs = rows.where("node = hub").select(F.col("key").alias("of"), *[F.col(c).alias(f"hub_{c}") for c in data])
    met = rows.join(hubs, F.col("key") == F.col("of")).select("key", "node", "hub", *data, *[f"hub_{c}" for c in data])
    tested = written(met.mapInArrow(star, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", joined boolean"), "star")
    left = tested.groupBy("key").agg(F.count_if("joined").alias("l"), F.count_if(~F.col("joined")).alias("r")).where("r > 0")
    left = written(left.select("key", F.ceil(F.col("l") / hot).cast("int").alias("l"), F.ceil(F.col("r") / hot).cast("int").alias("r")), "left")
    blocks = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("l")).otherwise(F.col("r"))).cast("long")
    rest = F.concat(F.transform(blocks("r"), lambda i: F.least(own, i) * F.col("r") + F.greatest(own, i)), F.transform(blocks("l"), lambda i: F.col("r") * F.col("r") + own * F.col("l") + i))
    known = F.transform(blocks("r"), lambda i: F.col("r") * F.col("r") + i * F.col("l") + own)
    pairs = tested.join(left, "key").select("key", F.explode(F.when(F.col("joined"), known).otherwise(rest)).alias("block"), "node", *data, "joined")
    pairs = pairs.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    found = pairs.mapInArrow(lambda x: _links(x, near, hold, True), "u long, v long")
    return found.unionByName(tested.where("joined and node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp), enough to connect all that differ in at most BITS bits."""

    def lists(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
        keyed = rows.select("fp", F.explode(F.array(*[_key(p, i) for i, p in enumerate(sets)])).alias("key"))
        # written, so that both sides of the join are plain exchanges and a hot key's rows can be split between tasks
        sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        return keyed.join(sizes, "key")

    three = written(lists(fps, TRIPLES), "lists")
    small = three.where(F.col("n") <= hot).select("key", F.lit(0).alias("block"), "fp")
    large = three.where(F.col("n") > hot).select("fp").distinct()
    five = lists(large, FIVES).withColumn("key", -1 - F.col("key"))  # negative: no key of three bytes
    rest = five.select("key", F.explode(_blocks("fp", hot)).alias("block"), "fp")
    rows = small.unionByName(rest).repartition("key", "block").sortWithinPartitions("key", "block", "fp")
    return rows.mapInArrow(_links, "u long, v long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node and root (the smallest node of its component) for every node of an edge, by large-star/small-star rounds.

    Each round is a written table; the driver sees a count and a checksum only. An error if the last round still
    changed the edges.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for turn in range(rounds + 1):
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        if turn == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(old, least, large, lower)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id (smallest doc_id that links reach, itself included).

    Texts without words share fingerprint 0 and are linked like any other. Ids that are null are no candidates for
    component_id; a component of null ids only has a null component_id. Repeated rows are kept. An empty table gives
    no rows.
    """
    fp = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(least.select("fp"), hot))
    of = least.join(root, least["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = written(of, "roots")
    first = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "first")
    of = of.join(first, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of the distinct shingles of `size` words, in order; fewer words: the whole sequence."""
    return np.unique(gram_hashes(word_hashes(words), min(size, len(words)))) if words else np.zeros(0, np.uint64)


def minhashes(found: np.ndarray) -> np.ndarray:
    """The least of a set of shingles under each of HASHES hash functions; sets agree in one by their Jaccard likeness."""
    out = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for a in range(0, len(found), 1 << 10):
        out = np.minimum(out, mix(found[a : a + (1 << 10)] ^ SEEDS[:, None]).min(1))
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values, apart from the keys of other bands."""
    return mix(mix(least ^ SEEDS[::-1]).reshape(-1, ROWS).sum(1, dtype=np.uint64)).view(np.int64)


def similar(docs: DataFrame, words: int = 5, likeness: float = ALIKE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", most: int = SETS) -> DataFrame:
    """One row per row of `docs` with an id: doc_id, tag (a hash of the text), component_id and first, the tag of the
    component's first row by id and tag.

    Documents whose sets of `words`-word shingles have this Jaccard likeness or more are linked; component_id is the
    smallest doc_id that links reach. Candidates share a band of MinHash values, which documents alike by ALIKE are near
    sure to do whatever the kind of edit, and COMMON values in all. The pairs of a group of candidates are verified by
    the sets of shingles themselves, whose hashes of 64 bits stand for them. Rows without an id are left out. Texts
    without words are one component. Repeated rows are kept.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_chunks(batch, 2)):
            node, sketches, keys = [], [], []
            for text in texts:
                found = shingles((text or "").encode().lower().split(), words)
                least = minhashes(found)
                node.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                keys.append(bands(least) if len(found) else [])
            columns = [part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "node", "sketch", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_chunks(batch, 3)):
            found = [shingles((t or "").encode().lower().split(), words).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], ["node", "root", "sketch", "found"])

    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text"))
    seen = written(rows.mapInArrow(sketch, "doc_id long, tag long, node long, sketch binary, keys array<long>"), "sketches")
    nodes = written(seen.groupBy("node").agg(F.min(F.struct("doc_id", "tag", "sketch", "keys")).alias("x")).select("node", "x.*"), "nodes")
    # sketches and keys are the bulk of these tables: each is deleted as soon as the next one is written
    ids = written(seen.select("doc_id", "tag", "node"), "ids")
    forget(seen)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "sizes")
    lists = keyed.join(sizes, "key")
    near = lists.where(F.col("n") <= hot).select("key", "node").join(nodes.select("node", "sketch"), "node").select("key", F.lit(0).alias("block"), "node", "sketch")
    near = near.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(lambda x: _links(x, _agree), "u long, v long")
    if sizes.where(F.col("n") > hot).limit(1).count():
        large = lists.where(F.col("n") > hot).select("key", "node", "hub").join(nodes.select("node", "sketch"), "node")
        near = near.unionByName(large_links(written(large, "large"), ["sketch"], _agree, hot))
    group = written(components(near).join(nodes.drop("keys"), "node"), "candidates")
    bare = written(nodes.select("node", "doc_id", "tag"), "bare")
    forget(sizes, nodes)
    texts = rows.join(group, ["doc_id", "tag"]).dropDuplicates(["node"]).select("node", "root", "sketch", "text")
    found = written(texts.mapInArrow(sets, "node long, root long, sketch binary, found binary"), "sets")
    sizes = written(found.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    near = lambda s, f: _alike(s, f, likeness)
    grouped = found.join(sizes, "root").select(F.col("root").alias("key"), "n", "node", "sketch", "found")
    pairs = grouped.where(F.col("n") <= most).select("key", F.lit(0).alias("block"), "node", "sketch", "found")
    pairs = pairs.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    alike = pairs.mapInArrow(lambda x: _links(x, near, 0), "u long, v long")
    if sizes.where(F.col("n") > most).limit(1).count():
        large = grouped.where(F.col("n") > most).select("key", "node", F.col("key").alias("hub"), "sketch", "found")
        alike = alike.unionByName(large_links(large, ["sketch", "found"], near, most, 0))
    root = components(alike)
    forget(group, found, sizes)
    of = written(bare.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"), "tag"), "roots")
    first = of.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("x"))
    first = written(first.select("root", F.col("x.doc_id").alias("component_id"), F.col("x.tag").alias("first")), "first")
    of = of.join(first, "root").select("node", "component_id", "first")
    return ids.join(of, "node").select("doc_id", "tag", "component_id", "first")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
