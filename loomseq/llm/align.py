"""Alignment of two tokenizers over whole texts: groups of tokens, and how many documents link each pair of ids.

Every byte of a text has a label: whether a token of A, one of B, both or none end there. A regular expression over the
label string finds the spans up to each label of both, and the labels in a span say how many tokens of either side its
group has. Documents of about BLOCK_LINKS distinct links make a block, which holds its links as numbers of its own list
of pairs: so what is counted and looked up over the corpus are the pairs of blocks, not those of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, ByteBPE, flat
from .common import text_chunks, written

#: Labels of a byte.
A_ENDS, B_ENDS, BOTH = b"\1", b"\2", b"\3"
_SPAN = re.compile(rb"[^\x03]*\x03")
#: Distinct links of documents from which a block is closed, links that are expanded together, and letters of words that
#: a worker remembers.
BLOCK_LINKS, LINKS, CACHE_CHARS = 1 << 22, 1 << 21, 1 << 24


class PlainBPE(ByteBPE):
    """A byte-level vocabulary to which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._special = None


class PieceBPE:
    """A sentencepiece model behind a cache of words. No piece goes on over a space, so words are encoded on their own."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        texts = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        kept = "".join(self.model.encode("  a  b ", out_type=str)) == "▁▁▁a▁▁b▁"
        self.cuts = kept and not any(re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.ids, self.at, self.count = 0, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        if len(self.number) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
            new = list(words)
        got = self.model.encode(new, num_threads=1)
        count = np.array(list(map(len, got)), np.int64)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int32, int(count.sum()))])
        self.count = np.concatenate([self.count, count])
        self.chars += sum(map(len, new))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and the offsets at which each begins (one more than texts)."""
        words = [t.split(" ") if self.cuts else [] for t in texts]
        plain = [bool(w) and all(w) for w in words]
        known = list(chain.from_iterable(w for w, p in zip(words, plain, strict=True) if p))
        self._learn(set(known))
        which = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))
        count = self.count[which]
        ids = self.ids[flat(self.at[which], count)]
        ends = np.cumsum(count)
        n = np.array([len(w) if p else 0 for w, p in zip(words, plain, strict=True)], np.int64)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        if all(plain):
            return ids, at
        out = [ids[at[i] : at[i + 1]] if p else np.array(self.model.encode(t, num_threads=1), np.int32) for i, (t, p) in enumerate(zip(texts, plain, strict=True))]
        return np.concatenate(out) if out else ids, np.cumsum([0, *map(len, out)])

    decode = ByteBPE.decode


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = PlainBPE(a), PieceBPE(b)
        self.names = [f"{i}{mark}" for size, marks in ((self.a.size, ",|"), (self.b.size, ",;")) for mark in marks for i in range(size)]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets of A and of B; none of texts that either side's tokens don't spell."""
        raw = [" " + t if t else "" for t in texts]
        a, a_at = self.a.encode_batch(raw)
        b, b_at = self.b.encode_batch([t or "" for t in texts])
        whole = "".join(raw).encode()
        if self.a.decode(a) != whole or self.b.decode(b) != whole:
            right = [self.a.decode(a[a_at[i] : a_at[i + 1]]) == self.b.decode(b[b_at[i] : b_at[i + 1]]) == t.encode() for i, t in enumerate(raw)]
            a, b = (np.concatenate([x[at[i] : at[i + 1]] if r else x[:0] for i, r in enumerate(right)]) for x, at in ((a, a_at), (b, b_at)))
            a_at, b_at = (np.concatenate([[0], np.cumsum(np.diff(at) * right)]) for at in (a_at, b_at))
        return a, a_at, b, b_at

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group has, by the label string of the texts one after another."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a_end, b_end = np.cumsum(self.a.token_len[a]), np.cumsum(self.b.token_len[b])
        labels = np.zeros(int(a_end[-1]), np.uint8)
        labels[a_end - 1] |= A_ENDS[0]
        labels[b_end - 1] |= B_ENDS[0]
        spans = _SPAN.findall(labels.tobytes())
        # few spans differ, so the labels of each are counted once
        kinds = {s: i for i, s in enumerate(set(spans))}
        which = np.fromiter(map(kinds.__getitem__, spans), np.int64, len(spans))
        n_both = np.array([s.count(BOTH) for s in kinds])
        n_a, n_b = (np.array([s.count(x) for s in kinds]) + n_both for x in (A_ENDS, B_ENDS))
        return n_a[which], n_b[which]

    def written_groups(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The groups of each text as a1,a2|b1;a3|b2,b3."""
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[np.cumsum(n_a) - 1] = 1
        b_last[np.cumsum(n_b) - 1] = 1
        place = np.zeros(len(a) + len(b), np.int64)
        # before a token of A stand the B tokens of earlier groups, before one of B also the A tokens of its own
        place[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = a + self.a.size * a_last
        place[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b + 2 * self.a.size + self.b.size * b_last
        names = list(map(self.names.__getitem__, place.tolist()))
        at = (a_at + b_at).tolist()
        return ["".join(names[s:e])[:-1] for s, e in zip(at[:-1], at[1:], strict=True)]

    def links(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, links) once for each document and pair, in parts; `doc` is the document of each group.

        Equal ids of one group are taken together first where groups are large, and parts are cut between ids of A: so
        about LINKS pairs are expanded together, however many tokens a group has.
        """
        ga, gb = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        ca, cb = None, None
        if int((n_a * n_b).sum()) > LINKS:
            ga, a, ca = _distinct(ga, a, self.a.size)
            gb, b, cb = _distinct(gb, b, self.b.size)
            order = np.lexsort((a, doc[ga]))
            ga, a, ca = ga[order], a[order], ca[order]
        n = np.bincount(gb, minlength=len(n_b))
        first, k = np.cumsum(n) - n, n[ga]
        cuts = [0, len(a)]
        if ca is not None and len(a):
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[ga[1:]] != doc[ga[:-1]])])
            upto = np.cumsum(np.add.reduceat(k, new))
            # a part ends where the next id of A would go beyond a multiple of LINKS
            cuts = [*new[np.flatnonzero(np.r_[True, np.diff(upto // LINKS) > 0])].tolist(), len(a)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            other = flat(first[ga[s:e]], k[s:e])
            key = (np.repeat(doc[ga[s:e]] * self.a.size + a[s:e], k[s:e])) * self.b.size + b[other]
            if ca is None:
                key, count = np.unique(key, return_counts=True)
            else:
                key, at = np.unique(key, return_inverse=True)
                count = np.zeros(len(key), np.int64)
                np.add.at(count, at, np.repeat(ca[s:e], k[s:e]) * cb[other])
            yield key // (self.a.size * self.b.size), key % (self.a.size * self.b.size), count


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, count


def _small(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_loaded: dict[tuple[str, str], Aligner] = {}


def load(a: str, b: str) -> Aligner:
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


_DOC = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups"]
_BLOCK = ["block", "pairs", "docs", "rows", "lens", "numbers", "times"]


def _blocks(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: one for each document, and one for each block of links (block is null for documents).

    A block has its distinct pairs, the documents of each, the rows of its documents, how many links each has (lens),
    and for each link its pair's number in the block and how often it occurs (times).
    """
    kind = docs.schema[id_col].dataType
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part_id = load(a, b), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state = {"row": part_id << 33, "block": part_id << 33, "links": 0}
        id_type = None

        def block() -> pa.RecordBatch:
            rows, pairs, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            distinct, number, n_docs = np.unique(pairs, return_inverse=True, return_counts=True)
            own = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            lens = np.diff(np.r_[own, len(rows)])
            one = {"block": pa.array([state["block"]], pa.int64()), "pairs": pa.array([distinct], longs), "docs": pa.array([n_docs], ints), "rows": pa.array([rows[own]], longs), "lens": pa.array([lens], ints), "numbers": pa.array([_small(number)], pa.binary()), "times": pa.array([_small(times)], pa.binary())}
            state["block"] += 1
            state["links"] = 0
            none = [pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([*none, *one.values()], [*_DOC, *_BLOCK])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part, texts in text_chunks(batch, 1):
                ids_a, a_at, ids_b, b_at = aligner.tokens(texts)
                n_a, n_b = aligner.groups(ids_a, ids_b)
                ends = np.searchsorted(np.cumsum(n_a), a_at, side="right")  # groups before each text
                doc = np.repeat(np.arange(len(texts)), np.diff(ends))
                n_links = np.diff(np.concatenate([[0], np.cumsum(n_a * n_b)])[ends])
                numbers = [np.arange(len(texts)) + state["row"], np.diff(a_at), np.diff(b_at), np.diff(ends), n_links]
                groups = aligner.written_groups(ids_a, a_at, ids_b, b_at, n_a, n_b)
                none = [pa.nulls(len(part), t) for t in (pa.int64(), longs, ints, longs, ints, pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in numbers], pa.array(groups, pa.string()), *none], [*_DOC, *_BLOCK])
                for d, pair, times in aligner.links(doc, ids_a, ids_b, n_a, n_b):
                    if len(d):
                        held.append((d + state["row"], pair, times))
                        state["links"] += len(d)
                    if state["links"] >= BLOCK_LINKS:
                        yield block()
                state["row"] += len(texts)
        if held:
            yield block()

    schema = f"doc_id {kind.simpleString()}, row long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, pairs array<long>, docs array<int>, rows array<long>, lens array<int>, numbers binary, times binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _tally(links: pa.Table, counts: pa.Table) -> pa.Table:
    """row, n_best, count_sum of the documents of one block, from its links and the counts of its pairs."""
    count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    number = counts.column("number").to_numpy()
    count[number], best[number] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    out: list[list[np.ndarray]] = [[], [], []]
    for one in links.to_pylist():
        lens = np.array(one["lens"], np.int64)
        n = int(lens.sum())
        of, times = _numbers(one["numbers"], n), _numbers(one["times"], n)
        starts = np.cumsum(lens) - lens
        out[0].append(np.array(one["rows"], np.int64))
        out[1].append(np.add.reduceat(best[of] * times, starts))
        out[2].append(np.add.reduceat(count[of] * times, starts))
    return pa.table({name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in zip(("row", "n_best", "count_sum"), out, strict=True)})


def align(docs: DataFrame, a: str, b: str, groups: Callable[[Column], Column] = lambda g: g, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    `a` is a byte-level vocabulary file, which encodes a space and the text; `b` a sentencepiece model, which adds the
    space itself. groups is the text a1,a2|b1;a3|b2,b3 of ids, or what the function of that name makes of it. A pair's
    count is the number of rows of `docs` that link it. Null and empty texts, and texts that either side can't spell,
    have no tokens: zeros and ''. Rows that repeat count each. An empty table gives no rows; other columns are ignored.
    """
    size = load(a, b).b.size
    seen = written(_blocks(docs, a, b, id_col, text_col).withColumn("groups", groups(F.col("groups"))), "aligned")
    each = seen.where("block is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("number", "p")).select("block", "number", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    source = F.expr(f"pair div {size}")
    # ids of A are as many as its vocabulary has, so the highest counts are a small table whatever the corpus
    top = counts.groupBy(source.alias("a")).agg(F.max("count").alias("top"))
    scored = counts.withColumn("a", source).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    looked = each.drop("n").join(scored, "pair").select("block", "number", "count", "best")
    links = seen.where("block is not null").select(F.col("block").alias("own"), "rows", "lens", "numbers", "times")
    sums = links.groupBy("own").cogroup(looked.groupBy("block")).applyInArrow(_tally, "row long, n_best long, count_sum long")
    sums = sums.groupBy(F.col("row").alias("of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = seen.where("block is null").select(*_DOC)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, F.col("row") == F.col("of"), "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))
    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest)
    return out.withColumnRenamed("groups", "groups_sha256")
