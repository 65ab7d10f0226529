"""Harmonic packing of token ids into sequences of a fixed capacity.

A piece of n ids belongs to class k = capacity // n, and a bin of class k takes exactly k pieces. A document is cut
where that costs least: each piece that doesn't fill its class pads the bin, and each further piece counts as PIECE ids.
Pieces under LEAST ids aren't made but for tails, which are packed end to end with what open bins hold when a worker
ends; a worker packs what it tokenizes, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import text_chunks

#: What a further piece of a document may save in padding, and the ids that a piece of a bin has at least.
PIECE, LEAST = 10, 32
#: Ids of tails that a worker holds before it packs them.
TAILS = 1 << 16


@cache
def cuts(capacity: int) -> list[int]:
    """For n ids up to the capacity, the length of the first piece by which cutting them costs least."""
    cost, first = [0.0], [0]
    for n in range(1, capacity + 1):
        k = capacity // n
        # whole: its share of what the bin's padding comes to; a tail costs no padding
        best, size = (PIECE + capacity / k - n, n) if n >= LEAST else (PIECE, n)
        for k in range(capacity // n + 1, capacity // LEAST + 1):
            a = capacity // k
            if (c := PIECE + capacity / k - a + cost[n - a]) < best:
                best, size = c, a
        cost.append(best)
        first.append(size)
    return first


def cut(n: int, capacity: int) -> list[int]:
    """The lengths of the pieces of a document of n ids."""
    out, first = [capacity] * (n // capacity), cuts(capacity)
    n %= capacity
    while n:
        out.append(first[n])
        n -= first[n]
    return out


class Packer:
    """Open bins of one worker: fewer than k pieces for each class k, so fewer ids than classes times the capacity."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.sequence = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.tails: list[tuple] = []
        self.held = 0

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for n in cut(len(ids), self.capacity):
            k = self.capacity // n
            piece = (doc, start, ids[start : start + n].copy(), len(ids))
            start += n
            if n < LEAST:
                self.tails.append(piece)
                self.held += n
                continue
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                yield from self.emit(self.open.pop(k))
        if self.held >= max(TAILS, self.capacity):
            yield from self.end_to_end(False)

    def close(self) -> Iterator[tuple]:
        """What is left in open bins and tails, end to end."""
        self.tails += [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        yield from self.end_to_end(True)

    def end_to_end(self, last: bool) -> Iterator[tuple]:
        """Full sequences of tails, cut freely; at last the rest too, at powers of two, unpadded."""
        rest = self.tails
        left = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (left // self.capacity)
        if last:
            sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (left % self.capacity) >> b & 1]
        at = 0
        for size in sizes:
            taken: list[tuple] = []
            while size:
                doc, start, ids, total = rest[at]
                taken.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    rest[at] = (doc, start + size, ids[size:], total)
                    size = 0
                else:
                    size -= len(ids)
                    at += 1
            yield from self.emit(taken)
        self.tails = rest[at:]
        self.held = sum(len(p[2]) for p in self.tails)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: empty) and the end id, so an empty text is one piece of one id.
    Rows that repeat are packed each. Sequence ids are unique: partition number in the upper bits, then a count.
    An empty table gives no rows; other columns are ignored. Needs a capacity that is a power of two to leave the
    last sequences of a worker unpadded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = load(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], np.int64)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            cols = [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kind, rows = pa.int64(), []
        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in text_chunks(batch, 1):
                ids, at = bpe.encode_batch([t or "" for t in texts])
                for i, key in enumerate(part.column(0).to_pylist()):
                    rows.extend(packer.add(key, np.concatenate([ids[at[i] : at[i + 1]], end])))
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield batch_of(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    out = pack(docs, tokenizer, capacity, end_id)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
