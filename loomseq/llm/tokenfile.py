"""Token ids in a byte-aligned variable-length file format.

A block holds consecutive documents. Its ids are replaced by their frequency rank in the block, each rank takes one
to four bytes, and two bits a rank in separate control bytes say how many. Blocks are self-contained, so a task that
is run again writes the same block, and nothing is counted on the driver. Layout, little-endian:

    4 bytes  LSV1
    u32      number of documents, number of distinct ids, width of an id in the rank table (2 or 4)
    u64      number of ids, number of data bytes
    table    ids by descending frequency (ties: ascending id)
    u64      ids of each document
    i64, u8  id of each document, 1 where it is null
    control  one byte for four ranks, lowest bits first
    data     1 to 4 bytes a rank
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import CONTRACTED, PLAIN, WordCache
from .common import Ranges, partitions, text_chunks, written

HEAD = struct.Struct("<4sIIIQQ")
#: Ids from which a block is closed: its rank table is then a few hundredths of it.
BLOCK_IDS = 1 << 20
#: The words of lower-case vocabularies with word ends.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBPE(WordCache):
    """The tokenizers library behind a cache of words: plain texts are cut and lower-cased here, others go to it whole."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        normal, split = spec.get("normalizer") or {}, json.dumps(spec.get("pre_tokenizer"))
        steps = [n["type"] for n in normal.get("normalizers", [])]
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and json.dumps(WORDS)[1:-1] in split
        self.single = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None}))
        for t in (self.whole, self.single):
            t.no_truncation()
            t.no_padding()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.single.encode_batch_fast(words, add_special_tokens=False)]
        count = np.array(list(map(len, ids)), np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum())), count

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() if self.cuts else t for t in texts]
        plain = [self.cuts and bool(PLAIN.fullmatch(t)) and not CONTRACTED.search(x) and not any(s in t for s in self.special) for t, x in zip(texts, low, strict=True)]
        ids, at = self.plain_ids([x for x, p in zip(low, plain, strict=True) if p], False)
        out, j = [], 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                out.append(ids[at[j] : at[j + 1]])
                j += 1
            else:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32))
        return out


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    # a task has a core to itself: the library's threads would compete with other tasks for theirs
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def write_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    lens = np.array([len(x) for _, x in docs], "<u8")
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.int64)
    if len(ids) and ids.max() < 1 << 22:
        count = np.bincount(ids)
        found = np.flatnonzero(count)
        count, at = count[found], np.zeros(int(ids.max()) + 1, np.int32)
        at[found] = np.arange(len(found), dtype=np.int32)
        back = at[ids]
    else:
        found, back, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -count))
    rank_of = np.empty(len(order), np.int32)
    rank_of[order] = np.arange(len(order), dtype=np.int32)
    ranks = rank_of[back]
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for bits in (8, 16, 24):
        if len(found) > 1 << bits:
            code[: len(ranks)] += ranks >= 1 << bits
    four = code.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    first = np.cumsum(code[: len(ranks)], dtype=np.int64) + np.arange(len(ranks))  # the last byte of each rank
    data = np.zeros(int(first[-1]) + 1 if len(ranks) else 0, np.uint8)
    first -= code[: len(ranks)]
    data[first] = ranks & 255
    for i in (1, 2, 3):
        if len(found) > 1 << 8 * i:
            more = np.flatnonzero(code[: len(ranks)] >= i)
            data[first[more] + i] = ranks[more] >> 8 * i & 255
    data = data.tobytes()
    width = 2 if not len(found) or found[-1] < 1 << 16 else 4
    keys = np.array([0 if k is None else k for k, _ in docs], "<i8")
    null = np.array([k is None for k, _ in docs], np.uint8)
    head = HEAD.pack(b"LSV1", len(docs), len(found), width, len(ids), len(data))
    return b"".join([head, found[order].astype(f"<u{width}").tobytes(), lens.tobytes(), keys.tobytes(), null.tobytes(), control.tobytes(), data])


#: Of each control byte, the lengths of its four ranks.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document (counts), and all ids."""
    magic, n_docs, n_found, width, n_ids, n_data = HEAD.unpack_from(block)
    if magic != b"LSV1":
        raise ValueError("not a block of token ids")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, n, at)
        at += out.nbytes
        return out

    table, lens, keys, null = take(f"<u{width}", n_found), take("<u8", n_docs), take("<i8", n_docs), take("u1", n_docs)
    size = LENGTHS[take("u1", -(-n_ids // 4))].reshape(-1)[:n_ids]
    data = np.concatenate([take("u1", n_data), np.zeros(3, np.uint8)])
    first = np.cumsum(size, dtype=np.int64) - size
    ranks = data[first].astype(np.int32)
    for i in (1, 2, 3):
        if n_found > 1 << 8 * i:
            more = np.flatnonzero(size > i)
            ranks[more] |= data[first[more] + i].astype(np.int32) << 8 * i
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], lens.astype(np.int64), table.astype("<u4")[ranks]


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, buckets: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files (a Parquet table of blocks in the shared folder) and returns the table.

    Columns: bucket, block, before (ids of the bucket ahead of the block), n_ids, payload. Buckets are ranges of the
    integer document id in ascending order (null ids first); within one, blocks are in order. Rows with one id follow
    each other in any order; where they, or rows without an id, fill several buckets, they get several.
    """
    ranges = Ranges(docs, id_col, buckets or 4 * partitions(docs.sparkSession))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in text_chunks(batch, 2):
                ids = [x.astype("<u4").tobytes() if len(x) and x.max() > 0xFFFF else b"\0" + x.astype("<u2").tobytes() for x in bpe.encode_batch([t or "" for t in texts])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, before, held, size = None, 0, 0, [], 0
        end = np.array([end_id], np.int32)

        def close() -> pa.RecordBatch:
            cols = [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([write_block(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "before", "n_ids", "payload"])

        for batch in batches:
            for b, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != bucket or size >= BLOCK_IDS):
                    yield close()
                    block, before, held, size = block + 1, before + size, [], 0
                if b != bucket:
                    bucket, block, before = b, 0, 0
                # an odd number of bytes: a zero and two bytes an id; else four bytes an id
                ids = np.frombuffer(raw, "<u2", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u4")
                held.append((key, np.concatenate([ids.astype(np.int32), end])))
                size += len(ids) + 1
        if held:
            yield close()

    spread = F.pmod(F.monotonically_increasing_id(), F.lit(997)) / F.lit(997.0)
    rows = docs.select(ranges.number(F.col(id_col).cast("long"), spread).alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(tokens, "bucket int, doc_id long, ids binary").repartitionById(ranges.count, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    return written(dealt.mapInArrow(blocks, "bucket int, block int, before long, n_ids long, payload binary"), "tokens")


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), ids (unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, lens, ids = read_block(payload)
                ends = np.cumsum(lens)
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, lens, strict=True)]
                cols = [pa.array([bucket] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(before + ends - lens, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "doc_id", "local", "ids"])

    total = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    # one row a bucket, and the number of buckets is a parameter
    base = total.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    docs = files.select("bucket", "before", "payload").mapInArrow(run, "bucket int, doc_id long, local long, ids binary")
    return docs.join(F.broadcast(base), "bucket").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "ids")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return read(files).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
