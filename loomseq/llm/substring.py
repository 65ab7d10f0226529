"""Substring dedup by seed and extend over winnowed anchors.

Seeds: every window of 50 words has an anchor, the least hash of the SEED-word grams in it, so equal windows have equal
anchors and a document has about one anchor per 21 words. Documents are joined on anchors. Around anchors that two
documents share, matches are extended both ways: each window that holds the anchor is named by a cryptographic digest of its
words themselves, and windows of that name are grouped to find the first document with it. Neighbouring matched windows
make up the maximal repeats, whose words go. Exact copies are settled by their digest before. Hashes only propose; what
goes is decided by digests for which no two different inputs are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_chunks, written

SEED = 10
EMPTY = hashlib.sha256(b"").digest()
FOLD = np.uint64(0x9E6C63D0876A9A47)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH3 hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by place of the first: halves are joined and mixed, so nothing cancels out."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    h, have = w, 1
    while have < k:
        step = min(have, k - have)
        h = mix(h[:-step] * FOLD + h[step:])
        have += step
    return h


def anchors_of(words: list[bytes], length: int) -> np.ndarray:
    """The anchor of each window of `length` words."""
    low = gram_hashes(word_hashes(words), SEED)
    span = length - SEED + 1
    if len(low) < span:
        return np.zeros(0, np.int64)
    have = 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low.view(np.int64)


def names_of(flat: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of 128 bits, as two numbers, of the stretches of words between two byte places."""
    name = hashlib.blake2b
    digests = b"".join([name(flat[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _cut(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words that go; what stands between a kept word and the next word stays."""
    begin, _ = _spans(raw)
    begin = np.append(begin, len(raw))
    keep = np.flatnonzero(~gone)
    head = raw[: begin[0]] if len(keep) and keep[0] == 0 else b""
    return (head + b"".join(raw[begin[i] : begin[i + 1]] for i in keep.tolist())).decode()


def _spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which words begin and end."""
    white = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (binary) and, with `texts`, the kept text.

    A word goes if a window of `length` words that covers it also starts in a document with a smaller id; repeats
    within one document stay. Null texts have no words. Null ids count as larger than all others and equal to each
    other. Rows that repeat (equal id and text) are each judged alike. The kept text has what follows each kept word up
    to the next word; where nothing goes it is the input (null stays null). Empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(id_col).alias("given"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in text_chunks(batch, 3):
                n, sha, anchors = [], [], []
                for t in texts_:
                    words = (t or "").encode().split()
                    n.append(len(words))
                    sha.append(_digest(words))
                    anchors.append(np.unique(anchors_of(words, length)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "given", "tag", "n_words", "sha", "anchors"])

    seen = written(rows.mapInArrow(read, f"doc_id long, given {kind}, tag long, n_words long, sha binary, anchors array<long>"), "anchors")
    # exact copies: the first document of each word sequence stands for all
    first = seen.groupBy("sha").agg(F.min(F.struct("doc_id", "tag", "anchors")).alias("x")).select("sha", "x.doc_id", "x.tag", "x.anchors")
    seeds = first.select("doc_id", "tag", F.explode("anchors").alias("anchor"))
    # what rows are joined with is written first: Spark can split a hot key's rows between tasks only where both sides
    # of a join are plain exchanges, not where one is summed by that key
    shared = written(seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    seeded = seeds.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_list("anchor").alias("anchors"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_chunks(batch, 1)):
            for doc, text, tag, anchors in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3), strict=True):
                words = (text or "").encode().split()
                at = np.flatnonzero(np.isin(anchors_of(words, length), anchors.values.to_numpy()))
                flat, stops = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
                starts = np.concatenate([[0], stops[:-1] + 1])
                for i in range(0, len(at), 1 << 16):
                    j = at[i : i + (1 << 16)]
                    name = names_of(flat, starts[j], stops[j + length - 1])
                    cols = [np.full(len(j), doc), np.full(len(j), tag), name[:, 0], name[:, 1]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(j, pa.int32())], ["doc_id", "tag", "a", "b", "at"])

    keyed = rows.select("doc_id", "tag", "text")
    found = written(keyed.join(seeded, ["doc_id", "tag"]).select("doc_id", "text", "tag", "anchors").mapInArrow(extend, "doc_id long, tag long, a long, b long, at int"), "windows")
    named = written(found.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "repeats")
    repeats = found.join(named, ["a", "b"]).where("doc_id > lo").groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts_ in (x for batch in batches for x in text_chunks(batch, 1)):
            out: list[tuple] = []
            for doc, text, tag, at in zip(part.column(0).to_pylist(), texts_, part.column(2).to_pylist(), part.column(3), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at.values.to_numpy())
                edge[starts] += 1
                edge[starts + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc, tag, int(gone.sum()), _digest(kept), _cut(raw, gone) if texts else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()], strict=True)], ["doc_id", "tag", "gone", "kept", "text"])

    judged = keyed.join(repeats, ["doc_id", "tag"]).select("doc_id", "text", "tag", "at").mapInArrow(remove, "doc_id long, tag long, gone long, kept binary, text string").dropDuplicates(["doc_id", "tag"])
    settled = first.select("sha", "tag", "doc_id").join(judged.withColumnRenamed("text", "left"), ["doc_id", "tag"], "left").select("sha", F.col("doc_id").alias("first"), "gone", "kept", "left")
    out = seen.drop("anchors").join(settled, "sha")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= length)
    cols = [
        F.col("given").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(copy, F.lit("")).otherwise(F.col("left")).alias("kept_text"), "tag"] if texts else []))


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))
