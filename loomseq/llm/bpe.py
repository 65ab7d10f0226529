"""BPE encoding and decoding in batched numpy merge rounds.

The words of many texts are collected once each, their symbols lie in one flat array, and each round merges the
lowest-ranked pair of every word at once; ranks come from a binary search over sorted pair keys.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_chunks

#: The pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only (Latin letters and usual marks), without what may be a contraction, are cut into words
#: by arrays of character classes; all others by the pattern.
PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ‐-‧€]*")
CONTRACTED = re.compile("'(?:[stmd]|re|ve|ll)")
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
_CLASS = np.full(0x251, OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]], _CLASS[0] = SPACE, BREAK
for _a, _b in ("AZ", "az", "ªª", "µµ", "ºº", "ÀÖ", "Øö", "øɏ"):
    _CLASS[ord(_a) : ord(_b) + 1] = LETTER
_CLASS[[*range(48, 58), *map(ord, "²³¹¼½¾")]] = NUMBER
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 500_000
#: Symbols from which a word is merged with a heap: rounds over it would cost its length times its merges.
LONG_WORD = 256


def byte_symbols() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return out


_HASH = mix(np.arange(1, 0x2101, dtype=np.uint64))
_BASE = np.uint64(0x8EBC6AF09C88C6E3)
_power = [np.ones(1, np.uint64)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def flat(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places from each start on, so many as its length, one after another."""
    return np.repeat((starts - (np.cumsum(lens) - lens)).astype(np.int32), lens) + np.arange(int(lens.sum()), dtype=np.int32)


def hashes(letters: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, given end to end with their lengths: a guess at which words are equal, no more."""
    longest = int(lens.max())
    if len(_power[0]) < longest:
        table = np.full(1 << longest.bit_length(), _BASE, np.uint64)
        table[0] = 1
        _power[0] = np.multiply.accumulate(table)
    value = _HASH[letters] if letters.max() < len(_HASH) else mix(letters.astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(value * _power[0][flat(np.zeros(len(lens), np.int64), lens)], np.cumsum(lens) - lens))


def cut_plain(cp: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of plain texts, which zeros part from each other.

    Spaced, a blank belongs to the word after it and other white space is words of its own; otherwise white space is
    dropped and each number is a word.
    """
    kind = _CLASS[np.minimum(cp, 0x250)]
    new = np.ones(len(cp), bool)
    new[1:] = kind[1:] != kind[:-1]
    if not spaced:
        new |= kind == NUMBER
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    run = kind[starts]
    if not spaced:
        keep = (run != SPACE) & (run != BREAK)
        return starts[keep], ends[keep]
    # white space before a word: its last blank joins the word, another last character stands alone
    before = np.flatnonzero((run[:-1] == SPACE) & (run[1:] != BREAK))
    blank = cp[ends[before] - 1] == 32
    joined, alone = before[blank], before[~blank]
    starts[joined + 1] -= 1
    ends[joined] -= 1
    alone = alone[ends[alone] - starts[alone] > 1]
    ends[alone] -= 1
    extra = ends[alone]
    keep = (run != BREAK) & (ends > starts)
    starts, ends = np.concatenate([starts[keep], extra]), np.concatenate([ends[keep], extra + 1])
    if len(extra):
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends


class WordCache:
    """The ids of each distinct word, found once; subclasses say how words are encoded.

    Words are looked up by a hash and then compared letter by letter; where two that differ share a hash, the words of that
    call are found one by one.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._keys, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._letters, self._begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _add(self, words: list[str]) -> np.ndarray:
        """The numbers of new words."""
        ids, count = self.encode_words(words)
        number = np.arange(len(self._at) - 1, len(self._at) - 1 + len(words), dtype=np.int32)
        self._flat = np.concatenate([self._flat, ids.astype(np.int32)])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(count)])
        self._letters = np.concatenate([self._letters, points("".join(words))])
        self._begin = np.concatenate([self._begin, self._begin[-1] + np.cumsum([len(w) for w in words])])
        return number

    def _which(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the cache, in which words that are new get the next ones."""
        if not len(starts):
            return np.zeros(0, np.int32)
        if len(self._at) > CACHE_WORDS:
            self._forget()
        lens = ends - starts
        letters = cp[flat(starts, lens)]
        each = hashes(letters, lens)
        order = np.argsort(each)
        ordered = each[order]
        first = np.ones(len(order), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        key, at = ordered[first], order[first]
        back = np.empty(len(order), np.int32)
        back[order] = np.cumsum(first, dtype=np.int32) - 1
        place = np.searchsorted(self._keys, key)
        new = np.ones(len(key), bool)
        if len(self._keys):
            new = self._keys[np.minimum(place, len(self._keys) - 1)] != key
        old = self._place[place[~new]]
        alike = self._equal(cp, starts[at[~new]], lens[at[~new]], self._letters, self._begin[old], self._begin[old + 1] - self._begin[old])
        some = at[back]
        if not alike or (lens[some] != lens).any() or (cp[flat(starts[some], lens)] != letters).any():
            words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            number = dict(zip(dict.fromkeys(words), self._add(list(dict.fromkeys(words))).tolist(), strict=True))
            return np.array([number[w] for w in words], np.int32)
        fresh = at[new]
        if len(fresh):
            number = self._add([text[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            self._place = np.insert(self._place, place[new], number)
            self._keys = np.insert(self._keys, place[new], key[new])
            place = np.searchsorted(self._keys, key)
        return self._place[place][back]

    @staticmethod
    def _equal(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> bool:
        return bool((a_len == b_len).all() and (a[flat(a_at, a_len)] == b[flat(b_at, b_len)]).all())

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word begins among them."""
        first = self._at[which]
        count = self._at[which + 1] - first
        word_at = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count, out=word_at[1:])
        places = np.repeat((first - word_at[:-1]).astype(np.int32), count)
        places += np.arange(word_at[-1], dtype=np.int32)
        return self._flat[places], word_at

    def plain_ids(self, texts: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, and where each text begins among them."""
        text = "\0".join(texts)
        cp = points(text)
        starts, ends = cut_plain(cp, spaced) if len(cp) else (np.zeros(0, np.int64),) * 2
        ids, word_at = self._ids(self._which(text, cp, starts, ends))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return ids, word_at[np.searchsorted(starts, begin)]

    def piece_ids(self, words: list[str]) -> np.ndarray:
        """Ids of a list of words."""
        if not words:
            return np.zeros(0, np.int32)
        text = "".join(words)
        ends = np.cumsum([len(w) for w in words]).astype(np.int64)
        return self._ids(self._which(text, points(text), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends))[0]


class ByteBPE(WordCache):
    """Encoder and decoder for a byte-level vocabulary file (JSON with model.vocab and model.merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_symbols()
        self.of_byte = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1 if self.special else max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        self.keys, self.rank, self.made = keys, order[first], made[order][first]
        self.none = len(merges)
        self.by_rank = np.zeros(self.none + 1, np.int64)
        self.by_rank[self.rank] = self.made
        back = {c: b for b, c in chars.items()}
        texts: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            texts[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._any = regex.compile(PATTERN)
        super().__init__()

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[i] == pair, self.rank[i], self.none)

    def _long(self, symbols: list[int]) -> list[int]:
        """One long word: a heap of (rank, place) and links between what is left."""
        n = len(symbols)
        sym, right, left = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        table = self._pairs
        heap = [(r[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := table.get(sym[i] * self.size + sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = table[a * self.size + b][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (r := table.get(sym[x] * self.size + sym[right[x]])):
                    heapq.heappush(heap, (r[0], x, sym[x], sym[right[x]]))
        return [s for s in sym if s >= 0]

    @property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pair_table"):
            self._pair_table = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        return self._pair_table

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words of `lens` symbols each; the symbols and lengths that are left."""
        n_words = len(lens)
        word = np.repeat(np.arange(n_words), lens)
        done_sym, done_word = [], []
        while len(sym):
            pair = np.full(len(sym), self.none, np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            pair[inside] = self.ranks(sym[inside] * self.size + sym[inside + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, starts)
            size = np.diff(np.r_[starts, len(sym)])
            each = np.repeat(best, size)
            over = each == self.none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, pair, each = sym[keep], word[keep], pair[keep], each[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(pair == each)
            # of hits that overlap (a a a), every second one is merged, from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[place % 2 == 0]
            sym[hit] = self.by_rank[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return sym, np.zeros(n_words, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has."""
        raw = [w.encode() for w in words]
        lens = np.array([len(b) for b in raw], np.int64)
        long = np.flatnonzero(lens > LONG_WORD)
        short = lens <= LONG_WORD
        sym, count = self.merge(self.of_byte[np.frombuffer(b"".join(b for b in raw if len(b) <= LONG_WORD), np.uint8)], lens[short])
        if not len(long):
            return sym, count
        at = np.concatenate([[0], np.cumsum(count)])
        parts, j = [], 0
        for b in raw:
            if len(b) > LONG_WORD:
                parts.append(np.array(self._long(self.of_byte[np.frombuffer(b, np.uint8)].tolist()), np.int64))
            else:
                parts.append(sym[at[j] : at[j + 1]])
                j += 1
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and the offsets at which each begins (one more than texts)."""
        plain = [bool(PLAIN.fullmatch(t)) and not CONTRACTED.search(t) and not (self._special and self._special.search(t)) for t in texts]
        ids, at = self.plain_ids([t for t, p in zip(texts, plain, strict=True) if p], True)
        if all(plain):
            return ids, at
        out, j = [], 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                out.append(ids[at[j] : at[j + 1]])
                j += 1
                continue
            parts = self._special.split(t) if self._special else [t]
            out.append(np.concatenate([np.array([self.special[x]], np.int32) if i % 2 else self.piece_ids(self._any.findall(x)) for i, x in enumerate(parts)]))
        return np.concatenate(out), np.cumsum([0, *map(len, out)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from one flat table of token bytes."""
        n = self.token_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.token_bytes[np.arange(total) - np.repeat(ends - n - self.token_at[ids], n)].tobytes()


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (little-endian unsigned 32-bit, null text: none), decoded (text from the ids).

    Empty texts have no ids and decode to the empty text; rows that repeat are encoded each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in text_chunks(batch, 1):
                ids, at = bpe.encode_batch([t or "" for t in texts])
                out = [ids[at[i] : at[i + 1]] for i in range(len(texts))]
                back = [bpe.decode(x).decode("utf-8", "replace") for x in out]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("<u4").tobytes() for x in out], pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
