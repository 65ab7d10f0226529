"""Quality rules: counts with fixed limits, and divergence from the language.

Each text is described by its characters in classes and by how often common words occur. The references are the mean
histograms of each language over all documents that pass the counts, taken again over those near the first mean; so a
verdict depends on the table judged, unless references are given (`references` of another table, to be kept). A text
farther from its language than a limit in Jensen-Shannon distance is rejected, unless it is too short to tell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, written
from .substring import gram_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
#: Common words of each language.
COMMON = {
    "en": "the of and to in is that it for was on are as with by this be at or an not from but have had".split(),
    "fr": "le la les de des du et en un une que qui dans par pour sur pas au est il ne se ce avec plus".split(),
    "de": "der die das und in den von zu mit ist nicht des ein eine für auf dem im sich auch als an er es so".split(),
    "es": "el la los las de del que y en un una por con su para como más se lo al es no o este pero".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
_PLACE = {w.encode(): i for i, w in enumerate(WORDS)}
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Classes of bytes: lower case, upper case, digits, blank, line end, sentence marks, other marks, letters beyond ASCII, control; 9 is not counted.
CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r", 4), (b".,;:!?'\"()-", 5), (b"#$%&*+/<=>@[\\]^_`{|}~", 6)):
    _CLASS[list(_chars)] = _c
_CLASS[128:192], _CLASS[192:] = 9, 7

MIN_WORDS, REPEAT_WINDOW, REPEAT_SHARE = 20, 8, 30
#: Words below which divergence doesn't judge; the largest distances that pass in long texts; and what is added to
#: them for n words, divided by sqrt(n), since histograms of short texts scatter.
GUARD, FAR_CHARS, FAR_WORDS, SCATTER = 60, 0.13, 0.40, 0.8
LANGS = [*sorted(COMMON), ""]


def _repeated(words: list[bytes], hashes: Callable[[list[bytes]], np.ndarray] = word_hashes) -> np.ndarray:
    """Where windows of REPEAT_WINDOW words begin that are found twice or more: hashes propose, the words decide."""
    grams = gram_hashes(hashes(words), REPEAT_WINDOW)
    order = np.argsort(grams, kind="stable")
    equal = grams[order][1:] == grams[order][:-1]
    if not equal.any():
        return np.zeros(0, np.int64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    a, b = order[:-1][equal], order[1:][equal]
    if all((ids[a + i] == ids[b + i]).all() for i in range(REPEAT_WINDOW)):
        return np.union1d(a, b)
    # windows of one hash that differ: compare them all as they are
    _, which, n = np.unique(np.lib.stride_tricks.sliding_window_view(ids, REPEAT_WINDOW), axis=0, return_inverse=True, return_counts=True)
    return np.flatnonzero(n[which.ravel()] > 1)


def counts(text: str | None, symbols: str = SYMBOLS) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(words) > REPEAT_WINDOW and len(at := _repeated(words)):
        edge = np.zeros(len(words) + 1, np.int64)
        edge[at] += 1
        edge[at + REPEAT_WINDOW] -= 1
        repeats = int((np.cumsum(edge) > 0).sum())
    return len(words), len(text) - sum(text.count(c) for c in " \t\n\v\f\r"), sum(text.count(c) for c in symbols), len(lines) - len(set(lines)), repeats


def histograms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode()
    chars = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)[:CLASSES]
    found = Counter(_WORD.findall(raw.lower()))
    words = np.zeros(len(WORDS) + 1, np.int64)
    for w in _PLACE.keys() & found.keys():
        words[_PLACE[w]] = found[w]
    words[-1] = found.total() - words.sum()
    return chars, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row (p) against one distribution (q)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(0, (a.sum(-1) + b.sum(-1)) / 2))


def _near(chars: np.ndarray, words: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    room = SCATTER / np.sqrt(np.maximum(1, n_words))
    return (chars <= FAR_CHARS + room) & (words <= FAR_WORDS + room)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The written table of counts and histograms, a row for each row of `docs`; languages without a word list are ''."""
    lang = F.when(F.col(lang_col).isin(list(COMMON)), F.col(lang_col)).otherwise("") if lang_col in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, 3):
                base = [counts(t) for t in texts]
                hist = [histograms(t) for t in texts]
                cols = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
                lists = [pa.array([h[i] for h in hist], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols, *lists], ["doc_id", "tag", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), lang).alias("tag"), lang.alias("lang"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, tag long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return written(rows.mapInArrow(run, schema).withColumn("base_failed", failed), "features")


def _scores(batch: pa.RecordBatch, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of characters and of words from the reference of the row's language, else from the nearest one."""
    names = batch.schema.names
    hist = []
    for name in ("chars", "words"):
        x = np.stack(batch.column(names.index(name)).to_numpy(zero_copy_only=False)).astype(float) if len(batch) else np.zeros((0, 1))
        hist.append(x / np.maximum(1, x.sum(1, keepdims=True)))
    lang = np.array(batch.column(names.index("lang")).to_pylist(), object)
    out = [np.zeros(len(batch)), np.zeros(len(batch))]
    if not refs or not len(batch):
        return out[0], out[1]
    each = {k: (js_distance(hist[0], c), js_distance(hist[1], w)) for k, (c, w) in refs.items()}
    for i in (0, 1):
        near = np.min([d[i] for d in each.values()], axis=0)
        out[i] = np.select([lang == k for k in each if k], [d[i] for k, d in each.items() if k], near) if any(each) else near
    return out[0], out[1]


def references(table: DataFrame, rounds: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of each language over the whole feature table: len(LANGS) rows at most reach the driver."""
    rows = table.where(~F.col("base_failed") & (F.col("n_words") >= GUARD)).select("lang", "chars", "words", "n_words")
    refs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(rounds):

        def near(batches: Iterator[pa.RecordBatch], refs=refs) -> Iterator[pa.RecordBatch]:
            total: dict[str, list] = {}
            for batch in batches:
                if not len(batch):
                    continue
                c, w = _scores(batch, refs)
                ok = _near(c, w, batch.column(3).to_numpy())
                lang = np.array(batch.column(0).to_pylist(), object)
                hist = [np.stack(batch.column(i).to_numpy(zero_copy_only=False)).astype(float) for i in (1, 2)]
                hist = np.concatenate([x / np.maximum(1, x.sum(1, keepdims=True)) for x in hist], axis=1)
                for k in set(lang):
                    use = ok & (lang == k)
                    part = total.setdefault(k, [0, np.zeros(hist.shape[1])])
                    part[0] += int(use.sum())
                    part[1] += hist[use].sum(0)
            keys = list(total)
            cols = [pa.array(keys, pa.string()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1] for k in keys], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "n", "total"])

        width = CLASSES + len(WORDS) + 1
        sums = rows.mapInArrow(near, "lang string, n long, total array<double>")
        sums = sums.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]).collect()
        refs = {}
        for r in sums:
            if r["n"]:
                mean = np.array([r[f"t{i}"] for i in range(width)]) / r["n"]
                refs[r["lang"]] = (mean[:CLASSES], mean[CLASSES:])
    return refs


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, tag, the five counts, base_failed, js_chars, js_words, kept.

    Null and empty texts have no words and fail. Unknown and null languages are held against the nearest reference.
    Without a document that passes the counts there are no references, and distances are 0. `refs` takes the references
    from elsewhere instead. Repeated rows are judged alike. An empty table gives no rows; other columns are ignored.
    """
    table = features(docs, id_col, text_col, lang_col)
    refs = references(table) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, w = _scores(batch, refs)
            names = batch.schema.names
            failed = np.array(batch.column(names.index("base_failed")).to_pylist(), bool)
            n = batch.column(names.index("n_words")).to_numpy()
            kept = ~failed & ((n < GUARD) | _near(c, w, n))
            cols = [batch.column(names.index(n)) for n in out_names[:-3]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(c), pa.array(w), pa.array(kept)], out_names)

    out_names = ["doc_id", "tag", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]
    kind = docs.schema[id_col].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, tag long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, js_chars double, js_words double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag")
