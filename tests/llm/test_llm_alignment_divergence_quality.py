"""Token alignment, source divergence and the quality classifier, against plain versions and on awkward rows."""

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomseq.llm import align, bpe, divergence, pulearn

D = "/root/testdata/sf0.001"
BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
#: Nulls, empty and blank texts, repeats, equal ids, one very long text, other scripts, special tokens, pieces' own marks.
ODD = [
    (1, "one two three"), (2, None), (3, ""), (4, " \n\t "), (5, "one two three"), (5, "one two three"), (6, "  two  spaces  "), (7, "a▁b"), (8, "<s> <0x41> </s>\x00 <unk>"),
    (9, "日本語 テスト １２ ²½ é́ ﬁ"), (10, "<|endoftext|>it's <|endoftext|>"), (11, "aaa" * 3000), (12, "lorem ipsum " * 20000), (None, "no id here"), (None, None), (13, "A" * 700 + "🙂" * 300),
]
SCHEMA = "doc_id long, text string, lang string, source string, block string, row string, pairs string, number string, groups string, n string, v string, term string, base string, positive string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    langs, sources = ["en", None, "en", "fr"], ["a", "b", None]
    return spark.createDataFrame([(i, t, langs[k % 4], sources[k % 3], *["x"] * 11) for k, (i, t) in enumerate(ODD)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def linked(rows):
    """(id, A tokens, B tokens, groups, links, best links, sum of counts, groups as text) of each row, one byte after another."""
    a_model = Tokenizer.from_file(BYTE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    with open(BYTE) as f:
        entries = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    back = {c: b for b, c in bpe.byte_symbols().items()}
    seen, held = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            a = [(x, bytes(back[c] for c in entries[x])) for x in a_model.encode(" " + t, add_special_tokens=False).ids]
            b = [(x, bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode()) for x in b_model.encode(t) for p in [b_model.id_to_piece(x)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                cuts = sorted(ends[0] & ends[1])
                for low, high in zip([0, *cuts], cuts, strict=False):
                    part = []
                    for side in (a, b):
                        at = np.cumsum([len(x) for _, x in side])
                        part.append([side[k][0] for k in np.flatnonzero((at > low) & (at <= high))])
                    groups.append(part)
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        seen.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), links, text))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(i, a, b, g, len(x), sum(held[p] == top[p[0]] for p in x), sum(held[p] for p in x), t) for i, a, b, g, x, t in seen]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_alignment(odd, none):
    rows = [(i, t) for i, t in ODD if i != 12] + [(12, "lorem ipsum " * 300)]
    small = odd.withColumn("text", F.when(F.col("doc_id") == 12, "lorem ipsum " * 300).otherwise(F.col("text")))
    got = align.align(small, BYTE, PIECE).select(*NAMES, "groups").collect()
    assert sorted(map(tuple, got), key=str) == sorted(linked(rows), key=str)
    # the whole of the long text
    assert align.align(odd, BYTE, PIECE).where("doc_id = 12").first()["n_a"] > 40_000
    assert align.align(none, BYTE, PIECE).count() == 0


def test_alignment_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if len(t) < 6000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = align.align(df, BYTE, PIECE, lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))).select(*NAMES, "groups").collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in linked(rows)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_links_in_parts(monkeypatch):
    """Large groups are taken by distinct ids and in parts, with the same links."""
    rng = np.random.default_rng(3)
    one = align.load(BYTE, PIECE)
    n_a, n_b = rng.integers(1, 60, 30), rng.integers(1, 60, 30)
    a, b, doc = rng.integers(0, 40, n_a.sum()), rng.integers(0, 40, n_b.sum()), np.sort(rng.integers(0, 4, 30))

    def all_links():
        out = Counter()
        for d, pair, times in one.links(doc, a, b, n_a, n_b):
            for x, y, n in zip(d.tolist(), pair.tolist(), times.tolist(), strict=True):
                assert (x, y) not in out
                out[x, y] = n
        return out

    whole = all_links()
    monkeypatch.setattr(align, "LINKS", 100)
    assert all_links() == whole
    assert sum(whole.values()) == int((n_a * n_b).sum())


def test_pieces_by_words():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for _, t in ODD if t] + ["", "a b", "end ", " start", "x\ny z"]
    words = align.load(BYTE, PIECE).b
    for _ in range(2):
        ids, at = words.encode_batch(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [model.encode(t) for t in texts]
    assert words.cuts


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]).astype(object))
    con.execute("create table d as select text::varchar as text, lang::varchar as lang, source::varchar as source from documents")
    return con.execute(divergence.SQL.replace("FROM documents", "FROM d")).fetchall()


OUT = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "日本", "ABC", "abc", "x1y"]
    rows = []
    for _ in range(500):
        text = " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(0, 25)))
        rows.append((r.choice([text, text, text, text, None, "", "12 34 -"]), r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "a", "b", "c", None, "ß"])))
    rows += [rows[0]] * 12 + [(None, "xx", "only"), ("rare words", "yy", "a"), (None, "yy", "b"), ("lorem " * 50000, "en", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *[F.lit("x").alias(c) for c in ("n", "docs", "term", "v", "c", "times", "value")]).repartition(5)
    got = divergence.audit(df).select(*OUT).collect()
    assert sorted(map(tuple, got)) == sorted(by_sql(rows))
    assert {r["value"] for r in got if r["lang"] == "yy"} == {0}


def test_divergence_in_small_tallies(spark, odd, none):
    assert divergence.audit(none).count() == 0
    assert divergence.audit(odd).where("part = 'term'").count() == 0
    pairs = {(r["lang"], r["source"], r["item"]) for r in divergence.audit(odd).collect()}
    groups = {(r["lang"] or "", r["source"] or "") for r in odd.collect()}
    assert pairs == {(x, s, t) for x, s in groups for y, t in groups if x == y and s != t}
    assert odd.count() == len(ODD)


def test_shares_are_exact(spark):
    n = 9_000_000_000_000_000_000 // 3
    row = spark.createDataFrame([(n, n + 7, 12)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (n + 7 + 24)


def pu_fit(x, positive, prior, decay, steps=4000):
    """The unbiased risk by plain gradient descent, stopped where the estimated risk of negatives would fall below 0."""
    w = np.zeros(x.shape[1])
    p = x[positive]
    for _ in range(steps):
        grad = x.T @ (1 / (1 + np.exp(-(x @ w)))) / len(x) - prior * p.mean(0) + decay * w
        w = w - 0.2 * grad
    return w


def test_fit_against_descent(monkeypatch):
    rng = np.random.default_rng(1)
    bad = rng.random(1500) < 0.3
    base = np.zeros((1500, pulearn.BASE))
    base[:, :3] = np.clip(rng.normal(0.3, 0.1, (1500, 3)) + 0.25 * bad[:, None], 0, 1)
    positive = ~bad & (rng.random(1500) < 0.3)
    x = pulearn.inputs(base)
    mean, sd = x.mean(0), x.std(0)
    scale = np.r_[0.0, mean[1:]], np.r_[1.0, np.where(sd[1:] > 1e-6, sd[1:], np.inf)]
    monkeypatch.setattr(pulearn, "_sums", lambda table, width, of: of(x[:700], positive[:700]) + of(x[700:], positive[700:]))
    n_p = int(positive.sum())
    w = pulearn.fit(None, 0.7, np.zeros(x.shape[1]), scale, len(x), n_p)
    z = (x - scale[0]) / scale[1]
    decay = np.r_[0.0, np.full(x.shape[1] - 1, pulearn.L2 + pulearn.SCATTER / n_p)]
    want = pu_fit(z, positive, 0.7, decay)
    assert np.abs(z @ w - z @ want).max() < 0.02
    assert pulearn.risk(z @ w, len(x), n_p, 0.7, positive)[1] >= 0


def test_prior_of_mixtures():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.7, 0.9):
        good, bad = rng.normal(2, 1, 200_000), rng.normal(-1, 1, 200_000)
        n = int(200_000 * prior)
        edges = np.linspace(-20, 20, pulearn.BINS + 1)
        u = np.histogram(np.r_[good[:n], bad[: 200_000 - n]], edges)[0]
        p = np.histogram(rng.normal(2, 1, 100_000), edges)[0]
        assert abs(pulearn.estimate_prior(u, p) - prior) < 0.03


@pytest.fixture(scope="module")
def judged(spark):
    rows = [tuple(r) for r in pulearn.query(spark, "/root/testdata/sf0.01").select("doc_id", "held_out", "score", "predicted").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(spark, judged):
    rows, labels = judged
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for i, held, score, predicted in rows:
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1 and predicted == int(score >= 0.5)
    good = [s for i, held, s, _ in rows if held and labels.get(i) == 1]
    bad = [s for i, held, s, _ in rows if held and labels.get(i) == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert wins > 0.97
    assert sum(s >= 0.5 for s in good) > 0.85 * len(good) and sum(s < 0.5 for s in bad) > 0.85 * len(bad)


def test_odd_rows_are_scored(spark, odd, none):
    some = spark.createDataFrame([(1,), (5,), (5,), (None,)], "doc_id long")
    got = [tuple(r) for r in pulearn.classify(odd, some).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    same = {i: {s for j, s, _ in got if j == i} for i in (1, 5)}
    assert same[1] == same[5] and len(same[5]) == 1
    assert {s for _, s, _ in pulearn.classify(odd, some.limit(0)).collect()} == {0.5}
    assert pulearn.classify(none, some).count() == 0


def test_sums_of_many_tasks(spark, monkeypatch):
    """Sums that are added in tasks first are those that the driver adds."""
    rng = np.random.default_rng(5)
    rows = [(rng.random(pulearn.BASE).astype(np.float32).tobytes(), bool(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "base binary, positive boolean").repartition(9)
    of = lambda x, positive: np.concatenate([x.sum(0), x[positive].sum(0)])
    once = pulearn._sums(df, 2 * pulearn.WIDTH, of)
    monkeypatch.setattr(pulearn, "TASKS", 4)
    assert np.allclose(pulearn._sums(df, 2 * pulearn.WIDTH, of), once)


def test_descriptions():
    got = pulearn.describe("Ab ab ab\nAb ab ab\nX1 |!")
    n = pulearn.CLASSES * pulearn.CLASSES
    assert abs(got[:n].sum() - 22 / 23) < 1e-6
    # words: 4 of 8 differ, 3 equal the one before... of 7 pairs 5 differ; two lines of three differ
    words = ["Ab", "ab", "ab", "Ab", "ab", "ab", "X1", "|!"]
    assert got[n] == np.float32(len(set(words)) / 8) and got[n + 1] == np.float32(2 / 8)
    assert abs(got[n + 2] - (1 - len(set(zip(words, words[1:], strict=False))) / 7)) < 1e-6
    assert got[n + 3] == np.float32(1 / 8) and abs(got[n + 4] - 1 / 3) < 1e-6
    assert not pulearn.describe(None).any() and not pulearn.describe(" \n ").any()
