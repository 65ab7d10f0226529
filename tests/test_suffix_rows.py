"""Suffix order by rows, inversion and search, against whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.operators import graph, index, suffix_rows
from loomseq.session import spool

R = random.Random(12)
TEXTS = [(1, ""), (2, "A"), (3, "ACGT" * 60), (4, "A" * 150), (5, "".join(R.choice("ACGNT") for _ in range(900))), (6, None), (7, "GATTACA" * 2 + "".join(R.choice("AC") for _ in range(200)) * 2)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc long, t string").repartition(3)


@pytest.mark.parametrize("end", ["$", "~"])
def test_rows_equal_numpy(texts, end):
    want = []
    for k, t in TEXTS:
        if t is not None:
            order = index.suffix_order(np.frombuffer((t + end).encode("utf-32-le"), "<u4"))
            want += [(k, r, int(p), (t + end)[p - 1]) for r, p in enumerate(order)]
    for letters, parts, tile in (("ACGNT", 7, 64), (None, 3, 1000)):
        got = suffix_rows.ordered(texts, "doc", "t", end, letters, parts, tile)
        assert sorted(map(tuple, got.select("doc", "row", "pos", "bwt").collect())) == sorted(want)
    assert sorted(map(tuple, index.suffixes(texts, "doc", "t", end, 300).select("doc", "row", "pos", "bwt").collect())) == sorted(want)


def test_letters_beyond_ascii(spark):
    df = spark.createDataFrame([("a", "日本語日本" * 20), ("é", "zażółć")], "doc string, t string")
    got = sorted(map(tuple, suffix_rows.ordered(df, "doc", "t", "$", None, 2, 16).select("doc", "row", "pos").collect()))
    assert got == sorted(map(tuple, index.suffixes(df, "doc", "t", "$").select("doc", "row", "pos").collect()))


def test_inverse_gives_positions(texts):
    rows = spool(index.bwt(texts, "doc", "t"), "bwt")
    got = index.inverse(rows.select("doc", "row", "bwt"), "doc")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("doc", "row", "pos").collect()))


def test_search_finds_every_place(spark, texts):
    words = sorted({(k, t[i : i + n]) for k, t in TEXTS if t for i in range(0, len(t), max(1, len(t) // 12)) for n in (1, 3, 8, 40)} | {(5, "ACGTACGTACGTT"), (3, "GG"), (9, "A")})
    rows = spool(index.suffixes(texts, "doc", "t", "~"), "rows")
    lookup = index.search(rows, "doc", "ACGNT")
    found = graph.spelled(spark.createDataFrame(words, "doc long, word string"), lookup, "doc")
    got = sorted(map(tuple, index.located(found, lookup, rows.where(F.col("pos") % 16 == 0), "doc").select("doc", "word", "pos").collect()))
    of = dict(TEXTS)
    want = sorted((k, w, p) for k, w in words for p in range(len(of.get(k, ""))) if of[k].startswith(w, p))
    assert got == want
