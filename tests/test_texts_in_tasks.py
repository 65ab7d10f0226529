"""Queries whose texts are worked on where they are read: no row for each letter is shuffled, and nothing written."""

import pytest

from loomseq import catalog

D = "/root/testdata/sf0.001"


def shuffles(spark, name):
    return catalog.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["suffix_rank", "bwt_inverse", "pattern_positions", "kmer_trie"])
def test_no_letters_are_shuffled(spark, name, monkeypatch):
    from loomseq.operators import index, suffix_rows
    from loomseq.plans import sequence

    def written(*_, **__):
        raise AssertionError("a table was written")

    for module in (index, suffix_rows, sequence):
        monkeypatch.setattr(module, "spool", written)
    # texts of turns are dealt out by key
    assert shuffles(spark, name) == (1 if name in ("bwt_inverse", "pattern_positions") else 0)


@pytest.mark.parametrize("name", ["bwt_inverse", "pattern_positions", "kmer_trie"])
def test_short_texts_equal_long_ones(spark, tmp_path, name, monkeypatch):
    from loomseq.operators import index

    texts = ["abcab cabd", "", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "the same word and the same word again", None, "x"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
    want = run()
    monkeypatch.setattr(index, "LONG", 20)
    monkeypatch.setattr(index.text_trie, "__defaults__", (*index.text_trie.__defaults__[:-1], 20))
    assert want and run() == want
