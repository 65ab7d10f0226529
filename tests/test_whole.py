"""Graphs that are worked on whole in tasks are those of the way with a row for each node."""

import random

import pytest

from loomseq import catalog
from loomseq.operators import whole

QUERIES = ("rev_determinism", "path_doubling", "run_collapse_hom", "positional_outdeg", "flag_ranks", "graph_lf", "doubling_curve")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    d = tmp_path_factory.mktemp("turns")
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (12, 70, 260)] + ["ab" * 60, "a" * 130, "short", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_whole_graphs_equal_long_ones(spark, folder, name, monkeypatch):
    run = lambda: sorted(map(tuple, catalog.queries()[name](spark, folder).collect()), key=str)
    want = run()
    # texts of more than 100 letters take the way of long ones
    monkeypatch.setattr(whole, "LONG", 100)
    assert want and run() == want


def test_only_texts_are_shuffled(spark, folder):
    for name in QUERIES[:-1]:
        plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, name


def test_one_graph_after_the_other(spark, folder):
    """The same rows however many graphs are worked on together."""
    from pyspark.sql import functions as F

    from loomseq.plans import sequence

    s = sequence._whole(sequence._texts(spark, folder))
    of = lambda together: sorted(map(tuple, whole.each(s, "key", sequence._flags, "row long, label string, f boolean, m boolean", together=together).collect()))
    assert of(1) == of(1 << 18) and s.agg(F.count("*")).first()[0] == 5
