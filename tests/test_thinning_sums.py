"""Windows whose choices cost a sum are decided many at a time, as each is alone."""

import random

from loomseq import catalog
from loomseq.operators import thinning


def alone(rows, budget):
    """Rows (i, cost) in order: those kept; a choice of unknown costs alone ends the search."""
    total = lambda k: (lambda c: sum(c) if c else None)([rows[i][1] for i in thinning.evenly(len(rows), k) if rows[i][1] is not None])
    if (t := total(len(rows))) is not None and t <= budget:
        return rows
    low, high = 0, len(rows)
    while high > low + 1 and (t := total((low + high) // 2)) is not None:
        low, high = ((low + high) // 2, high) if t <= budget else (low, (low + high) // 2)
    return [rows[i] for i in thinning.evenly(len(rows), low)]


def test_sums_equal_windows_alone(spark):
    r = random.Random(4)
    sizes = {(c, w): r.choice([1, 2, 3, 30, 31, 90]) for c in ("x", "y", None) for w in [*range(40), None]}
    rows = [(c, w, i, r.choice([None, 1, 1, 2, 5, 40]) if w != 7 else None) for (c, w), n in sizes.items() for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, w long, i long, len long")
    whole = {s: sorted((i, n) for c, w, i, n in rows if (c, w) == s) for s in sizes}
    want = {s: alone(x, 30) if None not in s else [] for s, x in whole.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (before, 7):  # windows that batches cut
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = thinning.thin_sums(df, ["c", "w"], ["i"], "len", 30).select("c", "w", "i", "len").collect()
            assert sorted(map(tuple, got)) == sorted((*s, i, n) for s, x in want.items() for i, n in x)
            cost = lambda x: sum(n for _, n in x if n is not None) if any(n is not None for _, n in x) else None
            got = thinning.fitting(df, ["c", "w"], ["i"], "len", 30).collect()
            assert sorted(map(tuple, got), key=str) == sorted(((*s, len(x), cost(x), len(want[s])) for s, x in whole.items()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_call_for_each_window(spark):
    for name in ("thinning_retention", "window_thinning"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
