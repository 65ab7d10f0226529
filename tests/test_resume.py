"""A build that breaks off at every boundary in turn and is resumed, against one that is left alone."""

import pytest
from pyspark.sql import functions as F

from loomseq import session
from loomseq.operators import graph


class Broken(Exception):
    pass


def test_resumed_at_each_boundary(spark, tmp_path):
    df = spark.createDataFrame([("c", "ACGTTGCAAC"), ("d", "GATTACA")], "chrom string, seq string")
    build = lambda: graph.backbone(df, "chrom", "seq")
    run = lambda root: [sorted(map(tuple, x.collect()), key=str) for x in graph.indexed(build, "chrom", str(tmp_path / root), ("v1",), str(tmp_path / f"{root}-curve"))]
    passed: list[str] = []
    session.on_boundary.append(passed.append)
    want = run("alone")
    session.on_boundary.clear()
    assert len(set(passed)) == len(passed) and {"nodes:begin", "paths4:written", "generation4:counted", "generation4:published", "rows:end"} <= set(passed)
    broken: set[str] = set()

    def breaks(name):
        if name not in broken:
            broken.add(name)
            raise Broken(name)

    session.on_boundary.append(breaks)
    try:
        for _ in range(len(passed)):
            with pytest.raises(Broken):
                run("broken")
        assert run("broken") == want
    finally:
        session.on_boundary.clear()
    assert set(passed) <= broken
    curve = [tuple(r) for r in spark.read.parquet(str(tmp_path / "broken-curve")).orderBy("gen").collect()]
    assert curve == [tuple(r) for r in spark.read.parquet(str(tmp_path / "alone-curve")).orderBy("gen").collect()]
    stages = [r["stage"] for r in session.finished(spark, str(tmp_path / "broken")).collect()]
    assert stages[:2] == ["nodes", "edges"] and stages[-2:] == ["rows", "index_nodes"]


def test_other_inputs_or_code_build_anew(spark, tmp_path, monkeypatch):
    built = []

    def build():
        built.append(1)
        return spark.range(3).select(F.col("id"))

    for inputs, times in ((["a"], 1), (["a"], 1), (["b"], 2)):
        assert session.stage(spark, str(tmp_path), "s", inputs, build).count() == 3 and len(built) == times
    monkeypatch.setattr(session, "code_digest", lambda: "other")
    session.stage(spark, str(tmp_path), "s", ["a"], build)
    assert len(built) == 3
