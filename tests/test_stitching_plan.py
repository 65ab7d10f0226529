"""No table of a row a fragment goes through the driver where graphs are stitched."""

from loomseq.operators import fragments, graph
from loomseq.session import spool


def test_nothing_is_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spool(df, name)

    for module in (fragments, graph):
        monkeypatch.setattr(module, "spool", kept)
    df = spark.createDataFrame([("c", "ACGTTGCAACGGTTAC" * 3)], "chrom string, seq string")
    h = spark.createDataFrame([("c", "h1", 4, 4, [("single", 4, 1, "G")])], "chrom string, hap string, left long, right long, variants array<struct<typ:string,pos:bigint,len:bigint,seq:string>>")
    cuts = spark.createDataFrame([("c", 0, 20), ("c", 20, 48)], "chrom string, start long, stop long")
    nodes, edges = fragments.build(df, h, cuts, "chrom", "seq", 20)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (nodes, edges)]
    assert nodes.count() and edges.count()
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
