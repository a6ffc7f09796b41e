"""What the near-duplicate stage asks of the driver."""
from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from sourceloom.llm import simhash
from sourceloom.llm.common import store


def test_variants_are_not_broadcast(spark):
    """a table of fingerprints is small, its 64 variants each are not; no join of them is built on the driver."""
    nodes = store(spark.range(2000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("least")))
    crowd = store(spark.range(600).select((F.lit(7) * (1 << 32) + F.col("id") * 1027).alias("fp"), F.col("id").alias("least")))
    for table in (nodes, crowd):
        links = simhash.near_links(table)
        plan = links._jdf.queryExecution().executedPlan().toString()
        met = [line for line in plan.splitlines() if "Join" in line and "key_b" in line]
        assert met and all("SortMergeJoin" in line for line in met)
    pairs = {(r.a, r.b) for r in simhash.near_links(crowd).collect()}
    fps = sorted(r.fp for r in crowd.collect())
    assert pairs == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_the_stage_of_the_pipeline_sorts_them_too(spark, make_docs, monkeypatch):
    """the links that the near-duplicate stage asks for."""
    plans = []

    def seen(links, run=simhash.components):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return run(links)

    monkeypatch.setattr(simhash, "components", seen)
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(["a b c d", "a b c d", "quite another text"]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    met = [line for plan in plans for line in plan.splitlines() if "Join" in line and "key_b" in line]
    assert met and all("SortMergeJoin" in line for line in met)
