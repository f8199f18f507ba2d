"""Fingerprints meet their anchors without a broadcast."""

from shelfcast.llm import simhash


def test_links_broadcast_no_side(spark):
    """There are 77.5 visits a fingerprint, which Spark takes for one."""
    frame = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 62),) for i in range(50)], "fp long")
    found = simhash.links(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan
    assert "Broadcast" not in plan
