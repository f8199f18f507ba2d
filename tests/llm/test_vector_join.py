"""Query blocks meet trees by shard."""

import re

import numpy as np

from shelfcast.llm import vptree


def test_blocks_join_trees_on_the_shard(spark):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(200, 4))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    index = vptree.build_index(frame, "vec_id", "embedding", shard_rows=20)
    found = vptree.search(index, frame, "vec_id", "embedding", k=3, block=50)
    join = re.search(r"Join Inner, .*", found._jdf.queryExecution().optimizedPlan().toString())[0]
    assert "dim#" in join and "shard#" in join
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i, p in enumerate(points):
        d = ((points - p) ** 2).sum(axis=1)
        d[i] = np.inf
        assert got[i] == np.argsort(d)[:3].tolist()
