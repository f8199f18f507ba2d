"""The passes of a boosted fit: what is summed, and in which form rows are kept."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfcast.operators import boosting


def test_cell_sums_are_those_of_plain_loops():
    draw = np.random.default_rng(4)
    for features in (1, 4, 5):
        columns = draw.integers(0, 7, (features, 300), dtype=np.uint8)
        slot, g = draw.integers(0, 3, 300), draw.integers(-9, 9, 300).astype(float)
        found = boosting.cell_sums(columns, slot, (g, None), 3, 7)
        want = np.zeros((2, 3, features, 7), dtype=np.int64)
        for row in range(300):
            for f in range(features):
                want[0, slot[row], f, columns[f, row]] += int(g[row])
                want[1, slot[row], f, columns[f, row]] += 1
        assert (found == want).all()


def test_blocks_give_the_rows_back():
    model = boosting.BoostedCounts(["a", "b", "c"], [np.arange(3.0)] * 3, 1.0, 2.0)
    n = boosting.BLOCK + 7
    columns = np.arange(3 * n, dtype=np.uint8).reshape(n, 3), np.arange(n) / 2, np.arange(n) % 2 == 0, np.arange(n), np.arange(n) / 3
    batches = list(boosting._batches(*columns))
    assert [b.num_rows for b in batches] == [1, 1]
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
    parts = list(zip(*boosting._blocks(iter(whole), model)))
    assert all((np.concatenate(x) == y).all() for x, y in zip(parts, columns))


def test_leaves_of_a_tree_follow_its_splits():
    tree = boosting.Tree(feature=[0, -1, 1, -1, -1], threshold=[2, 0, 1, 0, 0], missing_left=[False, True, True, True, True],
                         left=[1, -1, 3, -1, -1], right=[2, -1, 4, -1, -1], value=[0.0] * 5)
    columns = np.array([[0, 1, 2, 3, 3, 0], [2, 2, 2, 0, 2, 1]], dtype=np.uint8)
    assert tree.nodes(columns).tolist() == [4, 1, 1, 3, 4, 3]


def test_of_two_siblings_one_is_summed(spark, monkeypatch):
    asked, plain = [], boosting._Data.sums

    def counted(self, trees, tree, nodes, use, *rest):
        asked.append((len(nodes), len(use)))
        return plain(self, trees, tree, nodes, use, *rest)

    monkeypatch.setattr(boosting._Data, "sums", counted)
    rows = spark.range(4000).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).alias(f"f{i}") for i in range(5)])
    rows = rows.withColumn("y", F.col("f0") % 4 + F.col("f1") % 3)
    boosting.fit_boosted_counts(rows.filter("id < 3000"), rows.filter("id >= 3000"), [f"f{i}" for i in range(5)], "y", max_iter=1, max_depth=3)
    assert [n for n, _ in asked[:3]] == [1, 1, 2]
    assert {use for _, use in asked[:3]} == {4}
