"""A tree answers the queries of a block together."""

import numpy as np
import pytest

from shelfcast.llm import vptree


def plain(ids, vectors, copies, query, own, k):
    """The k nearest by squares summed one after the other, without one row of the query's own."""
    out, left = [], True
    for i, v, times in zip(ids.tolist(), vectors.astype(float), copies.tolist()):
        d = float(np.sqrt(sum((v - query) ** 2)))
        if left and i == own and d == 0:
            times, left = times - 1, False
        out += [(d, i)] * times
    return sorted(out)[:k]


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_a_block_finds_what_each_query_would(far):
    """Ties, copies, repeated ids, and vectors far from zero, whose distances a matrix product rounds away."""
    draw = np.random.default_rng(8)
    vectors = np.unique(draw.integers(-3, 4, (1500, 3)), axis=0) / 8 + far
    vectors = np.concatenate([vectors, draw.normal(size=(400, 3)) + far, np.full((200, 3), far + 1)])
    ids = np.concatenate([draw.integers(0, 300, len(vectors) - 200), np.arange(1000, 1200)])
    copies = np.concatenate([draw.integers(1, 4, len(vectors) - 200), np.ones(200, dtype=np.int64)])
    tree = vptree.Tree(ids, vectors, leaf=40, copies=copies)
    asked = np.append(draw.permutation(len(vectors))[:80], len(vectors) - 1)
    row, d, found = tree.search(vectors[asked], ids[asked], 10, 1.0)
    for i, at in enumerate(asked):
        want = plain(ids, vectors, copies, vectors[at], ids[at], 10)
        assert list(zip(d[row == i].tolist(), found[row == i].tolist())) == want


def test_a_tree_of_fewer_than_k():
    vectors = np.arange(8.0).reshape(4, 2)
    tree = vptree.Tree(np.arange(4), vectors)
    row, _, found = tree.search(vectors, np.arange(4), 10, 1.0)
    assert np.bincount(row).tolist() == [3, 3, 3, 3] and found[row == 0].tolist() == [1, 2, 3]
