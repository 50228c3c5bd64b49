"""The audit of the graph search, and what dense scans hold."""

import tracemalloc

import numpy as np
import pytest

from fleetlens.llm import hnsw_dedup


def unit(rows, dim, seed):
    v = np.random.default_rng(seed).standard_normal((rows, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Blind(hnsw_dedup.Graph):
    """Finds a vector itself and nothing else until the beam is wide."""

    def search(self, queries, beam):
        near = queries @ self.vectors.T
        if beam < 512:
            near[near < 0.9999] = -1
        at = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        return at, np.take_along_axis(near, at, axis=1)


@pytest.mark.parametrize(("step", "offset"), [(1, 0), (2, 1), (100, 7), (50, 0)])
def test_audit_sees_a_graph_that_finds_only_the_vector_itself(step, offset):
    centres = unit(1000, 16, 1)
    shard = np.concatenate([centres, centres + unit(1000, 16, 2) * 0.1])
    shard /= np.linalg.norm(shard, axis=1, keepdims=True)
    ids = np.arange(len(shard)) * step + offset
    found, _, _ = hnsw_dedup.find(Blind(shard.astype(np.float32), []), shard, shard, ids, ids, np.ones(len(ids), np.int64), 0.9)
    near = shard @ shard.T >= 0.9
    np.fill_diagonal(near, False)
    assert found.n.sum() >= 0.99 * near.sum() > 1900


def test_dense_scan_counts_all_and_holds_few():
    shard = unit(1, 8, 3) + unit(6000, 8, 4) * 0.05
    shard /= np.linalg.norm(shard, axis=1, keepdims=True)
    ids = np.arange(len(shard)) * 3 + 1
    graph = hnsw_dedup.Graph.build(shard.astype(np.float32), np.sort(hnsw_dedup.Graph.heights(len(ids), 1))[::-1])
    tracemalloc.start()
    found, _, _ = hnsw_dedup.find(graph, shard, shard, ids, ids, np.full(len(ids), 2), 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = shard @ shard.T >= 0.9
    assert found.n.tolist() == (2 * (near.sum(axis=1) - 1)).tolist()
    a, b = found.forest()
    assert len(a) == len(ids) - 1
    assert set(b.tolist()) == {1}
    assert near.sum() * 16 > 500_000_000 > peak


def test_beam_links_count_at_both_ends(spark):
    rows = [
        (1, 2, 0, 3), (2, 1, 1, 1),  # found by the beam of 1 alone
        (4, 5, 0, 1), (5, 4, 1, 1), (5, 4, 1, 1), (4, 5, 0, 1),  # found by both beams
        (6, None, 1, 40), (7, 6, 1, 1), (6, 7, 1, 1),  # 6 met all of shard 1, and the beam of 7 found 6
        (6, 8, 0, 2), (1, 2, None, None), (9, 6, None, None),  # 6 has a beam's link with shard 0; edges of forests count nothing
    ]
    got = {r["id"]: r["n"] for r in hnsw_dedup.link_counts(spark.createDataFrame(rows, hnsw_dedup.LINKS)).collect()}
    assert got == {1: 3, 2: 1, 4: 1, 5: 1, 6: 42, 7: 1}


def test_links_have_two_ends(spark):
    """No link but those of scanned vectors: the sum of links is that of pairs, each of which has two ends."""
    centres = unit(700, 12, 5)
    vectors = np.concatenate([centres, centres + unit(700, 12, 6) * 0.4, centres[:350] + unit(350, 12, 7) * 0.2])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw_dedup.near_duplicates(table, shard_rows=400, query_rows=500).collect()}
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    assert 0.99 * near.sum() <= sum(got.values()) <= near.sum()
    assert sum(got.values()) % 2 == 0
    assert all(got[i] <= near[i].sum() for i in got)
