"""What a task of the vector operator holds beside its input."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fleetlens.llm import hnsw_dedup as H


def test_a_shard_is_scaled_in_place():
    raw = np.random.default_rng(3).standard_normal((40_000, 64)) * np.array([[1e-200], [1.0], [1e200], [7.0]]).repeat(10_000, axis=0)
    column = pa.FixedSizeListArray.from_arrays(pa.array(raw.ravel()), 64)
    tracemalloc.start()
    out = H._matrix(column, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * raw.nbytes
    whole = raw / np.abs(raw).max(axis=1, keepdims=True)
    assert np.array_equal(out, whole / np.sqrt((whole * whole).sum(axis=1, keepdims=True)))


def test_a_block_reads_the_shard_without_copies(monkeypatch):
    n, dim = 30_000, 64
    raw = np.random.default_rng(5).standard_normal((n, dim))
    blobs = [np.arange(n).tobytes(), np.ones(n, np.int64).tobytes(), raw.tobytes(), H.Graph(None, [np.zeros((n, 24), np.int32)]).pack()]
    right = pa.table({"dim": [dim], "shard": [0], **{c: pa.array([b], pa.binary()) for c, b in zip(["ids", "weights", "vectors", "layers"], blobs, strict=True)}})
    left = pa.table({"id": [0, 1], "weight": [1, 1], "vector": pa.array(list(raw[:2])), "home": [0, 0]})
    monkeypatch.setattr(H, "find", lambda graph, shard, queries, own, ids, weights, least: (H.Links(own, ids, weights), 0, 1.0))
    tracemalloc.start()
    H._query(0.9)((pa.scalar(dim), pa.scalar(0)), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * raw.nbytes


def _vertices(n, dim, scale=1.0):
    raw = np.random.default_rng(9).standard_normal((n, dim)).astype(np.float32).astype(np.float64) * scale
    chunks = [pa.table({"dim": [dim] * len(x), "shard": [3] * len(x), "id": np.argsort(x[:, 0]) + 10_000 * k, "weight": [1] * len(x), "vector": pa.array(list(x))}) for k, x in enumerate(np.array_split(raw, 4))]
    return raw, pa.concat_tables(chunks)


def test_a_shard_travels_in_pieces(monkeypatch):
    for scale in (1.0, 0.1):  # the first fits single precision
        raw, table = _vertices(3_000, 16, scale)
        monkeypatch.setattr(H, "PIECE_BYTES", 8 * 16 * 700)
        right = H._build((pa.scalar(16), pa.scalar(3)), table)
        assert right.num_rows == 5 and {len(x.as_py()) for x in right["vectors"]} == {(4 if scale == 1 else 8) * 16 * n for n in (700, 200)}
        got = {}
        monkeypatch.setattr(H, "find", lambda graph, shard, queries, own, ids, weights, least: got.update(graph=graph, shard=shard, ids=ids) or (H.Links(own, ids, weights), 0, 1.0))
        left = table.slice(0, 5).append_column("home", pa.array([3] * 5, pa.int32()))
        H._query(0.9)((pa.scalar(16), pa.scalar(3)), left, right.take([4, 0, 2, 1, 3]))
        at = np.argsort(table["id"].to_numpy())
        by_id = dict(zip(table["id"].to_numpy()[at].tolist(), raw[at], strict=True))
        want = H._scaled(np.array([by_id[i] for i in got["ids"].tolist()]))
        assert np.array_equal(got["shard"][np.arange(3_000)], want) and np.array_equal(got["shard"][100:900], want[100:900])
        assert np.array_equal(got["graph"].vectors, want.astype(np.float32))
        assert (got["graph"].search(want[:200].astype(np.float32), 32)[0][:, 0] == np.arange(200)).mean() > 0.99


def test_building_a_shard_holds_few_copies(monkeypatch):
    raw, table = _vertices(40_000, 64)
    monkeypatch.setattr(H.Graph, "build", staticmethod(lambda vectors, heights: H.Graph(vectors, [np.zeros((len(vectors), 24), np.int32)])))
    before = pa.total_allocated_bytes()
    pa.default_memory_pool()
    tracemalloc.start()
    out = H._build((pa.scalar(64), pa.scalar(3)), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * raw.nbytes and pa.total_allocated_bytes() - before < raw.nbytes and max(len(x.as_py()) for x in out["vectors"]) <= H.PIECE_BYTES
