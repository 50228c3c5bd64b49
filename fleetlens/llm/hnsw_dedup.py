"""Near-duplicate embeddings through hierarchical navigable small-world graphs, one per shard.

Equal vectors are one vertex. Vertices are dealt over shards by a hash of their id; each shard builds a graph of its vectors. Blocks of vertices then
query every shard: a beam search from the top layer down, many queries in step. A query whose beam holds nothing but links gets an exact scan of the
shard, as a graph beam cannot say how far the links go. In each block some queries, chosen by a hash of the id, are also answered by brute force; while the audit's
recall (matches with themselves do not count) is under RECALL, the beam is doubled (a beam as wide as the shard is an exact scan). What the beam finds is verified by cosine in
double precision. Tasks return a spanning forest of the links, of each scanned query the number of its links, and of the others their few links (less than a beam); they neither
return nor hold all pairs. On Spark, a link that one beam finds is given to its other end too, unless that end was scanned, and components are joined.

A task holds one shard (SHARD_ROWS vectors at most, on average) and one block of queries; a shard travels in pieces, so that only the Python worker that searches it holds it whole. As every shard is queried, the work grows with rows x shards; up to
MIN_SHARDS x SHARD_ROWS vectors the number of shards stays as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import salted_join, stored
from fleetlens.llm.components import components, forest

LEAST_COSINE = 0.9
MIN_SHARDS = 6
SHARD_ROWS = 200_000
QUERY_ROWS = 16_384
NEIGHBOURS = 12
BUILD_BEAM = 40
BEAM = 32
RECALL = 0.99
#: Audited are one query of so many, but so many at least, and as many as it takes to have so many links.
AUDIT_EVERY = 50
AUDIT_ROWS = 300
LEAST_TRUTH = 100
#: Queries in step; candidates that each expands at a time.
STEP_ROWS = 256
EXPAND = 4
#: Vectors of a shard that a scan compares at a time, and links that are held before they are folded into a forest.
STEP_SHARD = 2_048
HELD_PAIRS = 500_000
#: A shard is stored, shuffled and handed to tasks in rows of so many bytes of vectors, and so many of them in a file: nothing on the way holds a shard as one value.
PIECE_BYTES = 1 << 20
FILE_PIECES = 32


class Graph:
    """Layers of one shard, top layer last. Layer k links the first len(layer) vectors; the order is by falling random height."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def heights(n: int, seed: int) -> np.ndarray:
        return np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(NEIGHBOURS)).astype(np.int64)

    @staticmethod
    def build(vectors: np.ndarray, heights: np.ndarray) -> Graph:
        """vectors: float32, of length 1, in the order of falling height."""
        graph = Graph(vectors, [])
        counts = [int((heights >= k).sum()) for k in range(int(heights[0]) + 1)] if len(heights) else []
        for k, n in reversed(list(enumerate(counts))):
            graph.layers.insert(0, np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32))
            start = 0
            while start < n:
                end = min(n, start + min(512, max(8, start // 4)))
                graph._insert(start, end)
                start = end
        return graph

    def _insert(self, start: int, end: int) -> None:
        """Link vectors start..end on the lowest layer, which so far has those before start."""
        own, layer = self.vectors[start:end], self.layers[0]
        near = own @ own.T
        np.fill_diagonal(near, -np.inf)
        few = min(NEIGHBOURS, end - start)
        at = np.argpartition(-near, few - 1, axis=1)[:, :few]
        ids, sims = at + start, np.take_along_axis(near, at, axis=1)
        if start:
            found, their = self._search(own, BUILD_BEAM, start)
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([their, sims], axis=1)
        width = layer.shape[1]
        chosen = self._spread(own, ids, sims, NEIGHBOURS)
        layer[start:end, :NEIGHBOURS] = chosen
        # links back; a full list is thinned by the same rule
        src, dst = np.repeat(np.arange(start, end), NEIGHBOURS), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(src):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.vectors[src], self.vectors[dst]), dst))
        src, dst = src[order], dst[order]
        targets, first, many = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, many)
        back = np.full((len(targets), min(int(many.max()), 2 * width)), -1, np.int32)
        kept = place < back.shape[1]
        back[np.repeat(np.arange(len(targets)), many)[kept], place[kept]] = src[kept]
        back[(back[:, :, None] == layer[targets][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([layer[targets], back], axis=1)
        sims = np.einsum("tkd,td->tk", self.vectors[both], self.vectors[targets])
        sims[both < 0] = -np.inf
        over = (both >= 0).sum(axis=1) > width
        by = np.argsort(-sims, axis=1, kind="stable")
        out = np.take_along_axis(both, by, axis=1)[:, :width]
        if over.any():
            out[over] = self._spread(self.vectors[targets[over]], both[over], sims[over], width)
        layer[targets] = out

    def _spread(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, many: int) -> np.ndarray:
        """Neighbours that are nearer to the vector than to any neighbour chosen before, then the nearest of the others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * many]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        rows, width = ids.shape
        vectors = self.vectors[ids]
        picked = np.zeros((rows, width), bool)
        between = np.einsum("rid,rjd->rij", vectors, vectors)
        for k in range(width):
            rival = np.where(picked, between[:, k, :], -np.inf).max(axis=1)
            picked[:, k] = (sims[:, k] > rival) & (picked.sum(axis=1) < many) & np.isfinite(sims[:, k])
        rank = np.argsort(np.where(np.isfinite(sims), ~picked * 1, 2), axis=1, kind="stable")[:, :many]
        out = np.full((rows, many), -1, np.int32)
        found = np.take_along_axis(ids, rank, axis=1)
        found[~np.isfinite(np.take_along_axis(sims, rank, axis=1))] = -1
        out[:, : found.shape[1]] = found
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query on the lowest layer: vectors and similarities, best first, -1 where there is none."""
        parts = [self._search(queries[k : k + STEP_ROWS], beam, len(self.vectors)) for k in range(0, len(queries), STEP_ROWS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _search(self, queries: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            if len(self.layers[k]) and len(self.layers[k]) <= known:
                entry = self._beam(queries, entry, EXPAND, self.layers[k], len(self.layers[k]))[0]
                entry = np.where(entry < 0, entry[:, :1], entry)
        return self._beam(queries, entry, beam, self.layers[0], known)

    def _beam(self, queries, entry, beam, layer, known):
        rows = len(queries)
        every = np.arange(rows)[:, None]
        seen = np.zeros((rows, known), bool)
        ids, sims, done = np.full((rows, beam), -1, np.int64), np.full((rows, beam), -np.inf, np.float32), np.ones((rows, beam), bool)

        def merge(at, new):
            """Take new vectors into the beams of rows `at`."""
            new = np.sort(new, axis=1)
            bad = new < 0
            bad[:, 1:] |= new[:, 1:] == new[:, :-1]
            bad |= seen[at[:, None], np.maximum(new, 0)]
            seen[np.broadcast_to(at[:, None], new.shape)[~bad], new[~bad]] = True
            near = np.einsum("rkd,rd->rk", self.vectors[np.maximum(new, 0)], queries[at])
            near[bad] = -np.inf
            all_ids, all_sims = np.concatenate([ids[at], new], axis=1), np.concatenate([sims[at], near], axis=1)
            all_done = np.concatenate([done[at], bad], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[at], sims[at], done[at] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_done))

        merge(np.arange(rows), entry)
        while len(at := np.flatnonzero(~done.all(axis=1))):
            open_sims = np.where(done[at], -np.inf, sims[at])
            pick = np.argsort(-open_sims, axis=1, kind="stable")[:, :EXPAND]
            wanted = np.isfinite(np.take_along_axis(open_sims, pick, axis=1))
            done[at[:, None], pick] |= wanted
            chosen = np.where(wanted, ids[at[:, None], pick], -1)
            new = np.where(chosen[:, :, None] >= 0, layer[np.maximum(chosen, 0)], -1).reshape(len(at), -1).astype(np.int64)
            new[new >= known] = -1
            merge(at, new)
        return np.where(np.isfinite(sims), ids, -1), sims

    def pack(self) -> bytes:
        return b"".join([np.array([len(self.layers)], "<i4").tobytes(), *[np.array([len(x)], "<i4").tobytes() + x.astype("<i4").tobytes() for x in self.layers]])

    @staticmethod
    def unpack(blob: bytes, vectors: np.ndarray) -> Graph:
        n, at, layers = int(np.frombuffer(blob, "<i4", 1)[0]), 4, []
        for k in range(n):
            rows, width = int(np.frombuffer(blob, "<i4", 1, at)[0]), NEIGHBOURS * (2 if k == 0 else 1)
            layers.append(np.frombuffer(blob, "<i4", rows * width, at + 4).reshape(rows, width))
            at += 4 + 4 * rows * width
        return Graph(vectors, layers)


class Rows:
    """Vectors that lie in pieces, as they came. What is asked for (a slice or an array of rows) is brought to length 1 in double precision; the pieces are neither copied nor joined."""

    def __init__(self, pieces: list[np.ndarray]):
        self.pieces = pieces
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.starts[-1])

    def raw(self, at: np.ndarray) -> np.ndarray:
        """Rows `at`, as they came, in double precision."""
        out = np.empty((len(at), self.pieces[0].shape[1] if self.pieces else 0))
        piece = np.searchsorted(self.starts, at, side="right") - 1
        order = np.argsort(piece, kind="stable")
        ends = np.searchsorted(piece[order], np.arange(len(self.pieces) + 1))
        for k in np.unique(piece):
            mine = order[ends[k] : ends[k + 1]]
            out[mine] = self.pieces[k][at[mine] - self.starts[k]]
        return out

    def __getitem__(self, at: np.ndarray | slice) -> np.ndarray:
        return _scaled(self.raw(np.arange(len(self))[at] if isinstance(at, slice) else at))

    def single(self, order: np.ndarray | None = None) -> np.ndarray:
        """All rows of length 1 in single precision, in some order."""
        out = np.empty((len(self), self.pieces[0].shape[1] if self.pieces else 0), np.float32)
        for k in range(0, len(self), STEP_SHARD):
            out[k : k + STEP_SHARD] = self[slice(k, k + STEP_SHARD) if order is None else order[k : k + STEP_SHARD]]
        return out


class Links:
    """Links of queries (ids `own`) with the vectors of a shard (ids, weights): how many each query has, and their spanning forest. Pairs that come in are counted and folded
    into the forest a helping at a time; no list of them is kept, but for those of beams, which are short. `scanned` tells which queries met the whole shard. A vector's match
    with itself is no link."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.own, self.ids, self.weights = own, ids, weights
        self.n, self.held = np.zeros(len(own), np.int64), 0
        self.scanned = np.zeros(len(own), bool)
        self.beams = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64))]

    def add(self, q: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Take pairs (query row, shard row); returns how many links of each query were among them, equal vectors as one."""
        apart = self.own[q] != self.ids[s]
        q, s = q[apart], s[apart]
        np.add.at(self.n, q, self.weights[s])
        self.found.append((self.own[q], self.ids[s]))
        self.held += len(q)
        if self.held > HELD_PAIRS:
            self.found, self.held = [self.forest()], 0
        return np.bincount(q, minlength=len(self.own))

    def add_beams(self, q: np.ndarray, s: np.ndarray) -> None:
        """Take the verified links of beams, and keep them as they are."""
        self.add(q, s)
        self.beams = (q, s)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        return forest(*map(np.concatenate, zip(*self.found, strict=True)))


def _exact(queries: np.ndarray, shard: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (query row, shard row) of cosine `least` or more, block after block; vectors in double precision."""
    for j in range(0, len(shard), STEP_SHARD):
        part = shard[j : j + STEP_SHARD].T
        for k in range(0, len(queries), STEP_ROWS):
            x, y = np.nonzero(queries[k : k + STEP_ROWS] @ part >= least)
            yield x + k, y + j


def audit_order(own: np.ndarray) -> np.ndarray:
    """Rows in the order of a hash of their ids, whatever the ids have in common."""
    mixed = own.astype(np.int64).view(np.uint64)
    for by in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(by)
    return np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")


def find(graph: Graph, shard: np.ndarray, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, weights: np.ndarray, least: float, beam: int = BEAM) -> tuple[Links, int, float]:
    """Verified links, the beam that passed the audit, and its recall. shard, queries: double precision, length 1; own, ids: what they are called.

    The recall is that of queries whose beam is not full of links, as the others are scanned. The audit takes more queries until they have LEAST_TRUTH links or
    all are answered exactly.
    """
    out, order = Links(own, ids, weights), audit_order(own)
    known, truth = out.scanned, np.zeros(len(own), np.int64)

    def scan(rows: np.ndarray) -> None:
        for x, y in _exact(queries[rows], shard, least):
            np.add(truth, out.add(rows[x], y), out=truth)
        known[rows] = True

    size = max(AUDIT_ROWS, len(own) // AUDIT_EVERY)
    while beam < len(shard):
        near, sims = graph.search(queries.astype(np.float32), beam)
        # the beam's last is a link, or nearly: there may be more
        full = sims[:, -1] >= least - 1e-3
        q, k = np.nonzero((sims >= least - 1e-3) & ~full[:, None])
        s = near[q, k]
        ok = own[q] != ids[s]
        for j in range(0, len(q), STEP_SHARD):
            part = slice(j, j + STEP_SHARD)
            ok[part] &= np.einsum("ij,ij->i", queries[q[part]], shard[s[part]]) >= least
        q, s = q[ok], s[ok]
        while True:
            rows = order[:size]
            scan(rows[~known[rows]])
            judged = known & ~full
            if (links := int(truth[judged].sum())) >= LEAST_TRUTH or known.all():
                break
            size *= 2
        if known.all():
            return out, beam, 1.0
        if (hits := int(judged[q].sum())) >= RECALL * links:
            out.add_beams(q[~known[q]], s[~known[q]])
            scan(np.flatnonzero(full & ~known))
            return out, beam, hits / links
        beam *= 2
    scan(np.flatnonzero(~known))
    return out, beam, 1.0


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    return _scaled(np.array(column.combine_chunks().flatten() if not isinstance(column, pa.Array) else column.flatten()).reshape(-1, dim))


def _scaled(out: np.ndarray) -> np.ndarray:
    """Rows brought to length 1 in place, as a shard is most of what a task holds. A scale first, so that squares of huge or tiny numbers stay finite."""
    for k in range(0, len(out), STEP_SHARD):
        part = out[k : k + STEP_SHARD]
        part /= np.abs(part).max(axis=1, keepdims=True)
        part /= np.sqrt((part * part).sum(axis=1, keepdims=True))
    return out


_SHARD = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("layers", pa.binary())])
SHARD = "dim int, shard int, piece int, ids binary, weights binary, vectors binary, layers binary"


def _packed(vectors: np.ndarray) -> bytes:
    """In single precision if that says the same."""
    with np.errstate(over="ignore"):
        single = vectors.astype("<f4")
    return (single if np.array_equal(single, vectors) else vectors.astype("<f8")).tobytes()


def _unpacked(blob: pa.Buffer, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<f4" if len(blob) == 4 * rows * dim else "<f8").reshape(rows, dim)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """A shard and its graph in pieces, in the order of the graph."""
    dim, shard = (k.as_py() for k in key)
    rows = Rows([np.asarray(c.flatten()).reshape(-1, dim) for c in table["vector"].chunks if len(c)])
    ids, weights = table["id"].to_numpy(), table["weight"].to_numpy()
    heights = Graph.heights(len(ids), shard)
    order = np.argsort(ids, kind="stable")[np.argsort(-heights, kind="stable")]
    layers = Graph.build(rows.single(order), np.sort(heights)[::-1]).pack()
    size = max(1, PIECE_BYTES // (8 * max(1, dim)))
    pieces = [order[k : k + size] for k in range(0, len(order), size)]
    share = -(-len(layers) // max(1, len(pieces)))
    columns = [
        [dim] * len(pieces), [shard] * len(pieces), list(range(len(pieces))), [ids[p].astype("<i8").tobytes() for p in pieces], [weights[p].astype("<i8").tobytes() for p in pieces],
        [_packed(rows.raw(p)) for p in pieces], [layers[k * share : (k + 1) * share] for k in range(len(pieces))]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARD, strict=True)], schema=_SHARD)


#: Three kinds of rows: a scanned query's links with a shard (no other), a beam's link (both ends, each once with the shard of the other end and its weight), an edge of a forest (no shard).
_LINKS = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("shard", pa.int32()), ("n", pa.int64())])
LINKS = "id long, other long, shard int, n long"


def _links(id: np.ndarray, other: np.ndarray | None, shard: np.ndarray | None, n: np.ndarray | None) -> pa.Table:
    columns = [pa.nulls(len(id), f.type) if c is None else pa.array(c, f.type) for c, f in zip((id, other, shard, n), _LINKS, strict=True)]
    return pa.Table.from_arrays(columns, schema=_LINKS)


def _scanned(found: Links, number: int) -> pa.Table:
    some = np.flatnonzero(found.scanned & (found.n > 0))
    return _links(found.own[some], None, np.full(len(some), number), found.n[some])


def _beams(found: Links, number: int, weight: np.ndarray, home: np.ndarray) -> pa.Table:
    q, s = found.beams
    there = _links(found.own[q], found.ids[s], np.full(len(q), number), found.weights[s])
    return pa.concat_tables([there, _links(found.ids[s], found.own[q], home[q], weight[q])])


def _forest(found: Links) -> pa.Table:
    a, b = found.forest()
    return _links(a, b, None, None)


def link_counts(links: DataFrame) -> DataFrame:
    """id, n: links of every id (columns LINKS), whichever end found them. With a shard that an id's scan compared whole, the scan's number holds; with others each link counts once."""
    met = links.filter("shard IS NOT NULL")
    once = met.groupBy("id", "shard", "other").agg(F.max("n").alias("n"))
    by_shard = once.groupBy("id", "shard").agg(F.max(F.when(F.col("other").isNull(), F.col("n"))).alias("scanned"), F.sum(F.when(F.col("other").isNotNull(), F.col("n"))).alias("beams"))
    return by_shard.groupBy("id").agg(F.sum(F.coalesce("scanned", "beams")).alias("n"))


def _query(least: float):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _LINKS.empty_table()
        dim, number = key[0].as_py(), key[1].as_py()
        order = np.argsort(right["piece"].to_numpy()) if "piece" in right.column_names else range(right.num_rows)
        blobs = lambda c: [right[c][int(k)].as_buffer() for k in order]  # noqa: E731  (views, no copies)
        numbers = lambda c: np.concatenate([np.frombuffer(x, "<i8") for x in blobs(c)])
        ids, weights = numbers("ids"), numbers("weights")
        shard = Rows([_unpacked(x, len(n) // 8, dim) for x, n in zip(blobs("vectors"), blobs("ids"), strict=True)])
        own, queries = left["id"].to_numpy(), _matrix(left["vector"], dim)
        found, _, _ = find(Graph.unpack(b"".join(blobs("layers")), shard.single()), shard, queries, own, ids, weights, least)
        return pa.concat_tables([_scanned(found, number), _beams(found, number, left["weight"].to_numpy(), left["home"].to_numpy()), _forest(found)])

    return run


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings (vec_id, embedding).

    n_links: other rows of cosine `least` or more; component_id: smallest vec_id that links reach; kept: vec_id is that. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do rows with a null vec_id (their component is null, kept false); vectors of different
    length do not link. Rows with equal vec_id count each. An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = stored(rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))), "hnsw-rows")
    vertices = stored(rows.filter("usable").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("dim", F.size("vector")), "hnsw-vertices")
    many = vertices.count()
    shards, blocks = max(MIN_SHARDS, -(-many // shard_rows)), max(1, -(-many // query_rows))
    vertices = vertices.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = vertices.select("dim", "shard", "id", "weight", "vector").groupBy("dim", "shard").applyInArrow(_build, SHARD)
    graphs = stored(graphs, "hnsw-graphs", FILE_PIECES).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = vertices.select("dim", "id", "weight", "vector", F.col("shard").alias("home"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = asked.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInArrow(_query(least), LINKS)
    found = stored(found, "hnsw-links")
    counts = link_counts(found)
    joined = components(found.filter("shard IS NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), "hnsw")
    named = vertices.select("id", "vector", "weight").join(counts, "id", "left").join(joined, "id", "left")
    named = named.select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    both = salted_join(rows.filter("usable"), named, ["vector"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return both.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
