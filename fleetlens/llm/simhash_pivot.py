"""SimHash near-duplicates found through tables of distances to reference fingerprints (pivots).

A fingerprint x is known by its distances to many references. For a set of bits M, d_M(x, r) counts the bits of M in which x and r
differ; it is a distance as well, so d_M(x, y) = 0 makes all coordinates d_M(x, r) and d_M(y, r) equal. Cut the 64 bits into
RADIUS + 3 bands: of two fingerprints that differ in RADIUS bits or fewer, at least 3 bands have distance 0. Rows therefore meet
under the coordinates of each choice of 3 bands (20 choices for radius 3), and no pair within the radius is missed. Rows that meet are
compared by their coordinates over all 64 bits: a pair whose largest coordinate difference is over the radius is discarded (triangle
inequality), and survivors are verified by their true distance.

Equal fingerprints are one vertex, so copies cost nothing. A table cell with more than HOT_CELL rows is divided again, exactly: of the bits
that may still differ, one half has RADIUS / 2 differences or fewer, so its rows meet under each half with each choice of that many
bits left out. What is left in a divided cell is bounded by the number of different fingerprints it can hold (2**17 for radius 3).
Tasks return the spanning forest of the links they saw, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import salts, steps, stored
from fleetlens.llm.components import components, forest

RADIUS = 3
WORDS = 3
#: Reference fingerprints of the whole-width table and of each band's table.
REFERENCES = 32
BAND_REFERENCES = 16
HOT_CELL = 2048
#: Bits of a cell's number. Cells that share one are compared in vain, no more; fewer bits make smaller shuffles.
CELL_BITS = 40
SEED = 42
#: Words of a text that are hashed at a time.
WORD_STEP = 500_000
SALTS = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def references(n: int, key: int) -> np.ndarray:
    return np.random.default_rng([SEED, key]).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: bytes | None, words: int = WORDS, prints: int = 1) -> list[int]:
    """Majority of the hash bits of all word shingles, repeats included; zeros if there is no word. The first print takes XXH64 as it is, others mix it."""
    found = (text or b"").lower().split()
    if not found:
        return [0] * prints
    size = min(words, len(found))
    ones, total = np.zeros((prints, 64), np.int64), len(found) - size + 1
    for start in range(0, total, WORD_STEP):
        part = found[start : min(start + WORD_STEP, total) + size - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(size)), strict=False)], "<u8")
        for k in range(prints):
            if k:
                hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
                hashes ^= hashes >> np.uint64(29)
            ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, words: int = WORDS, prints: int = 1) -> DataFrame:
    """(doc_id, fp0, fp1, ... long) of every row. Null and empty texts get 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = [f"fp{k}" for k in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = np.array([fingerprint(t, words, prints) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1, prints)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c.view(np.int64)) for c in np.ascontiguousarray(found.T)]], ["doc_id", *names])

    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{n} long" for n in names]]))


def coordinates(fps: np.ndarray, mask: int, refs: np.ndarray) -> np.ndarray:
    """Distances over the bits of the mask: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count((fps[:, None] ^ refs[None, :]) & np.uint64(mask))


def cell(fps: np.ndarray, mask: int, refs: np.ndarray) -> np.ndarray:
    """A number that is equal wherever all coordinates over the mask are equal."""
    table = coordinates(fps, mask, refs).astype(np.uint64)
    out = np.full(len(fps), mask, np.uint64) * _MIX
    for column in table.T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - CELL_BITS)


def band_masks(bands: int) -> list[int]:
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]


def choices(radius: int) -> list[int]:
    """The bits of each choice of 3 out of radius + 3 bands."""
    return [sum(c) for c in itertools.combinations(band_masks(radius + 3), 3)]


_ROW = "cell long, choice int, fp long, id long"


def _rows(cells: np.ndarray, choice: int, fps: np.ndarray, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(np.full(len(fps), choice, np.int32)), pa.array(fps.view(np.int64)), pa.array(ids)], ["cell", "choice", "fp", "id"])


def _cells(radius: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = choices(radius)
        for batch in batches:
            for n in range(prints):
                fps, refs = batch.column(f"fp{n}").to_numpy().view(np.uint64), references(BAND_REFERENCES, 10 + n)
                for k, mask in enumerate(masks):
                    yield _rows(cell(fps, mask, refs), k, fps, batch.column("id"))

    return run


def _divided(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, refs = choices(radius), references(BAND_REFERENCES, 2)
        for batch in batches:
            all_fps, all_cells, kinds, all_ids = (batch.column(c).to_numpy() for c in ("fp", "cell", "choice", "id"))
            for kind in np.unique(kinds):
                some = kinds == kind
                fps, cells, ids = all_fps[some].view(np.uint64), all_cells[some].view(np.uint64), all_ids[some]
                free = [b for b in range(64) if not masks[kind] >> b & 1]
                for half in (free[: len(free) // 2], free[len(free) // 2 :]):
                    for out in itertools.combinations(half, radius // 2):
                        mask = sum(1 << b for b in half if b not in out)
                        yield _rows(((cells + (cell(fps, mask, refs) << np.uint64(20))) * _MIX) >> np.uint64(64 - CELL_BITS), kind, fps, ids)

    return run


def _near(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs survive: coordinates in two helpings, so that most pairs cost a few, then the true distance."""
    at = np.arange(len(a))
    for part in (slice(0, 8), slice(8, None)):
        at = at[(np.abs(ta[at, part] - tb[at, part]) <= radius).all(axis=1)]
    return at[np.bitwise_count(a[at] ^ b[at]) <= radius]


def linked(cells: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids of one cell, for rows in the order of cell and fingerprint, as a spanning forest."""
    again = np.concatenate([[False], (cells[1:] == cells[:-1]) & (fps[1:] == fps[:-1])])
    at = np.flatnonzero(~again)
    first = np.repeat(at, np.diff(np.append(at, len(cells))))
    found = [(ids[first[again]], ids[again])]  # equal fingerprints; the first stands for all
    cells, fps, ids = cells[at], fps[at], ids[at]
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    several = np.repeat(sizes > 1, sizes)
    cells, fps, ids, sizes = cells[several], fps[several], ids[several], sizes[sizes > 1]
    if not len(cells):
        return forest(*found[0])
    starts = np.cumsum(sizes) - sizes
    table = coordinates(fps, 2**64 - 1, references(REFERENCES, 3)).astype(np.int16)
    held = 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, held
        ok = _near(fps[i], fps[j], table[i], table[j], radius)
        found.append((ids[i[ok]], ids[j[ok]]))
        held += len(ok)
        if held > 500_000:
            found, held = [forest(*map(np.concatenate, zip(*found, strict=True)))], 0

    at, shift = np.flatnonzero(np.repeat(sizes <= 64, sizes)), 1
    while True:
        i = at[at + shift < len(cells)]
        i = i[cells[i] == cells[i + shift]]
        if not len(i):
            break
        for k in range(0, len(i), 200_000):
            add(i[k : k + 200_000], i[k : k + 200_000] + shift)
        at, shift = i, shift + 1
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        # in the order of the first coordinate, partners lie within a window
        rows = start + np.argsort(table[start : start + size, 0], kind="stable")
        first = table[rows, 0]
        ends = np.searchsorted(first, first + radius, side="right")
        for k in range(0, size, step := max(1, 200_000 // int(size))):
            own = np.arange(k, min(k + step, size))
            many = ends[own] - own - 1
            i = np.repeat(own, many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            add(rows[i], rows[j])
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]

        def seen(cells, fps, ids):
            nonlocal a, b
            x, y = linked(cells, fps.view(np.uint64), ids, radius)
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))

        for batch in batches:
            rest = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("cell", "fp", "id"), strict=True)]
            if len(rest[0]) < 200_000 and batch.num_rows:
                continue
            if cut := int(np.searchsorted(rest[0], rest[0][-1])):  # the last cell may go on
                seen(*(r[:cut] for r in rest))
                rest = [r[cut:] for r in rest]
        if len(rest[0]):
            seen(*rest)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(vertices: DataFrame, radius: int = RADIUS, prints: int = 1, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links (a, b) between ids of vertices (id, fp0, fp1, ...) of which one print differs in radius bits or fewer, thinned to forests that keep every
    component."""
    cells = vertices.mapInArrow(_cells(radius, prints), _ROW)
    hot = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > hot_cell).select("cell"), "simhash-hot")
    if not hot.isEmpty():
        cells = cells.join(hot.withColumn("is_hot", F.lit(True)), "cell", "left")
        fine = cells.filter("is_hot IS NULL").select("cell", "choice", "fp", "id")
        cells = fine.union(cells.filter("is_hot").select("cell", "choice", "fp", "id").mapInArrow(_divided(radius), _ROW))
    dealt = cells.select("cell", "fp", "id").repartition("cell").sortWithinPartitions("cell", "fp")
    found = dealt.mapInArrow(_links(radius), "a long, b long")
    # a large group of near copies has a forest in every task: those of several tasks are joined to one
    tasks = max(4, int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return found.repartition(tasks).mapInArrow(_merged, "a long, b long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spanning forest of all links that come in."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, prints: int = 1, hot_cell: int = HOT_CELL) -> DataFrame:
    """(doc_id, fp0, ..., component_id) of every row of docs (doc_id, text): component_id is the smallest doc_id that links reach.

    Rows with a null doc_id keep their fingerprint, link with nothing and get a null component_id. Repeated rows come back repeated. An empty table
    gives no rows.
    """
    names = [f"fp{k}" for k in range(prints)]
    marked = stored(fingerprints(docs, words, prints), "simhash-prints")
    vertices = stored(marked.filter("doc_id IS NOT NULL").groupBy(*names).agg(F.min("doc_id").alias("id")), "simhash-vertices")
    joined = components(links(vertices, radius, prints, hot_cell), "simhash")
    named = vertices.join(joined, "id", "left").select(*names, F.coalesce("component", "id").alias("component_id"), F.explode(salts(SALTS)).alias("salt"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(named, [*names, "salt"], "left").select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_of(fp: str = "fp0"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
