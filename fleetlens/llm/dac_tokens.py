"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, low ones first. Level 0 holds the first chunk of every id; a continuation bitmap says which ids go on, and
their next chunks stand, in order, on the next level. A rank directory counts the set bits before every 512th, so that the place of an
id on the next level is one directory entry and the bits of at most eight words: any id, or any range, is read without decoding a block.

Texts are dealt out by ranges of (doc_id, hash of text), sorted inside a task, tokenized there and written as segments of whole documents. Each segment
row holds a blob (below) and its place in its part; a directory of parts holds what precedes each. Spark writes and reads both, so any
store it reaches will do, and a lost task writes the same again.

Blob, little-endian: "DAC1", u32 documents, u64 ids, u32 levels; i64 doc ids, u8 null marks, u64 starts (documents + 1); for each level u64 count, the
chunks, the bitmap (u64 words), the rank directory (u32).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm import word_ids
from fleetlens.llm.common import steps

SEGMENT_IDS = 1 << 16
RANK_BITS = 512
END_ID = 1
#: Bytes of text tokenized at a time.
TEXT_BYTES = 8_000_000


class Level:
    def __init__(self, chunks: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.chunks, self.words, self.ranks = chunks, words, ranks

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ids before position `at` go on to the next level."""
        at = np.asarray(at, np.int64)
        first = at // RANK_BITS * (RANK_BITS // 64)
        out = self.ranks[at // RANK_BITS].astype(np.int64)
        for k in range(RANK_BITS // 64):
            word = self.words[np.minimum(first + k, len(self.words) - 1)]
            upto = np.clip(at - (first + k) * 64, 0, 64)
            mask = np.where(upto >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(upto, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(word & mask).astype(np.int64)
        return out

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1


class Dac:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def of(ids: np.ndarray) -> Dac:
        ids, levels = np.asarray(ids, np.uint32), []
        while len(ids):
            more = ids > 255
            bits = np.zeros(-(-(len(ids) + 1) // RANK_BITS) * RANK_BITS, np.uint8)
            bits[: len(ids)] = more
            words = np.packbits(bits, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).reshape(-1, RANK_BITS // 64).sum(axis=1)
            levels.append(Level((ids & 255).astype(np.uint8), words, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)))
            ids = ids[more] >> 8
        return Dac(levels)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids at any positions."""
        at = np.asarray(at, np.int64)
        out, of = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, level in enumerate(self.levels):
            if not len(at):
                break
            out[of] |= level.chunks[at].astype(np.uint32) << np.uint32(8 * k)
            more = level.goes_on(at)
            of, at = of[more], level.rank(at[more])
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of a range: one rank at its start on each level."""
        out, of = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, level in enumerate(self.levels):
            if start >= end:
                break
            out[of] |= level.chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            low = start // 64
            bits = np.unpackbits(level.words[low : end // 64 + 1].view(np.uint8), bitorder="little")[start - low * 64 : end - low * 64]
            of = of[bits == 1]
            start = int(level.rank(np.array([start]))[0])
            end = start + len(of)
        return out


def pack(doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
    dac = Dac.of(ids)
    parts = [b"DAC1", struct.pack("<IQI", len(doc_ids), len(ids), len(dac.levels)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([*starts, len(ids)], "<u8").tobytes()]
    for x in dac.levels:
        parts += [struct.pack("<Q", len(x.chunks)), x.chunks.tobytes(), x.words.tobytes(), x.ranks.tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, Dac]:
    """Document ids, starts (one more than documents) and ids of a segment; nothing is decoded yet."""
    if blob[:4] != b"DAC1":
        raise ValueError("not a segment")
    docs, _, n_levels = struct.unpack_from("<IQI", blob, 4)
    at, levels = 20, []

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    ids, nulls = take("<i8", docs).tolist(), take("u1", docs).tolist()
    starts = take("<u8", docs + 1).astype(np.int64)
    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        blocks = -(-(n + 1) // RANK_BITS)
        levels.append(Level(take("u1", n), take("<u8", blocks * RANK_BITS // 64), take("<u4", blocks)))
    return [None if null else i for i, null in zip(ids, nulls, strict=True)], starts, Dac(levels)


def write(docs: DataFrame, tokenizer: str, out: str, segment_ids: int = SEGMENT_IDS, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text) below `out`, documents in ascending order of doc_id (null first; equal ids in the order of their texts' hash),
    each closed by end_id. Null texts count as empty. An empty table leaves an archive without segments."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, done, seq = word_ids.load(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs_held: list[int | None] = []
        starts_held: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def segment():
            nonlocal done, size, seq
            blob = pack(docs_held, starts_held, np.concatenate(held))
            row = [[part], [seq], [done], [size], [blob]]
            done, seq, size = done + size, seq + 1, 0
            docs_held.clear(), starts_held.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "part_start", "n_ids", "blob"])

        for batch in steps(batches, "text", TEXT_BYTES):
            ids, starts = words.encode(batch.column("text"))
            ids, starts = np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            while at < len(doc_ids):  # as many documents as fill the segment
                to = min(len(doc_ids), int(np.searchsorted(starts, starts[at] + segment_ids - size)))
                docs_held += doc_ids[at:to]
                starts_held += (starts[at:to] - starts[at] + size).tolist()
                held.append(ids[starts[at] : starts[to]])
                size, at = size + int(starts[to] - starts[at]), to
                if size >= segment_ids:
                    yield segment()
        if docs_held:
            yield segment()

    dealt.mapInArrow(run, "part int, seq int, part_start long, n_ids long, blob binary").write.mode("overwrite").parquet(f"{out}/segments")
    spark = docs.sparkSession
    totals = spark.read.parquet(f"{out}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each write task, so the window is as small as Spark's own list of tasks
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("before")).write.mode("overwrite").parquet(f"{out}/parts")


def _segments(spark: SparkSession, out: str) -> DataFrame:
    segments, parts = spark.read.parquet(f"{out}/segments"), spark.read.parquet(f"{out}/parts")
    return segments.join(parts, "part").select((F.col("before") + F.col("part_start")).alias("start"), "n_ids", "blob")


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian u32) of every document below `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
                ids, starts, dac = unpack(blob.as_py())
                every = dac.slice(0, int(starts[-1])).astype("<u4").tobytes()  # one range: all documents of the segment
                found = [every[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(found, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return _segments(spark, out).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, out: str, positions: DataFrame) -> DataFrame:
    """(position, id) for a table of positions counted over all documents; positions outside get a null id. Repeated positions come back repeated."""
    width = SEGMENT_IDS
    segments = _segments(spark, out).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_ids") - 1) / width))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / width))
    near = (asked.cell == segments.cell) & (asked.position >= segments.start) & (asked.position < segments.start + segments.n_ids)
    rows = asked.join(segments, near, "left").select("position", (F.col("position") - F.col("start")).alias("at"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if at is None else int(unpack(blob.as_py())[2].get(np.array([at]))[0]) for at, blob in zip(batch.column("at").to_pylist(), batch.column("blob"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(found, pa.int64())], ["position", "id"])

    return rows.mapInArrow(run, "position long, id long")
