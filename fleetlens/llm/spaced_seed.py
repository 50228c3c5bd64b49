"""Benchmark decontamination by spaced seeds.

A mask looks at five of the next six to eight words and ignores the others. MASKS are such that every aligned overlap of 8 to 20 words in
which a fifth of the words or less are substituted agrees under at least one mask somewhere (tests try all patterns). Items of five to seven
words have masks of their own, each ignoring one word; shorter ones are hashed whole, as a fifth of them is less than a word. The hashes of
all benchmark positions under all masks are looked up by all positions of the documents; around each hit the two texts are
laid side by side and the overlap is verified: OVERLAP words of the item (the whole item if shorter) of which 0.8 or more are the same.
A letter of a script written without spaces is a word by itself.

The different texts of the benchmark travel to the tasks in blocks of about BLOCK_CHARS characters (one text at least), one pass over the documents for
each, whose result is written before the next block is read; so memory of tasks and driver is bounded, and documents are neither shuffled nor joined
pair by pair. Item ids are joined to what was found, so an item that is repeated however often is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import steps, stored

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 7))
SIMILARITY = 0.8
OVERLAP = 20
BLOCK_CHARS = 8_000_000
#: Hits laid side by side at a time.
HIT_STEP = 100_000

#: Fixed ranges: Thai and Lao, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

_SPACED_WORD, _UNSPACED = re.compile(r"[^\W_]+"), re.compile(f"[{UNSPACED}]")
_WORD = re.compile(f"(?=[^\\W_])[{UNSPACED}]|[^\\W_{UNSPACED}]+")
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"place {k}") | 1 for k in range(6)], np.uint64)
_SCHEMA = "doc_id long, item_key string, doc_start int, item_start int, n_words int, n_same int, similarity double"


def words(text: str | None) -> np.ndarray:
    """A hash of every word: runs of letters and digits in lower case, letters of unspaced scripts one by one."""
    lower = (text or "").lower()
    word = _WORD if not lower.isascii() and _UNSPACED.search(lower) else _SPACED_WORD
    return np.array([xxhash.xxh3_64_intdigest(w) for w in word.findall(lower)], np.uint64)


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks that meet every similar overlap with an item of so many words."""
    if size >= 8:
        return MASKS
    if size >= 5:
        return tuple(tuple(k for k in range(size) if k != out) for out in range(size))
    return (tuple(range(size)),) if size else ()


def seeds(hashed: np.ndarray, masks: Iterable[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of a text under the masks, and the positions where they begin."""
    found, at, mixed = [], [], hashed ^ (hashed >> np.uint64(31))
    for mask in masks:
        n = len(hashed) - mask[-1]
        if n > 0:
            total = np.full(n, xxhash.xxh3_64_intdigest(str(mask)), np.uint64)
            for offset, by in zip(mask, _MULTIPLIERS, strict=False):
                total += mixed[offset : offset + n] * by
            found.append(total)
            at.append(np.arange(n, dtype=np.int32))
    return (np.concatenate(found), np.concatenate(at)) if found else (np.empty(0, np.uint64), np.empty(0, np.int32))


@dataclass
class Block:
    """Texts of a benchmark, their words one after another, and their seeds in the order of the hash, under the masks that their lengths ask for."""

    keys: list[list[str]]
    masks: list[tuple[int, ...]]
    starts: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray


def block(texts: list[tuple[str, str]]) -> Block:
    """A block of (key, text); texts of equal words share an entry, texts without words have none."""
    by_words: dict[bytes, list[str]] = {}
    for key, text in texts:
        by_words.setdefault(words(text).tobytes(), []).append(key)
    by_words.pop(b"", None)
    own = [np.frombuffer(w, np.uint64) for w in by_words]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
    found = [seeds(t, masks_of(len(t))) for t in own]
    masks = sorted({mask for size in {len(t) for t in own} for mask in masks_of(size)})
    hashes = np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)])
    item_of = np.repeat(np.arange(len(own), dtype=np.int32), [len(f[0]) for f in found])
    at = np.concatenate([np.empty(0, np.int32), *(f[1] for f in found)])
    order = np.argsort(hashes, kind="stable")
    return Block(list(by_words.values()), masks, starts, np.concatenate([np.empty(0, np.uint64), *own]), hashes[order], item_of[order], at[order])


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int, similarity: float, overlap: int) -> tuple[int, int, int, int] | None:
    """(doc start, item start, words, same words) of the longest overlap along a diagonal (doc position less item position).

    The overlap is made of all windows of `overlap` words (the whole item, if shorter) that are similar enough, where they touch.
    """
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    size = min(overlap, len(item))
    if last - first < size:
        return None
    same = doc[first + diagonal : last + diagonal] == item[first:last]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[size:] - total[:-size] >= similarity * size - 1e-9)
    if not len(good):
        return None
    best = None
    for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1):
        a, b = int(run[0]), int(run[-1]) + size
        found = (int(total[b] - total[a]), first + a + diagonal, first + a, b - a)
        best = max(best or found, found, key=lambda f: (f[0], -f[1]))
    return best[1], best[2], best[3], best[0]


def overlaps_in(hashed: np.ndarray, against: Block, similarity: float = SIMILARITY, overlap: int = OVERLAP) -> dict[int, tuple[int, int, int, int]]:
    """The best overlap of a text with each item of a block: most same words, then earliest."""
    found, at = seeds(hashed, against.masks)
    if not len(found) or not len(against.seeds):
        return {}
    low = np.searchsorted(against.seeds, found)
    hit = np.flatnonzero(against.seeds[np.minimum(low, len(against.seeds) - 1)] == found)
    if not len(hit):
        return {}
    low, at = low[hit], at[hit]
    many = np.searchsorted(against.seeds, found[hit], side="right") - low
    ends = np.cumsum(many)
    best: dict[int, tuple[int, int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    done = 0
    while done < len(hit):
        # hits of whole positions, so many that their partners fill a step
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HIT_STEP, side="right")))
        n = many[done:upto]
        k = np.repeat(low[done:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.stack([against.seed_item[k], np.repeat(at[done:upto], n) - against.seed_at[k]], axis=1), axis=0)
        for item, diagonal in pairs.tolist():
            if (item, diagonal) in tried:
                continue
            tried.add((item, diagonal))
            own = against.words[against.starts[item] : against.starts[item + 1]]
            if (got := verify(hashed, own, diagonal, similarity, overlap)) and (item not in best or (got[3], -got[0]) > (best[item][3], -best[item][0])):
                best[item] = got
        done = upto
    return best


def _blocks(texts: DataFrame, block_chars: int) -> Iterator[tuple[Block, bool]]:
    """Blocks of the different texts (item_key, text), each with whether it is the only one."""
    chars = texts.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, -(-2 * chars // block_chars)) if chars > block_chars else 1
    for k in range(n):
        part = texts if n == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield block([(r["item_key"], r["text"]) for r in part.collect()]), n == 1


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The best overlap of every document (doc_id, text) with every item (item_id, text) that it contains in part or whole.

    Columns: doc_id, item_id, doc_start, item_start (word positions), n_words, n_same, similarity = n_same / n_words. Null and empty texts and texts without
    a word have no overlap. Repeated documents and items give repeated rows; null ids come back null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = items.withColumn("item_key", F.sha2(F.col("text").cast("binary"), 256))
    spark, out, names = docs.sparkSession, None, [c.split()[0] for c in _SCHEMA.split(", ")]
    for against, only in _blocks(items.select("item_key", "text").distinct(), block_chars):
        shared = spark.sparkContext.broadcast(against)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in steps(batches, "text"):
                found = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for item, (a, b, n, same) in sorted(overlaps_in(words(text), known, similarity, overlap).items()):
                        found += [(doc, key, a, b, n, same, same / n) for key in known.keys[item]]
                if found:
                    columns = zip(*found, strict=True)
                    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = rows.mapInArrow(run, _SCHEMA)
        if not only:
            part = stored(part, "overlaps")
            shared.destroy()
        out = part if out is None else out.union(part)
    return out.join(items.select("item_key", "item_id"), "item_key").select("doc_id", "item_id", *names[2:])
