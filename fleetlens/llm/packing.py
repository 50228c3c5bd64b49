"""Order-preserving packing of documents into training sequences, by dynamic programming over places to cut.

The ids of a task's documents, in the order in which the table stores them, are one stream. It may be cut behind a document (free), behind a sentence, or, so that
places are never far apart, between any two words (both at a price in tokens of padding). A sequence takes what lies between two cuts, LENGTH ids at most, and is
padded to LENGTH unless its size is a power of two. With f(j) the least cost of all up to place j, at position p(j),

    f(j) = price(j) + min over i with p(j) - p(i) <= LENGTH of  f(i) + LENGTH - (p(j) - p(i)),

and f(i) + p(i) does not depend on j: the minimum of a sliding window, kept in a monotone queue, so a place costs a constant number of steps. Sizes that are powers of
two are further transitions, looked up by position.

Nothing is shuffled. A task holds one block of its stream at a time: what lies behind the best cut near a block's end goes on with the next block, so only the
last sequence of a task can be short. A lost task reads the same rows again and cuts them alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import word_ids
from fleetlens.llm.common import steps

LENGTH = 2048
END_ID = 1
#: Prices of a cut, in tokens of padding: behind a sentence, between words; and of a sequence shorter than LENGTH that needs no padding.
SENTENCE, WORD, SHORT = 8, 32, 8
#: Ids between two places at most, and the least power of two that sizes try everywhere (at the end of a task: every one).
GAP, LEAST_SHORT = 32, 64
#: Ids of a block, and bytes of text tokenized at a time.
BLOCK_IDS = 1 << 20
TEXT_BYTES = 8_000_000

_SIGNS, _CLOSING = ".!?", "\"')"


@functools.lru_cache(maxsize=2)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence."""
    words = word_ids.load(tokenizer)
    out = np.zeros(len(words.ends_word), bool)
    for token, i in words.tokenizer.get_vocab().items():
        text = token.removesuffix("</w>")
        out[i] = text.strip(_SIGNS + _CLOSING) == "" and any(c in _SIGNS for c in text)
    for sign in "。！？…":
        found = words.tokenizer.encode(sign, add_special_tokens=False).ids
        if len(found) == 1:
            out[found[0]] = True
    return out


@dataclass
class Prices:
    length: int = LENGTH
    sentence: int = SENTENCE
    word: int = WORD
    short: int = SHORT
    gap: int = GAP
    least_short: int = LEAST_SHORT


def places(total: int, doc_ends: np.ndarray, ends: np.ndarray, prices: Prices, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (the first is 0) where a stream of `total` ids may be cut, and what a cut costs there: behind documents, behind the sentences that end at
    `ends`, and wherever places would be more than a gap apart; before the end of all, everywhere."""
    cost = np.full(total + 1, -1, np.int32)
    known = np.union1d(np.union1d(doc_ends, ends), [0, total])
    room = np.diff(known)
    wide = np.flatnonzero(room > prices.gap)
    many = (room[wide] - 1) // prices.gap
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
    cost[np.repeat(known[wide], many) + nth * prices.gap] = prices.word
    if last:
        cost[max(0, total - prices.length) :] = prices.word
    cost[ends] = prices.sentence
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(position: np.ndarray, price: np.ndarray, prices: Prices, last: bool) -> list[int]:
    """The cheapest cuts (positions, 0 first) up to the last position, or, unless this is the last block, up to the cheapest place within a length of it."""
    length, total, n = prices.length, int(position[-1]), len(position)
    index = np.full(total + 1, -1, np.int64)
    index[position] = np.arange(n)
    shorter: dict[int, list[int]] = {}
    size = 1
    while size < length:
        from_ = 0 if size >= prices.least_short else total - 2 * length if last else total + 1
        j = np.flatnonzero((position >= size) & (position >= from_))
        i = index[position[j] - size]
        for a, b in zip(j[i >= 0].tolist(), i[i >= 0].tolist(), strict=True):
            shorter.setdefault(a, []).append(b)
        size *= 2
    p, c = position.tolist(), price.tolist()
    f, by = [0] * n, [0] * n  # by: the cut before
    g = [0] * n  # f + p
    queue, head = [0], 0
    get = shorter.get
    for j in range(1, n):
        pj = p[j]
        while p[queue[head]] < pj - length:
            head += 1
        i = queue[head]
        least = g[i] + length - pj
        for k in get(j, ()):
            if f[k] + prices.short < least:
                i, least = k, f[k] + prices.short
        least += c[j]
        f[j], by[j] = least, i
        least += pj
        g[j] = least
        while len(queue) > head and g[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    j = n - 1
    if not last:
        near = max(1, int(np.searchsorted(position, total - length, side="right")))
        j = min(range(near, n), key=lambda k: (f[k], -k))
    out = [p[j]]
    while j:
        j = by[j]
        out.append(p[j])
    return out[::-1]


class Stream:
    """A task's documents, of which whole sequences are taken off the front."""

    def __init__(self, is_end: np.ndarray, prices: Prices):
        self.is_end, self.prices = is_end, prices
        self.ids, self.sequences = np.zeros(0, np.uint32), 0
        #: doc_id, all ids, ids before those held, place of the first one held
        self.docs: list[tuple[int | None, int, int, int]] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> None:
        base = len(self.ids)
        self.docs += [(d, b - a, 0, base + a) for d, a, b in zip(doc_ids, starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        self.ids = np.concatenate([self.ids, ids])

    def take(self, part: int, last: bool) -> pa.RecordBatch:
        """The pieces of the sequences that are settled: all, if these are the last documents."""
        starts = np.array([d[3] for d in self.docs], np.int64)
        ends = np.append(starts[1:], len(self.ids))
        at, price = places(len(self.ids), ends, np.flatnonzero(self.is_end[self.ids]) + 1, self.prices, last)
        edges = np.array(cuts(at, price, self.prices, last), np.int64)
        done = int(edges[-1])
        begins = np.union1d(starts[starts < done], edges[:-1])
        doc, sequence = np.searchsorted(starts, begins, side="right") - 1, np.searchsorted(edges, begins, side="right") - 1
        held = np.array([(d[1], d[2]) for d in self.docs], np.int64)
        stops = np.append(begins[1:], done)
        columns = {
            "doc_id": pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
            "start": pa.array(held[doc, 1] + begins - starts[doc]),
            "length": pa.array(stops - begins),
            "ids": pa.array([self.ids[a:b].astype("<u4").tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], pa.binary()),
            "doc_tokens": pa.array(held[doc, 0]),
            "sequence_id": pa.array((part << 40) + self.sequences + sequence),
            "offset": pa.array(begins - edges[sequence]),
        }
        self.sequences += len(edges) - 1
        first = int(np.searchsorted(ends, done, side="right"))
        self.docs = [(d, n, before + max(0, done - s), max(0, s - done)) for d, n, before, s in self.docs[first:]]
        self.ids = self.ids[done:]
        return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, prices: Prices | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian u32), doc_tokens, sequence_id, offset of every piece of the documents of docs (doc_id, text).

    A document is the ids of its text and end_id (null and empty texts: end_id alone). Rows keep the order in which the table stores them, each is a document, those with
    null or repeated doc_ids too. start counts the document's ids before the piece, offset those of the sequence. sequence_id is the task's number and a running
    number. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prices = prices or Prices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids.load(tokenizer), TaskContext.get().partitionId()
        stream = Stream(sentence_ends(tokenizer), prices)
        for batch in steps(batches, "text", TEXT_BYTES):
            ids, starts = words.encode(batch.column("text"))
            ids, starts = np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            while at < len(doc_ids):
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + block_ids)))
                to = min(to, len(doc_ids))
                stream.add(doc_ids[at:to], ids[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
                at = to
                if len(stream.ids) >= block_ids:
                    yield stream.take(part, False)
        if len(stream.ids):
            yield stream.take(part, True)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
