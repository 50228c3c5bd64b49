"""Packing against all ways to cut, and its pieces against the library's ids."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def is_short(size, length):
    return size < length and size & (size - 1) == 0


def all_ways(position, price, prices, last):
    """The least cost of every place, from all places before it."""
    f = [0]
    for j in range(1, len(position)):
        ways = []
        for i in range(j):
            size = position[j] - position[i]
            if size <= prices.length:
                ways.append(f[i] + prices.length - size)
                if is_short(size, prices.length) and (size >= prices.least_short or last and position[j] >= position[-1] - 2 * prices.length):
                    ways.append(f[i] + prices.short)
        f.append(min(ways) + price[j])
    return f


def cost(found, position, price, prices):
    at, total = dict(zip(position, price, strict=True)), 0
    for a, b in zip(found, found[1:], strict=False):
        assert 0 < b - a <= prices.length
        total += at[b] + (min(prices.short, prices.length - b + a) if is_short(b - a, prices.length) else prices.length - b + a)
    return total


@pytest.mark.parametrize("last", [True, False])
def test_cuts_are_the_cheapest(last):
    rng = random.Random(3)
    for _ in range(150):
        prices = packing.Prices(length=rng.choice([16, 64, 30]), gap=rng.choice([3, 8]), least_short=rng.choice([4, 8]), sentence=2, word=rng.choice([3, 9]), short=rng.choice([0, 2]))
        total = rng.randint(1, 400)
        doc_ends = sorted({rng.randint(1, total) for _ in range(total // 40 + 1)} | {total})
        sentences = np.array(sorted({rng.randint(1, total) for _ in range(total // 10)}), np.int64)
        position, price = (x.tolist() for x in packing.places(total, np.array(doc_ends), sentences, prices, last))
        assert max(np.diff(position)) <= prices.gap
        assert set(doc_ends) <= {p for p, c in zip(position, price, strict=True) if c == 0}
        found, f = packing.cuts(np.array(position), np.array(price), prices, last), all_ways(position, price, prices, last)
        want = f[-1] if last else min(x for x, p in zip(f, position, strict=True) if p > max(0, total - prices.length))
        assert cost(found, position, price, prices) == want
        assert (found[0], found[-1] == total) == (0, True if last else found[-1] == total)


def check(docs, rows, length=packing.LENGTH):
    """Every id in one piece, sequences without gaps; returns ids and padding."""
    library = Tokenizer.from_file(WORDS)
    want = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs), key=str)
    sequences, texts = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    got = []
    for (doc, n), pieces in texts.items():
        ids = [i for _, part in sorted(pieces) for i in part]
        for k in range(0, len(ids), n):  # repeated rows come one after another
            got.append((doc, ids[k : k + n]))
        starts = sorted(s for s, _ in pieces)
        assert starts[0] == 0 and max(starts) < n
    unique = {str(x) for x in want}
    assert {str(x) for x in got} <= unique or len(got) != len(unique)
    assert sum(len(i) for _, i in got) == sum(len(i) for _, i in want)
    return sum(len(i) for _, i in want), padding


def test_pieces_hold_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    library = Tokenizer.from_file(WORDS)
    for block_ids in (packing.BLOCK_IDS, 5000):
        rows = packing.pack(docs, WORDS, block_ids=block_ids).collect()
        total, padding = check(texts, rows)
        assert padding <= 0.02 * total
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
        for doc, text in texts:
            pieces = sorted(by_doc[doc], key=lambda r: r["start"])
            assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
            ids = [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()]
            assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
            assert {r["doc_tokens"] for r in pieces} == {len(ids)}


def test_order_is_kept_within_a_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    rows = packing.pack(docs, WORDS).collect()
    stream = [(r["doc_id"], r["start"]) for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    order = {r["doc_id"]: k for k, r in enumerate(docs.select("doc_id").collect())}
    assert stream == sorted(stream, key=lambda x: (order[x[0]], x[1]))


def test_packing_edges(spark, edges, nothing):
    rows = packing.pack(edges, WORDS).collect()
    check([(r["doc_id"], r["text"]) for r in edges.collect()], rows)
    assert sorted((r["doc_id"] for r in rows if r["doc_tokens"] == 1), key=str) == [1, 2, 3]
    assert sum(r["doc_id"] is None for r in rows) >= 1
    assert packing.pack(nothing, WORDS).collect() == []
