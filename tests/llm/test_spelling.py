"""Spelling variants against comparisons of all words."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetlens.llm import queries, spelling
from tests.llm.conftest import DOCS, rows_of

LETTERS = {chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))}


def brute_words(docs, drop_every=97):
    """Occurrences of every word, letter by letter."""
    found = Counter()
    for doc, text in docs:
        for run in "".join(c if c in LETTERS else " " for c in text or "").split(" "):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if word:
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                if drop_every and h % drop_every == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute_variants(n):
    """word: (form, root, n, links, form_n). Words are near that are equal, or lack the same letter, at one place."""
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
            holes[w[:k] + w[k + 1 :]].add(w)
        holes[w].add(w)
    near = {w: set() for w in n}
    for hole, words in holes.items():
        if "*" in hole:
            for w in words:
                near[w] |= words - {w}
        elif hole in n:
            for w in words - {hole}:
                near[w].add(hole), near[hole].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary():
    rng = random.Random(1)
    parts = ["th", "an", "er", "on", "re", "in", "ha", "é", "ÿst"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(900)} | {"a" * k for k in (5, 6, 7, 200, 201)})
    # chains of forms, and ties
    return {w: rng.choice([3, 4, 6, 8, 13, 30, 60, 120]) for w in words}


@pytest.mark.parametrize(("cell_words", "hot_rows"), [(4096, 1 << 17), (32, 1 << 17), (128, 150)])
def test_variants_are_those_of_all_pairs(spark, cell_words, hot_rows):
    n = vocabulary()
    want = brute_variants(n)
    assert result(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), cell_words, hot_rows)) == want
    assert sum(v[0] is not None for v in want.values()) > 50
    assert any(v[0] != v[1] for v in want.values() if v[0])


def test_op13_on_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_variants(brute_words(docs))
    assert len(want) > 1000
    assert result(queries.op13_spelling_kd(spark, sf_dir)) == want


def test_words_of_odd_texts(spark, edges, nothing):
    odd = [(1, "Naïve naïve NAÏVE Straße×÷ Straße×÷ straße×÷", "x"), (2, "日本語words日本語words日本語words 12words34", "x"), (None, "Ünlü" + "é" * 300 + " tail", None), (4, "Ünlü" + "é" * 300 + "!", None), (4, "Ünlü" + "é" * 300, None)]
    docs = spark.createDataFrame(rows_of(odd), DOCS).union(edges)
    for drop_every in (None, 97, 3):
        want = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()], drop_every)
        assert {r["word"]: r["n"] for r in spelling.count_words(docs, drop_every=drop_every).collect()} == want
    assert spelling.variants(spelling.count_words(nothing)).collect() == []


def test_cells_hold_what_an_edit_can_reach():
    rng = np.random.default_rng(2)
    points = rng.poisson(0.4, (400, spelling.AXES)).astype(np.int8)
    cuts = spelling.Cuts(points, 40)
    home = cuts.home(points)
    assert cuts.leaves > 30
    rows, leaf = cuts.reached(points, 1, 1)
    reached = set(zip(rows.tolist(), leaf.tolist(), strict=True))
    up = np.maximum(points[None].astype(int) - points[:, None], 0).sum(axis=2)
    close = (up <= 1) & (up.T <= 1)
    assert all((i, home[j]) in reached for i, j in np.argwhere(close).tolist())
    assert len(reached) < 400 * cuts.leaves
