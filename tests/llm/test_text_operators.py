"""Operators on documents against brute force, and their results in odd cases."""

import base64
import hashlib
import itertools
import math
import random
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import bpe_tree, lang_nb, license_scan, quality_mil, queries, simhash_pivot, spaced_seed
from fleetlens.llm.components import components, forest
from tests.llm.conftest import DOCS, EDGES, LONG, rows_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_bpe():
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = plain_bpe()


def least_reached(pairs, ids):
    a, b = forest(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    return {i: i for i in ids} | dict(zip(a.tolist(), b.tolist(), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab eé'tSsl1\n\t ., \u0085\x1c漢字ß!")), max_size=80), st.integers(1, 7))
def test_tree_encodes_as_whole(text, leaf):
    bpe = bpe_tree.load(RANKS, public_tokenizers.PATTERN, leaf)
    ids = bpe.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_tree_on_long_runs_without_stable_places():
    bpe = bpe_tree.load(RANKS, public_tokenizers.PATTERN, 50)
    for text in ("x" * 3000, " " * 3000, "ab1" * 1000, "a\n" * 1500, LONG[:9000]):
        assert bpe.encode(text) == PLAIN.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_op3_on_documents(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries.op3_bpe_tree(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(doc["text"] or "")
        got = found[doc["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_bpe_edges(edges, nothing):
    both = bpe_tree.round_trip(edges, RANKS, public_tokenizers.PATTERN, ["doc_id", "source"]).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"])) for r in both) == sorted((i is None, i or 0, (t or "").encode()) for i, t, _ in EDGES)
    encoded = bpe_tree.encode(edges, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    again = bpe_tree.decode(encoded, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((t or "").encode() for _, t, _ in EDGES)
    assert bpe_tree.round_trip(nothing, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect() == []


def plain_fingerprint(text, words=3):
    import xxhash

    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    if not found:
        return 0
    n = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[k : k + n]), 42) for k in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def test_op5_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    low = least_reached(near, prints)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_pivots(spark, sf_dir).collect()}
    assert got == {(i, f"{f:016x}", low[i]) for i, f in prints.items()}


@pytest.mark.parametrize(("radius", "hot"), [(3, 2048), (3, 4), (5, 6)])
def test_links_lose_no_component(spark, radius, hot):
    rng = random.Random(radius * 100 + hot)
    prints = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(6)}
    prints = [p & (2**64 - 1) for p in prints]
    near = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= radius]
    table = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "id long, fp0 long")
    links = simhash_pivot.links(table, radius, 1, hot)
    found = {r["id"]: r["component"] for r in components(links).collect()}
    want = least_reached(near, range(len(prints)))
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_edges(spark, edges, nothing):
    got = [(r["doc_id"], r["fp0"], r["component_id"]) for r in simhash_pivot.classes(edges).collect()]
    by_id = {i: c for i, _, c in got}
    assert len(got) == len(EDGES)
    assert (by_id[1], by_id[2], by_id[3], by_id[5], by_id[6], by_id[None]) == (1, 1, 1, 5, 5, None)
    assert simhash_pivot.classes(nothing).collect() == []


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 900)] + [(7, 7), (900, 3)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect()}
    want = least_reached(pairs, {x for p in pairs for x in p})
    assert found == {i: want[i] for i in found}
    assert set(found) == {x for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_masks_meet_every_overlap():
    for n in range(8, 21):
        for out in itertools.combinations(range(n), n - math.ceil(0.8 * n - 1e-9)):
            same = set(range(n)) - set(out)
            assert any(all(start + k in same for k in mask) for mask in spaced_seed.MASKS for start in range(n - mask[-1])), (n, out)


def plain_overlap(doc, item):
    size, best = min(20, len(item)), 0
    for diagonal in range(-len(item) + 1, len(doc)):
        same = [0 <= k + diagonal < len(doc) and doc[k + diagonal] == item[k] for k in range(len(item))]
        inside = [0 <= k + diagonal < len(doc) for k in range(len(item))]
        for k in range(len(item) - size + 1):
            if all(inside[k : k + size]) and sum(same[k : k + size]) >= 0.8 * size - 1e-9:
                best = 1
    return best


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    items = [[rng.choice(words) for _ in range(n)] for n in (8, 15, 20, 30, 50, 50)]
    docs = []
    for k in range(60):
        doc = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        item = rng.choice(items)
        part = [rng.choice(words) if rng.random() < (k % 5) * 0.07 else w for w in item[rng.randrange(0, 6) :]]
        docs.append(doc[: len(doc) // 2] + part + doc[len(doc) // 2 :])
    texts = spark.createDataFrame([(i, " ".join(d).title() + ".") for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(d)) for i, d in enumerate(items)], "item_id long, text string")
    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if plain_overlap(d, item)}
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.overlaps(texts, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.overlaps(texts, bench, block_chars=200).collect()} == want
    assert 10 < len(want) < 60


def test_masks_of_short_items_meet_every_overlap():
    for n in range(1, 8):
        for out in itertools.combinations(range(n), n - math.ceil(0.8 * n - 1e-9)):
            assert any(not set(mask) & set(out) for mask in spaced_seed.masks_of(n)), (n, out)


def test_short_items_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    items = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 6, 6, 7, 7)]
    docs = [[rng.choice(words) for _ in range(rng.randrange(0, 9))] for _ in range(80)]
    for k in range(160):
        part = list(items[k % len(items)])
        if k // 10 % 3:
            part[rng.randrange(len(part))] = rng.choice(words)
        docs[k % 80] += part + [rng.choice(words)] * (k % 3)
    texts = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(items)], "item_id long, text string")
    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if plain_overlap(d, item)}
    assert {j for _, j in want} == set(range(len(items)))
    for chars in (spaced_seed.BLOCK_CHARS, 60):
        assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.overlaps(texts, bench, block_chars=chars).collect()} == want


def test_overlaps_in_unspaced_scripts(spark):
    han = "".join(chr(0x4E00 + 7 * k) for k in range(40))
    docs = [(1, "前" + han + "後"), (2, han[:20]), (3, han[:15] + "x"), (4, han[:9] + "一" + han[10:30]), (5, "ก" + han[::2])]
    found = spaced_seed.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, han)], "item_id long, text string"))
    assert {(r["doc_id"], r["doc_start"], r["n_words"], r["n_same"]) for r in found.collect()} == {(1, 1, 40, 40), (2, 0, 20, 20), (4, 0, 30, 29)}
    assert len(spaced_seed.words("漢字ab c_d")) == 5


def test_repeated_items_share_one_entry(spark):
    bench = spark.createDataFrame([(i, "one two three four five six seven eight nine") for i in range(50)] + [(99, "One, two three four five six seven eight nine!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, "something else")], "doc_id long, text string")
    found = spaced_seed.overlaps(docs, bench).collect()
    assert sorted(r["item_id"] for r in found) == [*range(50), 99]
    assert {r["doc_id"] for r in found} == {1}
    assert len(spaced_seed.block([("a", "x y"), ("b", "X, y"), ("c", None)]).keys) == 1


def test_overlap_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, LONG[:200]), (4, LONG[:200]), (None, LONG[:200])], "item_id long, text string")
    found = spaced_seed.overlaps(edges, bench).collect()
    assert {r["doc_id"] for r in found} == {4}
    assert sorted((r["item_id"] is None, r["item_id"] or 0) for r in found) == [(False, 4), (False, 4), (True, 0)]
    assert spaced_seed.overlaps(nothing, bench).collect() == [] == spaced_seed.overlaps(edges, bench.limit(0)).collect()


def test_op8_on_documents(spark, sf_dir):
    found = queries.op8_language_nb(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 20
    assert right >= 0.97 * n


def test_naive_bayes_against_counting(spark):
    texts = [("aab", "x"), ("abc", "x"), ("ccb", "y"), ("b b", "y"), (None, "x"), ("zzz", None)]
    model = lang_nb.fit(spark.createDataFrame(texts, "text string, lang string"))
    assert model.langs == ["x", "y"]
    logs = {}
    for lang in "xy":
        own = [b for t, k in texts if t and k == lang for b in lang_nb.buckets(t).tolist()]
        logs[lang] = math.log(0.5) + sum(math.log((own.count(b) + 0.5) / (len(own) + 0.5 * lang_nb.BUCKETS)) for b in lang_nb.buckets("abab").tolist())
    (lang,), (score,) = lang_nb.score_batch(model, ["abab"])
    assert lang == max(logs, key=logs.get)
    assert score == pytest.approx(1 / (1 + math.exp(min(logs.values()) - max(logs.values()))))


def test_language_edges(spark, edges, nothing):
    got = {r["doc_id"]: r for r in lang_nb.identify(edges).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 8))
    assert got[4]["lang_pred"] == "en"
    assert lang_nb.identify(nothing).collect() == []
    untaught = lang_nb.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.standard_normal((n, quality_mil.WIDTH)) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    shapes = {"w": (quality_mil.WIDTH, quality_mil.HIDDEN), "w0": (quality_mil.HIDDEN,), "v": (quality_mil.HIDDEN, quality_mil.GATES), "u": (quality_mil.HIDDEN, quality_mil.GATES), "a": (quality_mil.GATES,), "c": (quality_mil.HIDDEN,), "c0": (1,)}
    p = {k: rng.standard_normal(s) * 0.2 for k, s in shapes.items()}

    def loss():
        out = 0.0
        for bag, y in zip(bags, labels, strict=True):
            s = quality_mil.Model(0.0, 1.0, p, 0.0).score(iter([bag]))
            out -= (y * math.log(s) + (1 - y) * math.log(1 - s)) / len(bags)
        return out

    grads = quality_mil._gradients(p, bags, labels)
    for name, g in grads.items():
        at = tuple(0 for _ in g.shape)
        keep = p[name][at]
        p[name][at] = keep + 1e-5
        up = loss()
        p[name][at] = keep - 1e-5
        down = loss()
        p[name][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_score_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    text = "\n".join("Some plain words here, " * rng.integers(1, 40) for _ in range(50))
    bags = [np.concatenate(list(quality_mil.encode(t))) for t in (text, "LOUD!! WORDS!!", "more plain text", "%%% *** %%%")]
    model = quality_mil.train(bags, np.array([1.0, 0.0, 1.0, 0.0]), 0.5)
    whole = model.score(quality_mil.encode(text))
    monkeypatch.setattr(quality_mil, "BLOCK_PASSAGES", 7)
    assert model.score(quality_mil.encode(text)) == pytest.approx(whole, abs=1e-4)


def test_op6_on_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op6_attention_mil(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    right, n = found.selectExpr("sum(int(quality = predicted))", "count(*)").first()
    assert n > 80
    assert right >= 0.95 * n


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (8, 0), (9, 0), (9, 1), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality_mil.classify(edges, labels).collect()
    assert len(got) == len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_mil.classify(nothing, labels).collect() == []
    assert {r["score"] for r in quality_mil.classify(edges, labels.limit(0)).collect()} == {0.5}


def test_licenses_against_brute_force(spark):
    rng = random.Random(3)
    units = ["All rights reserved", "all rights all rights reserved", "", "word", "the of and to"]
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        for share in (0, 0.05, 0.15, 0.3):
            units.append(" ".join(w for w in words if rng.random() >= share))
            units.append(" ".join(w if rng.random() >= share else "other" for w in words) + "  more!" * rng.randrange(3))
    found = {(r["doc_id"], r["template"], round(r["dice"], 9)) for r in license_scan.scan(spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")).filter("unit <> 'span'").collect()}
    want = set()
    for i, unit in enumerate(units):
        best = None
        for k, t in enumerate(license_scan.TEMPLATES):
            a, b = (list(itertools.pairwise(license_scan._words(x))) for x in (unit, t.text))
            if a and b:
                dice = 2 * sum(min(a.count(p), b.count(p)) for p in set(a)) / (len(a) + len(b))
                if dice >= 0.8 and (best is None or dice > best[1]):
                    best = (k, dice)
        if best:
            want.add((i, best[0], round(best[1], 9)))
    assert found == want
    assert len(want) > 60


def best_spans(text):
    """Windows of as many words as a template that reach 0.8, less those that overlap a better one."""
    words, found = license_scan._words(text), []
    for k, t in enumerate(license_scan.TEMPLATES):
        pairs = list(itertools.pairwise(license_scan._words(t.text)))
        every = list(itertools.pairwise(words))
        for at in range(len(every)):
            window = every[at : at + len(pairs)]
            common = sum(min(window.count(p), pairs.count(p)) for p in set(window))
            if every[at] in pairs and 2 * common / (len(window) + len(pairs)) >= 0.8:
                found.append((2 * common / (len(window) + len(pairs)), -k, -at, len(window)))
    return {(-k, -at, round(d, 9)) for d, k, at, n in found if not any((e, j, b) > (d, k, at) and -b <= -at + n and -at <= -b + m for e, j, b, m in found)}


def test_notices_in_running_text(spark):
    rng = random.Random(9)
    plain = "the of and to work license software under all this is a permission notice terms version".split()
    texts = ["Copyright 2020 X. All rights reserved. More words.", "All rights", "all rights reserved all rights reserved"]
    for t in license_scan.TEMPLATES:
        for share in (0, 0.04, 0.1):
            around = [" ".join(rng.choice(plain) for _ in range(rng.randrange(4, 40))) for _ in range(2)]
            notice = " ".join(w if rng.random() >= share else "other" for w in t.text.split())
            texts.append(around[0] + (" ", "\n", ". ")[rng.randrange(3)] + notice.replace(" ", "\n", rng.randrange(2)) + " " + around[1])
    texts.append(" ".join(t.text + " some words between" for t in license_scan.TEMPLATES))
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    units, got = {}, {}
    for r in rows:
        if r["unit"] == "span":
            got.setdefault(r["doc_id"], set()).add((r["template"], r["unit_no"], round(r["dice"], 9)))
        else:
            units.setdefault(r["doc_id"], set()).add(r["license"])
    for i, text in enumerate(texts):
        if i not in units:
            assert got.get(i, set()) == best_spans(text), text
    assert all(got.get(i) or units.get(i) for i in range(3, len(texts), 3))  # those without edits
    assert len([i for i in range(3, len(texts)) if got.get(i) or units.get(i)]) >= 0.8 * len(texts)
    assert {license_scan.TEMPLATES[k].license for k, _, _ in got[len(texts) - 1]} == {t.license for t in license_scan.TEMPLATES}


def test_clauses_of_whole_licences(spark):
    """A licence wrapped at 72 columns, its paragraphs apart (paragraphs and lines) or all in one line (spans): every clause is found."""
    clauses = {}
    for k, t in enumerate(license_scan.TEMPLATES):
        if t.license in ("BSD", "ISC", "MIT") and len(t.text.split()) > 15:
            clauses.setdefault(t.license, []).append((k, t.text))
    assert {x: len(c) for x, c in clauses.items()} == {"BSD": 6, "ISC": 2, "MIT": 3}
    apart = [(x, "Copyright (c) 2024 Somebody\n\n" + "\n\n".join(textwrap.fill(f"{n}. {text}", 72, initial_indent=" * ", subsequent_indent=" * ") for n, (_, text) in enumerate(c))) for x, c in clauses.items()]
    running = [(x, "some words of prose " + " some words between ".join(text.lower() for _, text in c) + " and more words") for x, c in clauses.items()]
    rows = [(i, text) for i, (_, text) in enumerate(apart + running)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add((r["unit"], r["template"]))
    for i, (x, _) in enumerate(apart + running):
        found = {k for unit, k in got[i] if (unit == "span") == (i >= len(apart))}
        assert found == {k for k, _ in clauses[x]}, (i, x)


def test_license_edges(spark, edges, nothing):
    mit = license_scan.TEMPLATES[19].text
    wrapped = mit[:200].rsplit(" ", 1)[0] + "\n" + mit[len(mit[:200].rsplit(" ", 1)[0]) + 1 :]
    docs = spark.createDataFrame(rows_of([*EDGES, (20, f"intro text\n\n{wrapped}\n\nmore", "en"), (21, "All rights reserved.", "en"), (21, "All rights reserved.", "en")]), DOCS)
    found = [(r["doc_id"], r["unit"], r["unit_no"], r["license"]) for r in license_scan.scan(docs).collect()]
    assert sorted(found) == [(20, "paragraph", 1, "MIT"), (21, "line", 0, "Proprietary"), (21, "line", 0, "Proprietary")]
    assert license_scan.scan(nothing).collect() == []
