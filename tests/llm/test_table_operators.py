"""Archive, URL filter, token files, embeddings and the pipeline against brute force, and their results in odd cases."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import dac_tokens, hnsw_dedup, lang_nb, quality_mil, queries, simhash_pivot, spaced_seed, url_reputation, warc_store, word_ids
from fleetlens.llm.common import shared_dir
from tests.llm.conftest import DOCS, EDGES, rows_of
from tests.llm.test_text_operators import PLAIN, least_reached

WORDS = public_tokenizers.path("word_bpe_49k.json")


def same_as_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = db.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, sf_dir, name):
    same_as_sql(spark, sf_dir, name)


PAGES = [(k, f"http://h{k % 3}.example.com/{k}\r\nX: y", ("<p>" + "a" * 1200) if k % 3 == 0 else f"<p>{k}" if k % 2 else "<i>short") for k in range(60)]
PAGES += [(100, None, None), (101, "", ""), (102, "http://é.example/ü", "é" * 600), (103, "u", "é" * 600), (102, "again", "é" * 600)]


def archive(spark, rows):
    out = shared_dir(spark, "test-warc")
    warc_store.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit("clash")), "page_id", "url", "html", out)
    return out


def test_archive_gives_back_every_record(spark):
    out = archive(spark, PAGES)
    got = sorted((r["id"], bytes(r["record"])) for r in warc_store.reconstruct(spark, out).collect())
    bodies = [(h or "").encode() for _, _, h in PAGES]
    last = {b: max(i for (i, _, _), c in zip(PAGES, bodies, strict=True) if c == b) for b in set(bodies) if len(b) >= 1000}
    assert len(got) == len(PAGES)
    want = {}
    for (i, _, _), body in zip(PAGES, bodies, strict=True):
        want[i] = b"" if last.get(body, i) != i else body
    for i, record in got:
        header, _, rest = record.partition(b"\r\n\r\n")
        lines = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:])
        assert header.startswith(b"WARC/1.1\r\n")
        assert rest == want[i] + b"\r\n\r\n"
        assert int(lines[b"Content-Length"]) == len(want[i])
    stored = [r["digest"] for r in spark.read.parquet(f"{out}/payloads").collect()]
    assert sorted(stored) == sorted({hashlib.sha256(b).hexdigest() for b in bodies})
    found = {r["id"]: (r["type"], r["refers_to"]) for r in warc_store.read(spark, out).collect()}
    assert found[0] == ("revisit", 57)
    assert found[57] == ("response", None)
    assert found[102] == ("revisit", 103)


def test_archive_without_ids_or_rows(spark):
    out = archive(spark, [(None, "a", "x" * 2000), (None, "b", "x" * 2000), (5, "c", "y"), (5, "d", "y"), (5, "e", "z")])
    got = sorted(bytes(r["record"]).partition(b"\r\n\r\n")[2] for r in warc_store.reconstruct(spark, out).collect())
    assert got == sorted(x + b"\r\n\r\n" for x in (b"x" * 2000, b"x" * 2000, b"y", b"y", b"z"))
    assert warc_store.reconstruct(spark, archive(spark, [])).collect() == []


def test_broken_payload_is_told(spark):
    out = archive(spark, PAGES[:3])
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{out}/payloads")
    with pytest.raises(PySparkException, match="does not have its digest"):
        warc_store.payloads(spark, out).collect()


URLS = ["http://WWW.Example.COM/en/1", "https://example.com/en/2?x", "http://a.b.example.com/en/", "http://com/x", "http://x.com", "http://x.com#/en/", "http://a.net/es/1", "ftp://a.net/esx", "no scheme", None, "", "http://notexample.com/en/", "http://h://k/l", "HTTP://É.NET/fr/", "http://good.org/a", "http://bad.org/a", "http://new.bad.org/a", "http://a.co.uk/x", "http://co.uk/x"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, mean double")
    outcomes = spark.createDataFrame([("http://good.org/", 1)] * 50 + [("http://bad.org/", 0)] * 50 + [("http://x.com/", None), (None, 1)], "url string, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, outcomes, queries.RULES).collect()}
    assert len(got) == len(URLS)
    want = ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", None, None, "net/es/", None, None, None, None, "com/", None, "net/fr/", None, None, None, None, None]
    assert [got[i]["rule"] for i in range(len(URLS))] == want
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/1")
    assert (got[12]["host"], got[12]["path"]) == ("h:", "//k/l")
    assert (got[13]["host"], got[8]["host"], got[8]["path"]) == ("É.net", "", "")
    assert [got[i]["verdict"] for i in (0, 1, 14, 15, 16)] == ["allow", "block", "allow", "block", "block"]
    assert got[15]["mean"] < got[16]["mean"] < got[14]["mean"]


def test_reputation_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    assert url_reputation.judge(pages, none, queries.RULES).collect() == []
    one = url_reputation.judge(spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string"), none, []).collect()
    assert [(r["rule"], r["verdict"], r["mean"]) for r in one] == [(None, "block", 0.5)] * 2
    assert one[0]["low"] < 0.5


def test_addressable_codes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 255, 511, 512, 513, 5000):
        ids = (2.0 ** (rng.random(n) * 31.9)).astype(np.uint32)
        docs, starts, dac = dac_tokens.unpack(dac_tokens.pack([7, None], [0, n // 2], ids))
        assert (docs, starts.tolist()) == ([7, None], [0, n // 2, n])
        assert dac.get(np.arange(n)).tolist() == ids.tolist()
        at = rng.integers(0, max(n, 1), 50 if n else 0)
        assert dac.get(at).tolist() == ids[at].tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert dac.slice(a, b).tolist() == ids[a:b].tolist()


def test_op7_on_documents(spark, sf_dir):
    tokenizer = Tokenizer.from_file(WORDS)
    found = {r["doc_id"]: r for r in queries.op7_dac_tokens(spark, sf_dir).collect()}
    start = 0
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 1]
        assert tuple(found[doc["doc_id"]]) == (doc["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_are_encoded_as_whole_texts():
    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(8)
    signs = list("aAbé'sStΣİß1９ \t\n\r.!\x1c\x85\u00a0\u2003\u0301漢<|>")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(500)] + ["<|endoftext|> x", "a<|startoftext|>b.", "<|EndOfText|>", "ΣΑΣ Σ. ς", "it's don't. I'LL!", "x" * 5000, None, ""]
    for _ in range(2):  # new words, and words seen before
        ids, starts = word_ids.load(WORDS).encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[starts[k] : starts[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_token_file_edges(spark, edges, nothing):
    out = shared_dir(spark, "test-dac")
    dac_tokens.write(edges, WORDS, out, segment_ids=50)
    rows = dac_tokens.read(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 8, 9]
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows[:-1])]
    assert [r["n_tokens"] for r in rows][1:4] == [1, 1, 1]
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    asked = [0, 5, len(every) - 1, len(every), -1, 5, None]
    at = dac_tokens.tokens_at(spark, out, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted((r["position"], r["id"]) for r in at if r["position"] is not None) == sorted((p, int(every[p]) if 0 <= p < len(every) else None) for p in asked if p is not None)
    assert len(at) == len(asked)
    empty = shared_dir(spark, "test-dac")
    dac_tokens.write(nothing, WORDS, empty)
    assert dac_tokens.read(spark, empty).collect() == []


def brute_links(vectors, least=0.9):
    v = np.array(vectors)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= least
    np.fill_diagonal(near, False)
    return near


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 16))
    vectors = [c + rng.standard_normal(16) * s for c in centres for s in (0, 0.05, 0.2, 0.35)]
    vectors += [centres[0] + rng.standard_normal(16) * 0.01 for _ in range(120)] + [centres[1]] * 30
    table = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id int, dim int, shard int")
    near = brute_links(vectors)
    low = least_reached(np.argwhere(near).tolist(), range(len(vectors)))
    got = {r["vec_id"]: r for r in hnsw_dedup.near_duplicates(table, shard_rows=120, query_rows=200).collect()}
    assert len(got) == len(vectors)
    found, all_links = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert 0.99 * all_links <= found <= all_links
    assert sum(got[i]["component_id"] == low[i] for i in low) >= 0.99 * len(low)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph.build(vectors.astype(np.float32), np.sort(hnsw_dedup.Graph.heights(1500, 1))[::-1])
    ids, _ = hnsw_dedup.Graph.unpack(graph.pack(), vectors.astype(np.float32)).search(vectors.astype(np.float32), 64)
    truth = np.argsort(-(vectors @ vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) > 0.9


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e300, 1e290]), (12, [0.0, 1e-300])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (11, 2, 1, False), (12, 0, 12, True), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted(want, key=str)
    assert hnsw_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = lang_nb.fit(docs)
    usual = lang_nb.usual(docs, model)
    kept = [i for i in text if lang_nb.score_batch(model, [text[i]])[1][0] >= 0.5 and lang_nb.clear_batch(model, usual, [text[i]])[0]]
    some = docs.filter(F.col("doc_id").isin(kept))
    judge = quality_mil.fit(some, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [i for i in kept if judge.score(quality_mil.encode(text[i])) >= 0.5]
    prints = {i: simhash_pivot.fingerprint(text[i].encode(), 3)[0] for i in kept}
    near = [(a, b) for a, b in itertools.combinations(kept, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    low = least_reached(near, kept)
    kept = [i for i in kept if low[i] == i]
    bench = spaced_seed.block([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    kept = [i for i in kept if not spaced_seed.overlaps_in(spaced_seed.words(text[i]), bench)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    assert 50 < len(kept) < len(text)
    for i in kept:
        assert got[i]["ids"] == PLAIN.encode_ordinary(text[i])
        assert got[i]["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()


def test_stages_keep_columns_and_stand_odd_rows(spark, sf_dir, nothing):
    docs = spark.createDataFrame(rows_of([*EDGES, (None, "another row without an id", "en")]), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        assert got.count() <= docs.count()
        assert stage(spark, nothing, sf_dir).collect() == [], name
    left = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()]
    assert sorted(left, key=str) == [1, 4, 5, 8, 9, None, None]
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()) == docs.count()
