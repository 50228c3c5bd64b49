"""The language stage against texts of no labelled language."""

import random

import corpus_pipeline
from fleetlens.llm import lang_nb

FOREIGN = ["Привет, как дела? Сегодня хорошая погода для прогулки по городу.", "今天天气很好，我们去公园散步，然后一起吃饭。", "Σήμερα ο καιρός είναι καλός και πάμε βόλτα στο πάρκο.", "asdf jkl qwer uiop zxcv asdfgh jkl qwe rty uio"]


def test_other_languages_and_gibberish_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (8, 40, 400)]
    half = {r["lang"]: r["text"][:3000] for r in docs.filter("length(text) BETWEEN 3000 AND 9000").orderBy("doc_id").collect()}
    strange = [*FOREIGN, *noise, *(f * 20 for f in FOREIGN), half["en"] + " " + " ".join(reversed(FOREIGN[0].split() * 40))]
    more = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(more), "").collect()}
    assert not [strange[i - 10_000_000][:40] for i in left if i >= 10_000_000]
    assert len(left) >= 0.99 * docs.count()


def test_short_texts_of_the_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_nb.fit(docs)
    known = lang_nb.usual(docs, model)
    cuts = [t for r in docs.filter("length(text) > 2000").orderBy("doc_id").limit(200).collect() if (t := r["text"][500:700])]
    assert sum(lang_nb.clear_batch(model, known, cuts)) >= 0.97 * len(cuts)
