"""From raw documents to token ids: each stage reads what the stage before wrote and passes on what it keeps."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe_tree, lang_nb, quality_mil, simhash_pivot, spaced_seed
from fleetlens.llm.common import shared_dir, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose language is less sure than this go.
LEAST_LANGUAGE_SCORE = 0.5
#: Shorter overlaps, which only items of fewer words have, say little of a document.
LEAST_OVERLAP_WORDS = 6
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _whole(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) and those of no clear language go: of two about as likely, or such that no labelled
    language fits them as it fits its own texts (other languages, gibberish)."""
    model = lang_nb.fit(docs)
    return lang_nb.clear(docs, model, lang_nb.usual(docs, model), LEAST_LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, takes for bad go."""
    model = quality_mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.predict(docs, model, [_whole(docs)]).filter("predicted = 1").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links reach (fingerprints over shingles of simhash_pivot.WORDS words that differ in simhash_pivot.RADIUS bits or fewer) the one with
    the smallest doc_id stays; of rows with equal doc_id one. Rows with a null doc_id stay."""
    found = stored(simhash_pivot.classes(docs).select("doc_id", "component_id"), "copies")
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    # what is dropped grows with the documents: it is joined by a shuffle at every size, never broadcast
    known = docs.filter("doc_id IS NOT NULL").join(dropped.hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if not found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        known = known.dropDuplicates(["doc_id"])
    return known.union(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of six words or more, or a long part of one, go. Rows with a null doc_id stay."""
    found = spaced_seed.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.filter(F.col("n_words") >= LEAST_OVERLAP_WORDS).select("doc_id").distinct()
    return docs.join(stored(found, "contaminated"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; decoded_sha256 is the digest of the bytes they decode to."""
    both = bpe_tree.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokens),
]

#: Trained classifiers have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
