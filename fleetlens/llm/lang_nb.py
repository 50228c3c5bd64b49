"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text: each task adds up counts by language and bucket, and one aggregation joins
them. The matrix of log probabilities has at most MAX_LANGS x BUCKETS numbers whatever the corpus, so it is broadcast. Scoring takes,
for a batch of texts, the rows of the matrix at all their n-grams and sums them by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import crc_bucket, steps

ORDERS = (1, 2, 3)
BITS = 14
BUCKETS = 1 << BITS
#: More languages than this in the labels are an error: the model would no longer be a small thing.
MAX_LANGS = 1000
UNDETERMINED = "und"
SMOOTHING = 0.5
#: A text is not clearly of a language if it fits so many standard deviations worse than usual, or leads by less than this share of the usual lead.
SPREADS = 8.0
LEAST_LEAD = 0.25
#: Bytes of text measured at a time.
MEASURED_BYTES = 1_000_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text; none if it has no letter. Case, digits and signs do not count."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, hashed = [], np.zeros(len(points), np.uint64)
    for n, by in zip(range(1, max(ORDERS) + 1), _MULTIPLIERS, strict=True):
        hashed = hashed[: len(points) - n + 1] + points[n - 1 :] * by
        if n in ORDERS:
            mixed = hashed * _MULTIPLIERS[0]
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # BUCKETS x langs
    log_prior: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def flush():
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(row[at], docs[lang]), pa.int64())})
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = buckets(text)
            if not len(found):
                continue
            if lang not in counts and len(counts) >= 64:
                yield from flush()
            if lang not in counts:
                counts[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            counts[lang] += np.bincount(found, minlength=BUCKETS)
            docs[lang] += 1
    yield from flush()


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of (text, lang); rows with null lang or without letters teach nothing."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    lists = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("row")).limit(MAX_LANGS + 1).collect()
    if len(lists) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    lists.sort(key=lambda r: r["lang"])
    table, docs = np.full((BUCKETS, len(lists)), SMOOTHING), np.zeros(len(lists))
    for k, r in enumerate(lists):
        for bucket, n in r["row"]:
            if bucket < 0:
                docs[k] = n
            else:
                table[bucket, k] += n
    with np.errstate(divide="ignore"):
        return Model([r["lang"] for r in lists], np.log(table / table.sum(axis=0)), np.log(docs / max(1.0, docs.sum())))


@dataclass
class Usual:
    """What is usual among training texts of each language that are taken for it: fit (mean log probability of an n-gram), its variance, and lead (fit less
    that of the next language); and the variance of the log probability of one of its n-grams."""

    fit: dict[str, float]
    variance: dict[str, float]
    lead: dict[str, float]
    of_one: dict[str, float]


def score_batch(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior of each text. Equal scores go to the language first in the alphabet."""
    return measure_batch(model, texts)[:2]


def measure_batch(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float], list[int]]:
    """Language, posterior, fit, lead (see Usual) and number of n-grams of each text. The lead over no other language is infinite."""
    found = [buckets(t) for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    langs, scores, fits, leads = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    some = np.flatnonzero(sizes)
    if not len(some) or not model.langs:
        return langs, scores, fits, leads, sizes.tolist()
    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    at = np.concatenate([found[i] for i in some])
    sums = np.stack([np.add.reduceat(column[at], starts) for column in model.log_prob.T], axis=1)
    means = sums / sizes[some][:, None]
    logs = sums + model.log_prior
    logs -= logs.max(axis=1, keepdims=True)
    share = np.exp(logs)
    share /= share.sum(axis=1, keepdims=True)
    for row, i in enumerate(some):
        best = int(share[row].argmax())
        langs[i], scores[i], fits[i] = model.langs[best], float(share[row, best]), float(means[row, best])
        leads[i] = fits[i] - float(np.delete(means[row], best).max(initial=-np.inf))
    return langs, scores, fits, leads, sizes.tolist()


def usual(labelled: DataFrame, model: Model) -> Usual:
    """Measure all rows of (text, lang) that the model takes for their own language."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", MEASURED_BYTES):
            langs, _, fits, leads, _ = measure_batch(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(langs, pa.string()), pa.array(fits, pa.float64()), pa.array(leads, pa.float64())], ["lang", "lang_pred", "fit", "lead"])

    found = rows.mapInArrow(run, "lang string, lang_pred string, fit double, lead double").filter("lang = lang_pred").groupBy("lang")
    lists = found.agg(F.avg("fit").alias("fit"), F.var_pop("fit").alias("variance"), F.avg("lead").alias("lead")).collect()  # MAX_LANGS rows at most
    share = np.exp(model.log_prob)
    of_one = (share * model.log_prob**2).sum(axis=0) - (share * model.log_prob).sum(axis=0) ** 2
    return Usual(*[{r["lang"]: r[c] for r in lists} for c in ("fit", "variance", "lead")], dict(zip(model.langs, of_one.tolist(), strict=True)))


def least_fit(known: Usual, lang: str, n: int) -> float:
    """The worst fit that a text of n n-grams may have: SPREADS standard deviations under the usual, of texts among themselves and of n n-grams of this language; and never
    nearer to the fit of a text of random n-grams than to the usual."""
    # n-grams of all orders at a place come and go together
    spread = np.sqrt(known.variance[lang] + len(ORDERS) * known.of_one[lang] / n)
    return max(known.fit[lang] - SPREADS * spread, (known.fit[lang] - np.log(BUCKETS)) / 2)


def clear_batch(model: Model, known: Usual, texts: list[str | None], least: float = 0.0) -> list[bool]:
    """Which texts are of a language of the model and clearly so: they fit it as its own texts do, and better than the next language; the score is `least` or more."""
    langs, scores, fits, leads, sizes = measure_batch(model, texts)
    return [lang in known.fit and score >= least and fit >= least_fit(known, lang, n) and lead >= LEAST_LEAD * known.lead[lang] for lang, score, fit, lead, n in zip(langs, scores, fits, leads, sizes, strict=True)]


def clear(docs: DataFrame, model: Model, known: Usual, least: float = 0.0) -> DataFrame:
    """The rows of docs whose column text is clearly of a language of the model (see clear_batch), all columns kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", MEASURED_BYTES):
            passed = pa.array(clear_batch(*shared.value, batch.column("text").to_pylist(), least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("kept").filter(passed)], ["kept"])

    return rows.mapInArrow(run, T.StructType([rows.schema["kept"]])).select("kept.*")


def predict(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """Columns `keep` (none named lang_pred or score) of every row, with lang_pred and score. Reads only the column text.

    Null texts and texts without letters get `und` and 0.0; so does everything if nothing was learned.
    """
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            langs, scores = score_batch(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    out = T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).select("kept.*", "lang_pred", "score")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents (doc_id, text, lang).

    Learns from rows with a lang whose crc32(doc_id) mod `folds` is not `held_out`. Repeated rows are judged (and learned from) each.
    An empty table gives no rows.
    """
    is_held = crc_bucket("doc_id", folds) == held_out
    model = fit(docs.filter(~is_held))
    return predict(docs, model, [F.col("doc_id"), is_held.alias("held_out")])

