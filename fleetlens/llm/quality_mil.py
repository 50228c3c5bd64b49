"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, cut after PASSAGE_CHARS). Every passage is encoded; gated attention, learned from labels of whole
documents, says how much each counts; the weighted mean of the encodings is scored. Scoring reads whole texts, a block of passages at a
time with a running softmax, so memory does not grow with a text.

The model is fitted on the driver from at most FIT_DOCS labelled documents (half of each label, taken in the order of a hash of the id) of at most
FIT_CHARS characters and FIT_PASSAGES passages each (of more passages, so many evenly spread); the score is corrected for the share of the labels. These
bounds hold for fitting alone.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import crc_bucket, steps

PASSAGE_CHARS = 400
BLOCK_PASSAGES = 1000
FIT_DOCS = 4000
FIT_CHARS = 200_000
FIT_PASSAGES = 128
SHAPES, PAIRS, DENSE = 256, 128, 8
WIDTH = SHAPES + PAIRS + DENSE
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 16, 12, 64, 0.003, 1e-4, 7

LOWER, UPPER, LETTER, DIGIT, SPACE, SIGN = range(6)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every character below 65536: letters by case, digits, white space, and ten groups of signs."""
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": LETTER, "Lo": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
    return np.array([SPACE if c in (9, 10, 11, 12, 13) else kinds.get(unicodedata.category(chr(c)), SIGN + c % 10) for c in range(65536)], np.uint8)


def passages(text: str) -> list[tuple[int, int]]:
    """Start and end of every passage that is not blank."""
    out, start = [], 0
    for line in text.split("\n"):
        end = start + len(line)
        out += [(a, min(a + PASSAGE_CHARS, end)) for a in range(start, end, PASSAGE_CHARS) if not text[a : min(a + PASSAGE_CHARS, end)].isspace()]
        start = end + 1
    return out


def encode(text: str | None) -> Iterator[np.ndarray]:
    """Features of all passages of a text, in blocks; a text without passages has one row of zeros."""
    text = text or ""
    spans = passages(text)
    if not spans:
        yield np.zeros((1, WIDTH), np.float32)
    for k in range(0, len(spans), BLOCK_PASSAGES):
        yield _features(text, spans[k : k + BLOCK_PASSAGES])


def _features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    n, base = len(spans), spans[0][0]
    points = np.frombuffer(text[base : spans[-1][1]].encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[np.minimum(points, 65535)].astype(np.int64)
    starts = np.array([a - base for a, _ in spans])
    sizes = np.array([b - a for a, b in spans])
    of = np.repeat(np.arange(n), np.diff(np.append(starts, len(points))))
    inside = np.arange(len(points)) - starts[of] < sizes[of]  # not the signs between passages
    shape = (kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:]) * 2654435761 % 4294967296 * SHAPES >> 32
    pair = (points[:-1].astype(np.int64) * 65599 + points[1:]) * 2654435761 % 4294967296 * PAIRS >> 32

    def counts(values: np.ndarray, width: int, span: int) -> np.ndarray:
        own = (of[: len(values)] == of[span:]) & inside[span:]
        return np.bincount((of[: len(values)] * width + values)[own], minlength=n * width).reshape(n, width) / sizes[:, None]

    out = np.empty((n, WIDTH), np.float32)
    out[:, :SHAPES], out[:, SHAPES : SHAPES + PAIRS] = np.sqrt(counts(shape, SHAPES, 2)), np.sqrt(counts(pair, PAIRS, 1))
    share = counts(kinds, 16, 0)
    dense = out[:, SHAPES + PAIRS :]
    dense[:, 0], dense[:, 1], dense[:, 2], dense[:, 3] = share[:, UPPER], share[:, DIGIT], share[:, SPACE], share[:, SIGN:].sum(axis=1)
    dense[:, 4] = np.log1p(sizes)
    for i, (a, b) in enumerate(spans):
        words = text[a:b].split()
        many = max(1, len(words))
        dense[i, 5] = len(set(words)) / many
        dense[i, 6] = sum(x == y for x, y in zip(words, words[1:], strict=False)) / many
        dense[i, 7] = (b - a) / many / 10
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    shift: float
    constant: float | None = None

    def score(self, blocks: Iterator[np.ndarray]) -> float:
        """Score of a document from the features of its passages, block by block."""
        if self.constant is not None:
            return self.constant
        top, total, sums = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in blocks:
            h, _, _, attention = _forward(self.p, (x - self.mean) * self.scale)
            new = max(top, float(attention.max()))
            weight = np.exp(attention - new)
            old = np.exp(top - new)
            total, sums, top = total * old + float(weight.sum()), sums * old + weight @ h, new
        return float(_sigmoid(sums / total @ self.p["c"] + self.p["c0"][0] + self.shift))


def _forward(p, x):
    h = np.tanh(x @ p["w"] + p["w0"])
    v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    return h, v, u, (v * u) @ p["a"]


def train(bags: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """Fit to bags of passages and labels 0 and 1. share: of label 1 among all labelled documents. With one label only, the score is that share."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, 0.0, float(share))
    rng = np.random.default_rng(SEED)
    rows = sum(map(len, bags))
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / rows
    spread = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / rows)
    mean, scale = mean.astype(np.float32), (1 / (spread + 0.05)).astype(np.float32)
    shapes = {"w": (WIDTH, HIDDEN), "w0": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "c0": (1,)}
    p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) * (k not in ("w0", "c0"))).astype(np.float32) for k, s in shapes.items()}
    first, second, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            grads = _gradients(p, [(bags[i] - mean) * scale for i in own], labels[own])
            step += 1
            for name, g in grads.items():
                g += DECAY * p[name]
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                p[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    fitted, share = float(labels.mean()), min(max(share, 1e-6), 1 - 1e-6)
    return Model(mean, scale, p, float(np.log(share / (1 - share)) - np.log(fitted / (1 - fitted))))


def _gradients(p, bags, labels):
    sizes = np.array([len(b) for b in bags])
    starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    x = np.concatenate(bags)
    h, v, u, attention = _forward(p, x)
    weight = np.exp(attention - np.maximum.reduceat(attention, starts)[of])
    weight /= np.add.reduceat(weight, starts)[of]
    z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
    d_logit = (_sigmoid(z @ p["c"] + p["c0"][0]) - labels) / len(bags)
    d_z = d_logit[:, None] * p["c"]
    d_weight = (d_z[of] * h).sum(axis=1)
    d_attention = weight * (d_weight - np.add.reduceat(weight * d_weight, starts)[of])
    d_gate = d_attention[:, None] * p["a"]
    d_v, d_u = d_gate * u * (1 - v * v), d_gate * v * u * (1 - u)
    d_h = weight[:, None] * d_z[of] + d_v @ p["v"].T + d_u @ p["u"].T
    d_pre = d_h * (1 - h * h)
    return {"w": x.T @ d_pre, "w0": d_pre.sum(axis=0), "v": h.T @ d_v, "u": h.T @ d_u, "a": (v * u).T @ d_attention, "c": z.T @ d_logit, "c0": np.array([d_logit.sum()])}


def _spread(bag: np.ndarray) -> np.ndarray:
    return bag if len(bag) <= FIT_PASSAGES else bag[np.linspace(0, len(bag) - 1, FIT_PASSAGES).astype(np.int64)]


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, quality 0 or 1). Documents with both labels, and null labels, teach nothing; of repeated ids the
    text that is last in order counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.empty(0), 0.5)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("label = 0").orderBy(*order).limit(fit_docs // 2).union(known.filter("label = 1").orderBy(*order).limit(fit_docs // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= fit_chars)
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = [_spread(np.concatenate(list(encode(t)))).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "bag"])

    found = sorted((r["doc_id"], r["label"], r["bag"]) for r in rows.mapInArrow(run, "doc_id long, label int, bag binary").collect())
    bags = [np.frombuffer(bag, np.float16).reshape(-1, WIDTH) for _, _, bag in found]  # half precision until a batch needs them
    return train(bags, np.array([label for _, label, _ in found], np.float32), counts.get(1, 0) / sum(counts.values()))


def predict(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """Columns `keep` (none named score or predicted) of every row, with score (0 to 1) and predicted (1 from 0.5 on). Reads only the column text."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            scores = np.array([shared.value.score(encode(t)) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["kept", "score", "predicted"])

    out = T.StructType([rows.schema["kept"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, out).select("kept.*", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text). Learns from rows whose crc32(doc_id) mod `folds` is not `held_out`.

    Null and empty texts are bags of one blank passage. Without labels every score is 0.5. An empty table gives no rows.
    """
    is_held = crc_bucket("doc_id", folds) == held_out
    model = fit(docs.filter(~is_held), labels.filter(~is_held))
    return predict(docs, model, [F.col("doc_id"), is_held.alias("held_out")])
