"""Byte-level BPE as a reduction of a tree: halves are encoded by themselves and joined at their boundary.

The tokenizer splits text into matches of a pattern and merges within each match. In a place where a character that is no white space
is followed by white space, every alternative of the pattern ends and none looks back, so encode(a + b) = encode(a) + encode(b) there:
such a place is stable. To join two neighbours, the text between a stable place left of the boundary and one right of it is encoded
again; if the window holds none, it grows (at the ends of the two texts it stops). All tokens outside the window stay as they are.
The operation is associative with the empty text as unit, so the shape of the tree does not matter. Decoding concatenates bytes up a
tree. A text lies in one row and is worked through in one task; rows need no shuffle.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import steps

LEAF_CHARS = 2048
LEAF_IDS = 4096
WINDOW = 32

_STABLE = re.compile(r"[^\s\x1c-\x1f\x85](?= )")


class TreeBpe:
    def __init__(self, vocabulary: bytes, pattern: str, leaf_chars: int = LEAF_CHARS):
        """vocabulary: a rank file, lines of a token in base64 and its rank."""
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.token = {rank: token for token, rank in ranks.items()}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leaf_chars = max(1, leaf_chars)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Encoding of text[start:end] from those of its parts; text[start:middle] and text[middle:end]."""
        size, a, b = WINDOW, start, end
        while middle - size > start:
            if places := [m.end() for m in _STABLE.finditer(text, middle - size, middle)]:
                a = places[0]
                break
            size *= 2
        size = WINDOW
        while middle + size < end:
            if place := _STABLE.search(text, middle, middle + size + 1):
                b = place.end()
                break
            size *= 2
        drop = self._count(reversed(left), len(text[a:middle].encode()))
        skip = self._count(right, len(text[middle:b].encode()))
        return left[: len(left) - drop] + self.leaf(text[a:b]) + right[skip:]

    def _count(self, ids, size: int) -> int:
        """How many of the next tokens have `size` bytes together."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.token[i])
            n += 1
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.token[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeBpe:
    """The tokenizer of a rank file that every machine has at this path; one for each worker."""
    with open(path, "rb") as f:
        return TreeBpe(f.read(), pattern, leaf_chars)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str | Column], leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Columns `keep` (none named ids) of every row, with ids (array<int>): the tokens of the whole text. Null texts count as empty: no ids."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, leaf_chars)
        for batch in steps(batches, "text"):
            ids = pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), ids], ["kept", "ids"])

    out = T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, out).select("kept.*", "ids")


def decode(tokens: DataFrame, path: str, pattern: str, keep: list[str | Column]) -> DataFrame:
    """Columns `keep` of every row, with decoded (binary): the bytes of its ids. Null ids count as none; an unknown id is an error."""
    rows = tokens.select(F.struct(*keep).alias("kept"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([bpe.decode(i) for i in batch.column("ids").to_pylist()], pa.binary())], ["kept", "decoded"])

    out = T.StructType([rows.schema["kept"], T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, out).select("kept.*", "decoded")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str | Column], leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """encode() and decode() in one pass over the rows: columns `keep`, ids, decoded."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, leaf_chars)
        for batch in steps(batches, "text"):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            decoded = pa.array([bpe.decode(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(ids, pa.list_(pa.int32())), decoded], ["kept", "ids", "decoded"])

    out = T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, out).select("kept.*", "ids", "decoded")
