"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found with k-d trees over letter counts.

A word is a point: how often it holds each letter. One edit moves it by little: between words of one length it takes a letter and gives another (an L1
distance of two), to the next length it gives one letter (a distance of one). So words are compared by pairs of lengths, L with L and L with L + 1.

On Spark the points of each length are cut into cells by a k-d tree, which a bounded sample of words lays out (it balances the cells, no more). A word lives
in one cell and visits the cells whose box its edits can reach: of its own length those with a higher number, and those of the next length. Inside a cell
two local trees are walked together, pairs of boxes too far apart are pruned, the points of what is left are compared, and of close points the order of
letters is verified. Each pair meets in exactly one cell. Tasks return a count and the best partner for each word, never pairs.

Cuts cannot part words of equal letters (anagrams). A cell that stays too large is divided exactly: of two words that one edit parts, the first halves
are equal or the second halves are, so its rows meet under each half.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import salts, steps, stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A word's form occurs so many times as often at least.
FORM_TIMES = 2
#: Words a cell is laid out for, rows beyond which it is divided, and words of the sample that lays out the cells (at least 16 of them for a cell).
CELL_WORDS = 4096
HOT_ROWS = 1 << 17
SAMPLE = 1 << 18
#: Points of a local leaf, and of one block of comparisons.
LEAF = 64
BLOCK = 1 << 23
#: Different words a counting task holds at a time.
HELD_WORDS = 300_000
SALTS = 8

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC0:] = True
#: Latin-1 bytes: A-Z lower-cased, other letters as they are, all else a space.
_RUNS = bytes((b | 32 if 0x41 <= b <= 0x5A else b) if _LETTER[b] else 32 for b in range(256))
#: The coordinate of a letter.
_AXIS = np.full(256, -1, np.int16)
_AXIS[0x61:0x7B] = np.arange(26)
_AXIS[0xC0:] = np.arange(26, 90)
AXES = 90

HOME, SAME, SHORTER = 0, 1, 2


def runs(text: str | None, least: int = 1) -> list[bytes]:
    """The maximal runs of letters of a text (Latin-1 bytes, A-Z lower-cased) that have `least` letters or more."""
    found = (text or "").encode("latin-1", "replace").translate(_RUNS).split()
    return found if least <= 1 else [w for w in found if len(w) >= least]


def _counter(least_length: int, drop_every: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in steps(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = runs(text, least_length)
                total.update(found)
                if drop_every:
                    before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
                        if h % drop_every:
                            continue
                        at = h % len(word)
                        total[word] -= n
                        if len(word) > least_length:
                            total[word[:at] + word[at + 1 :]] += n
                if len(total) > HELD_WORDS:
                    yield flush()
        yield flush()

    return count


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n) of the words of all texts of docs (doc_id, text) that have `least_length` letters and occur `least_count` times.

    Words are maximal runs of a-z, A-Z and À to ÿ, with A-Z lower-cased. With drop_every, misspellings are planted: a word loses one letter in documents
    where drop_every divides the crc32 of `<doc_id>:<word>` (a null doc_id is an empty text). Null and empty texts have no words, repeated rows count each, an
    empty table has none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(least_length, drop_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(1, least_count))


def letters(words: list[bytes], length: int) -> np.ndarray:
    """The letters of words of one length: a row for each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts: a row for each word, a column for each letter."""
    n, length = codes.shape
    flat = np.bincount((np.arange(n)[:, None] * AXES + _AXIS[codes]).ravel(), minlength=n * AXES)
    return flat.reshape(n, AXES).astype(np.int8 if length <= 120 else np.int32)


class Cuts:
    """The k-d tree that lays out the cells of one length: a node is a leaf number, or (axis, highest count of the left side, left, right)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.top = self._cut(sample, max(1, leaves))

    def _cut(self, sample: np.ndarray, leaves: int):
        if leaves > 1 and len(sample) > 1:
            best = (0, 0, 0)
            for axis in np.flatnonzero(sample.max(axis=0) != sample.min(axis=0)):
                below = np.cumsum(np.bincount(sample[:, axis]))[:-1]
                at = int(np.minimum(below, len(sample) - below).argmax())
                best = max(best, (int(min(below[at], len(sample) - below[at])), int(axis), at))
            if best[0]:
                _, axis, at = best
                low = sample[:, axis] <= at
                share = min(leaves - 1, max(1, round(leaves * low.mean())))
                return axis, at, self._cut(sample[low], share), self._cut(sample[~low], leaves - share)
        self.leaves += 1
        return self.leaves - 1

    def home(self, found: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, todo = np.zeros(len(found), np.int64), [(self.top, np.arange(len(found)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = found[rows, node[0]] <= node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out

    def reached(self, found: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for all leaves whose box a point can reach with `more` letters more and `less` letters less."""
        start = np.arange(len(found))
        todo, out = [(self.top, start, np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), {}, {})], []
        while todo:
            node, rows, up, down, low, high = todo.pop()
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node)))
                continue
            if not len(rows):
                continue
            axis, at, left, right = node
            x = found[rows, axis].astype(np.int64)
            # the left box ends at `at`, the right one begins behind it
            falls = down + np.maximum(0, x - at) - np.maximum(0, x - high.get(axis, 1 << 40))
            rises = up + np.maximum(0, at + 1 - x) - np.maximum(0, low.get(axis, -1) - x)
            ok = falls <= less
            todo.append((left, rows[ok], up[ok], falls[ok], low, high | {axis: at}))
            ok = rises <= more
            todo.append((right, rows[ok], rises[ok], down[ok], low | {axis: at + 1}, high))
        rows, leaf = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (start[:0], start[:0])
        return rows, leaf


def layout(words: DataFrame, cell_words: int = CELL_WORDS, sample: int = SAMPLE) -> dict[int, Cuts]:
    """Cells for words (word), by length, from `sample` words at most; lengths of which the sample has few words are one cell."""
    total = words.count()
    some = words.select("word") if total <= sample else words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(sample / total * 0.9 * (1 << 30)))
    by_length: dict[int, list[bytes]] = {}
    for row in some.limit(sample).toLocalIterator():
        by_length.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
    taken = sum(map(len, by_length.values()))
    cell = max(16.0, cell_words * taken / max(1, total))
    return {n: Cuts(points(letters(found, n)), round(len(found) / cell)) for n, found in by_length.items() if len(found) > cell}


_CELL = "cell long, kind int, part int, half string, word string, n long"


def _place(cuts: dict[int, Cuts]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                found = points(letters([words[i] for i in at], length))
                own, longer = cuts.get(length), cuts.get(length + 1)
                home = own.home(found) if own else np.zeros(len(at), np.int64)
                rows = [(np.arange(len(at)), home, length, HOME)]
                if own:
                    seen, leaf = own.reached(found, 1, 1)
                    rows.append((seen[leaf > home[seen]], leaf[leaf > home[seen]], length, SAME))
                rows.append((*(longer.reached(found, 1, 0) if longer else (np.arange(len(at)), np.zeros(len(at), np.int64))), length + 1, SHORTER))
                for who, leaf, cell_length, kind in rows:
                    if len(who):
                        size, text = len(who), [words[i].decode("latin-1") for i in at[who]]
                        yield pa.RecordBatch.from_arrays([pa.array((cell_length << 32) + leaf), pa.array(np.full(size, kind, np.int32)), pa.array(np.zeros(size, np.int32)), pa.array([""] * size), pa.array(text), pa.array(counts[at[who]])],
                                                         ["cell", "kind", "part", "half", "word", "n"])

    return place


def _halves() -> list:
    """How rows of a cell of words of length L meet again: parts 1 and 2 hold words of length L by their halves; 3 and 4 hold them with words one letter shorter."""
    length = F.shiftright("cell", 32).cast("int")
    half, short = F.floor(length / 2).cast("int"), F.floor((length - 1) / 2).cast("int")
    first = lambda n: F.expr("word").substr(F.lit(1), n)
    rest = lambda n: F.expr("word").substr(n + 1, F.length("word"))
    one = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("half"))
    same = [one(1, first(half)), one(2, rest(half))]
    home = F.array(*same, one(3, first(short)), one(4, rest(short + 1)))
    return F.when(F.col("kind") == HOME, home).when(F.col("kind") == SAME, F.array(*same)).otherwise(F.array(one(3, first(short)), one(4, rest(short))))


def marks(found: np.ndarray) -> np.ndarray:
    """Counts in unary, in 64 bits: see Boxes."""
    out = np.zeros(len(found), np.uint64)
    for axis in range(26):
        for least in (1, 2):
            out |= (found[:, axis] >= least).astype(np.uint64) << np.uint64(2 * axis + least - 1)
    other = found[:, 26:].sum(axis=1, dtype=np.int64)
    for least in range(1, 13):
        out |= (other >= least).astype(np.uint64) << np.uint64(51 + least)
    return out


class Boxes:
    """A balanced local k-d tree: the points in the order of its leaves, the boxes of the nodes of every level, and marks of the points.

    A mark holds counts in unary, two bits for each of a-z and twelve for all other letters together: marks of two points differ in as many bits as their
    distance, or fewer where counts are higher than the bits there are."""

    def __init__(self, found: np.ndarray):
        n = len(found)
        self.levels = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        order = np.arange(n)
        for level in range(self.levels):
            edges = self.edges(n, level)
            for a, b, mid in zip(edges[:-1], edges[1:], self.edges(n, level + 1)[1::2], strict=True):
                part = found[order[a:b]]
                axis = part.var(axis=0).argmax()
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)] if mid - a < b - a else order[a:b]
        self.order, self.found, self.marks = order, found[order], marks(found[order])
        self.low, self.high = [], []
        for level in range(self.levels + 1):
            starts = self.edges(n, level)[:-1]
            self.low.append(np.minimum.reduceat(self.found, starts, axis=0))
            self.high.append(np.maximum.reduceat(self.found, starts, axis=0))
        edges = self.edges(n, self.levels)
        self.starts, self.sizes = edges[:-1], np.diff(edges)

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level


def close(a: Boxes, b: Boxes, more: int, less: int, itself: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (row of a, row of b) where b holds exactly `more` letters that a has not, and lacks exactly `less`; each pair of rows once if both are one tree."""
    i = j = np.zeros(1, np.int64)
    for level in range(max(a.levels, b.levels)):
        down_a, down_b = level < a.levels, level < b.levels
        i, j = (np.repeat(x, 4 if down_a and down_b else 2) for x in (i, j))
        step = np.arange(len(i))
        if down_a:
            i = 2 * i + step % 2
        if down_b:
            j = 2 * j + (step // 2 % 2 if down_a else step % 2)
        if itself:
            i, j = i[i <= j], j[i <= j]
        la, lb, keep = min(level + 1, a.levels), min(level + 1, b.levels), []
        if not len(i):
            return
        width = max(1, BLOCK // a.found.shape[1])
        for k in range(0, len(i), width):
            x, y = i[k : k + width], j[k : k + width]
            up = np.maximum(b.low[lb][y] - a.high[la][x], 0).sum(axis=1, dtype=np.int32)
            down = np.maximum(a.low[la][x] - b.high[lb][y], 0).sum(axis=1, dtype=np.int32)
            keep.append((up <= more) & (down <= less))
        ok = np.concatenate(keep)
        i, j = i[ok], j[ok]
    wide_a, wide_b = int(a.sizes.max()), int(b.sizes.max())
    at = max(1, BLOCK // (4 * wide_a * wide_b))
    for k in range(0, len(i), at):
        x, y = i[k : k + at], j[k : k + at]
        rows_a = a.starts[x][:, None] + np.minimum(np.arange(wide_a), a.sizes[x][:, None] - 1)
        rows_b = b.starts[y][:, None] + np.minimum(np.arange(wide_b), b.sizes[y][:, None] - 1)
        p, q, r = np.nonzero(np.bitwise_count(a.marks[rows_a][:, :, None] ^ b.marks[rows_b][:, None, :]) <= more + less)
        ok = (q < a.sizes[x[p]]) & (r < b.sizes[y[p]])
        one, two = rows_a[p[ok], q[ok]], rows_b[p[ok], r[ok]]
        if itself:
            ok = one < two
            one, two = one[ok], two[ok]
        # letters gained less letters lost is the difference of the lengths, so the distance alone decides
        ok = np.abs(b.found[two] - a.found[one]).sum(axis=1, dtype=np.int32) == more + less
        yield a.order[one[ok]], b.order[two[ok]]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter was inserted into each short word, and how many first letters are equal."""
    n = short.shape[1]
    ahead = np.cumprod(short == long[:, :n], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= n, ahead


class _Best:
    """Links and the best partner (most frequent, then first in code-point order) of every row of one kind."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.rank = np.empty(len(words), np.int64)
        self.near, self.order, self.best = np.zeros(len(words), np.int64), None, None

    @staticmethod
    def ranked(*sides: _Best) -> None:
        """Number the rows of all sides by how good a partner they are."""
        every = sorted(((-int(n), w, s, k) for s, side in enumerate(sides) for k, (n, w) in enumerate(zip(side.counts, side.words, strict=True))))
        for rank, (_, _, s, k) in enumerate(every):
            sides[s].rank[k] = rank
        order = [(w, -n) for n, w, _, _ in every]
        for side in sides:
            side.order, side.best = order, np.full(len(side.words), len(order), np.int64)

    def add(self, own: np.ndarray, ranks: np.ndarray) -> None:
        self.near += np.bincount(own, minlength=len(self.near))
        np.minimum.at(self.best, own, ranks)

    def rows(self) -> Iterator[tuple[str, int, str, int]]:
        for k in np.flatnonzero(self.near):
            word, n = self.order[self.best[k]]
            yield self.words[k].decode("latin-1"), int(self.near[k]), word.decode("latin-1"), n


def _cell(part: int, words: list[bytes], counts: np.ndarray, kinds: np.ndarray) -> list[tuple[str, int, str, int]]:
    """What one cell, or one part of a divided cell, finds."""
    sides = [_Best([words[i] for i in np.flatnonzero(kinds == k)], counts[kinds == k]) for k in (HOME, SAME, SHORTER)]
    home, same, shorter = sides
    if not home.words:
        return []
    _Best.ranked(*sides)
    codes = [letters(s.words, len(s.words[0])) if s.words else None for s in sides]
    found = [None if c is None else points(c) for c in codes]
    trees = [None if f is None else Boxes(f) for f in found]

    def meet(k: int, more: int, less: int, itself: bool = False) -> None:
        for i, j in close(trees[k], trees[HOME], more, less, itself):
            for at in range(0, len(i), 1 << 18):
                x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                if k == SHORTER:
                    ok, ahead = one_inserted(codes[k][x], codes[HOME][y])
                    if part == 4:  # with equal first halves the pair was found in part 3
                        ok &= ahead < codes[k].shape[1] // 2
                else:
                    ok = one_replaced(codes[k][x], codes[HOME][y])
                x, y = x[ok], y[ok]
                sides[k].add(x, home.rank[y])
                home.add(y, sides[k].rank[x])

    if part in (0, 1, 2):
        meet(HOME, 1, 1, True)
        if same.words:
            meet(SAME, 1, 1)
    if part in (0, 3, 4) and shorter.words:
        meet(SHORTER, 1, 0)
    return [row for s in sides for row in s.rows()]


def _cells(group: pa.Table) -> pa.Table:
    words = [w.encode("latin-1") for w in group.column("word").to_pylist()]
    rows = _cell(group.column("part")[0].as_py(), words, group.column("n").to_numpy(), group.column("kind").to_numpy())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])


def near(words: DataFrame, cell_words: int = CELL_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(word, n, n_near, best, best_n) of every row of words (word, n; different words of letters a-z and À to ÿ): how many words are one edit away, and of those the
    one of largest n (of equals the first in code-point order); null if there is none. An empty table gives no rows."""
    words = stored(words.select("word", "n"), "spelling-words")
    placed = stored(words.mapInArrow(_place(layout(words, cell_words)), _CELL), "spelling-cells")
    hot = stored(placed.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot_rows).select("cell"), "spelling-hot")
    if not hot.isEmpty():
        placed = placed.join(hot.withColumn("is_hot", F.lit(True)), "cell", "left")
        again = placed.filter("is_hot").withColumn("at", F.explode(_halves())).select("cell", "kind", "at.part", "at.half", "word", "n")
        placed = placed.filter("is_hot IS NULL").drop("is_hot").union(again)
    found = placed.groupBy("cell", "part", "half").applyInArrow(_cells, "word string, n_near long, best string, best_n long")
    nothing = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    every = nothing.union(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best", "best_n"))
    order = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    sums = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(order).alias("top"))
    return sums.select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of forms (word, form): what following the forms leads to. A form is FORM_TIMES as frequent, so there are no circles and a chain
    of k words is followed in log2(k) rounds."""
    labels = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        salted = labels.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        up = labels.select(F.col("word").alias("root"), F.col("root").alias("top"), F.explode(salts(SALTS)).alias("salt"))
        labels = stored(salted.join(up, ["root", "salt"], "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "spelling-roots")
        if labels.filter("moved").isEmpty():
            return labels.select("word", "root")
        labels = labels.select("word", "root")


def variants(words: DataFrame, cell_words: int = CELL_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n), see near(): a word's form is its best partner if that occurs FORM_TIMES as often; root is the
    last of the forms of forms, the word itself if it has none."""
    found = near(words, cell_words, hot_rows)
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    judged = stored(found.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    last = roots(judged.filter("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
