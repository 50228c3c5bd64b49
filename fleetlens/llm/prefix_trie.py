"""A prefix trie of conversations, and sums over its subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns. Turns become digests at once, texts are never shuffled. The digest of a sequence is the sum of its turns' hashes, each taken
with its position, so digests of all prefixes are running sums, which tasks compute over ranges of (conversation, position) and carry from one range to the
next: a conversation of any length is spread over many tasks. One aggregation by digest gives the nodes. A node is named by its smallest member and its depth.

Every node has an enter and an exit arc. The arc after the enter arc is that of its first child, or its own exit; after the exit arc comes the next sibling's enter arc, or the
parent's exit. This one long list is ranked with rulers, arcs chosen by a hash, one of RULERS: the other arcs jump over arcs, twice as far each round, until they
meet a ruler; rulers make a list that is RULERS times shorter, ranked in the same way, and the rest add what their ruler got. What is added up along the list are weights (leaves, savings,
both at enter arcs), so that each arc knows the sum from its position to the end, and a subtree's sum is the difference between its two arcs.

Children of one parent are ordered across tasks as well, joins on a parent are salted, and the ids of a node's ends are hashed in order from pieces that tasks have joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import salted_join, stored

#: One of so many arcs is a ruler. A list of LAST arcs or fewer is walked by one task.
RULERS = 32
LAST = 1 << 15
#: Bytes of one piece of a node's list of ends.
PIECE = 1 << 20
#: The conversation whose first turns another begins with, and how many of them, in the registered query.
GROUP, HEADS = 100, 6


def running(rows: DataFrame, key: str, order: list[str], values: list[str], name: str) -> DataFrame:
    """rows with each of the long columns `values` replaced by its running sum (modulo 2**64) within equal `key` (long, no nulls) in the order of `order`.

    Tasks sum over ranges of (key, order). What a range carries into the next one is known from one row for each task.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    out = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    names = [f.name for f in out.fields]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, last, held = TaskContext.get().partitionId(), 0, None, np.zeros(len(values), np.uint64)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys = batch.column(key).to_numpy()
            table = np.stack([batch.column(v).to_numpy().view(np.uint64) for v in values], axis=1)
            sums = np.cumsum(table, axis=0, dtype=np.uint64)
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(begins, n))
            sums -= np.repeat(sums[begins] - table[begins], sizes, axis=0)
            if last is not None and keys[0] == last:
                sums[: sizes[0]] += held
            last, held = keys[-1], sums[-1].copy()
            columns = {c: batch.column(c) for c in batch.schema.names} | {v: pa.array(np.ascontiguousarray(sums[:, k]).view(np.int64)) for k, v in enumerate(values)}
            columns |= {"part": pa.array(np.full(n, part, np.int32)), "nth": pa.array(nth + np.arange(n))}
            nth += n
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    summed = stored(dealt.mapInArrow(add_up, out), name)
    edges = summed.groupBy("part").agg(F.min_by(key, "nth").alias("first"), F.max_by(F.struct(F.col(key).alias("key"), *values), "nth").alias("last")).orderBy("part").collect()
    carried: dict[int, tuple[int, list[int]]] = {}
    before, held = None, [0] * len(values)
    for edge in edges:  # a row for each task
        goes_on = before is not None and edge["first"] == before
        if goes_on:
            carried[edge["part"]] = (before, held)
        own = list(edge["last"][1:])
        held = [(a + b) % 2**64 for a, b in zip(own, held, strict=True)] if goes_on and edge["last"]["key"] == before else [a % 2**64 for a in own]
        before = edge["last"]["key"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = batch.column("part").to_numpy(), batch.column(key).to_numpy()
            for part in set(parts.tolist()) & carried.keys():
                at = (parts == part) & (keys == carried[part][0])
                for v, more in zip(values, carried[part][1], strict=True):
                    sums = batch.column(v).to_numpy().view(np.uint64) + at * np.uint64(more)
                    batch = batch.set_column(batch.schema.get_field_index(v), v, pa.array(sums.view(np.int64)))
            yield batch.select(names[:-2])

    return summed.mapInArrow(carry, dealt.schema) if carried else summed.select(*names[:-2])


def turns(conversations: DataFrame, name: str = "trie") -> DataFrame:
    """conv_id, pos (from 1), turn's digest and code points of every row of conversations (conv_id, turn, role, text), in the order of turn (null first; equal
    ones in the order of their digests). Null role and text are empty; rows without a conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("pos"))
    return running(rows.filter("conv_id IS NOT NULL"), "conv_id", ["turn", "digest"], ["pos"], f"{name}-turns").drop("turn")


def rebuilt(own: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, points) and (conv_id, size): every conversation c of turns() begins with the first h turns of conversation c - c % group instead of its own
    first h; h is the unsigned crc32 of c as text, modulo `heads`."""
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(heads)
    based = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % F.lit(group)).alias("base"))
    bases = convs.filter(F.col("conv_id") % F.lit(group) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = based.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = stored(info.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-info")
    later = salted_join(own, info.select("conv_id", "h", "m"), ["conv_id"], "digest").filter("pos > h")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "points")
    # a base has fewer than `heads` first turns and at most `group` conversations that begin with them
    first = own.filter((F.col("conv_id") % F.lit(group) == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "digest", "points")
    copied = info.select("conv_id", "base", "m").join(first, "base").filter("pos <= m").select("conv_id", "pos", "digest", "points")
    return later.union(copied), info.select("conv_id", "size")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, pos, points, and the digests of the first pos turns (a, b) and of those before (pa, pb) of rows (conv_id, pos, digest, points)."""
    one, two = F.xxhash64("digest", "pos"), F.xxhash64(F.lit("other"), "digest", "pos")
    hashed = rows.select("conv_id", "pos", "points", one.alias("a"), two.alias("b"), one.alias("pa"), two.alias("pb"))
    sums = running(hashed, "conv_id", ["pos"], ["a", "b"], "trie-prefixes")

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in "ab":  # the sum less the turn's own hash, modulo 2**64
                less = batch.column(x).to_numpy().view(np.uint64) - batch.column("p" + x).to_numpy().view(np.uint64)
                batch = batch.set_column(batch.schema.get_field_index("p" + x), "p" + x, pa.array(less.view(np.int64)))
            yield batch

    return sums.mapInArrow(before, sums.schema)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(pos, a, b, sha) of rows (pos, a, b, conv_id): SHA-256 of the decimal ids of equal (pos, a, b), ascending and comma-joined.

    Ranges of ids are joined to text by many tasks. Nodes whose ids lie within one range are hashed there; of others the pieces, a megabyte of text each, are
    hashed in order, one after another, as SHA-256 demands.
    """
    keys = ["pos", "a", "b"]
    names = [*keys, "sha", "low", "piece"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        now, low, size, is_first = None, 0, 0, True

        def close(whole: bool) -> None:
            text = ",".join(held)
            out.append((*now, hashlib.sha256(text.encode()).hexdigest(), None, None) if whole else (*now, None, low, text))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names)

        split = False  # whether the node has pieces already
        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*keys, "conv_id")), strict=True):
                if key != now:
                    if now is not None:
                        close(not is_first and not split)
                        is_first = False
                    now, low, size, split = key, conv, 0, False
                elif size >= PIECE:
                    close(False)
                    low, size, split = conv, 0, True
                text = str(conv)
                held.append(text)
                size += len(text) + 1
            if len(out) >= 1000:
                yield batch_of()
        if now is not None:
            close(False)  # the next range may go on with it
        if out:
            yield batch_of()

    kinds = "pos long, a long, b long, sha string, low long, piece string"
    found = stored(ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(pieces, kinds), "trie-ends")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*keys, "piece")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
        if now is not None:
            out.append((*now, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*keys, "sha"])

    pieces_left = found.filter("piece IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "low")
    return found.filter("sha IS NOT NULL").select(*keys, "sha").union(pieces_left.select(*keys, "piece").mapInArrow(whole, "pos long, a long, b long, sha string"))


def next_sibling(nodes: DataFrame) -> DataFrame:
    """(conv, depth, sibling) of nodes (conv, depth, parent): the next larger conv of the same depth and parent, null for the last."""
    dealt = nodes.select("depth", "parent", "conv").repartitionByRange(F.desc("depth"), F.desc("parent"), F.desc("conv")).sortWithinPartitions(F.desc("depth"), F.desc("parent"), F.desc("conv"))

    def lag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            depth, parent, conv = (batch.column(c).to_numpy() for c in ("depth", "parent", "conv"))
            before = np.concatenate([[0 if last is None else last[2]], conv[:-1]])
            same = np.concatenate([[last is not None and (depth[0], parent[0]) == last[:2]], (depth[1:] == depth[:-1]) & (parent[1:] == parent[:-1])])
            last = (depth[-1], parent[-1], conv[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("depth"), batch.column("parent"), pa.array(before, pa.int64(), mask=~same), pa.array(np.full(n, part, np.int32)), pa.array(nth + np.arange(n))],
                                             ["conv", "depth", "parent", "sibling", "part", "nth"])
            nth += n

    found = stored(dealt.mapInArrow(lag, "conv long, depth long, parent long, sibling long, part int, nth long"), "trie-siblings")
    row = F.struct("depth", "parent", "conv")
    edges = found.groupBy("part").agg(F.min_by(row, "nth").alias("first"), F.max_by(row, "nth").alias("last")).orderBy("part").collect()
    over = [(b["first"]["conv"], b["first"]["depth"], a["last"]["conv"]) for a, b in zip(edges[:-1], edges[1:], strict=True) if tuple(a["last"])[:2] == tuple(b["first"])[:2]]  # a row for each task
    if not over:
        return found.select("conv", "depth", "sibling")
    more = found.sparkSession.createDataFrame(over, "conv long, depth long, over long")
    return found.join(F.broadcast(more), ["conv", "depth"], "left").select("conv", "depth", F.coalesce("sibling", "over").alias("sibling"))


_WEIGHTS = ["leaves", "saved"]
_ARC = "conv long, code long, to_conv long, to_code long, leaves long, saved long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums from every arc to the end, for a short list (or several that end) given whole."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("conv", "code", "to_conv", "to_code", *_WEIGHTS)), strict=True)]
    at = {r[:2]: k for k, r in enumerate(rows)}
    follows = [None if r[2] is None else at[r[2:4]] for r in rows]
    begins = set(range(len(rows))) - set(follows)
    sums: list = [None] * len(rows)
    for k in begins:
        path = []
        while k is not None and sums[k] is None:
            path.append(k)
            k = follows[k]
        leaves, saved = (0, 0) if k is None else sums[k]
        for k in reversed(path):
            leaves, saved = leaves + rows[k][4], saved + rows[k][5]
            sums[k] = (leaves, saved)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*r[:2], *s) for r, s in zip(rows, sums, strict=True)), strict=True)], ["conv", "code", *_WEIGHTS])


def ranked(arcs: DataFrame, rulers: int = RULERS, last: int = LAST, level: int = 0) -> DataFrame:
    """(conv, code, leaves, saved) of a list of arcs (conv, code, to_conv, to_code: the next arc, null for the end; leaves, saved): the sums from each arc to the end, its own included."""
    arcs = stored(arcs, f"trie-arcs{level}")
    if arcs.count() <= last:
        return stored(arcs.coalesce(1).mapInArrow(_walk, "conv long, code long, leaves long, saved long"), f"trie-ranks{level}")

    def is_ruler(conv: str, code: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), conv, code), F.lit(rulers)) == 0

    moving = arcs.withColumn("met", F.col("to_conv").isNull() | is_ruler("to_conv", "to_code"))
    settled, active, round_no = moving.filter("met"), moving.filter("NOT met"), 0
    while not active.isEmpty():
        known = settled.union(active).filter(~is_ruler("conv", "code"))
        ahead = known.select(F.col("conv").alias("to_conv"), F.col("code").alias("to_code"), F.col("to_conv").alias("on_conv"), F.col("to_code").alias("on_code"), *[F.col(w).alias(f"more_{w}") for w in _WEIGHTS], F.col("met").alias("on_met"))
        hop = active.join(ahead, ["to_conv", "to_code"])
        moving = stored(hop.select("conv", "code", F.col("on_conv").alias("to_conv"), F.col("on_code").alias("to_code"), *[(F.col(w) + F.col(f"more_{w}")).alias(w) for w in _WEIGHTS], F.col("on_met").alias("met")), f"trie-jump{level}-{round_no}")
        settled, active, round_no = settled.union(moving.filter("met")), moving.filter("NOT met"), round_no + 1
    of_rulers = ranked(settled.filter(is_ruler("conv", "code")).drop("met"), rulers, last, level + 1)
    ahead = of_rulers.select(F.col("conv").alias("to_conv"), F.col("code").alias("to_code"), *[F.col(w).alias(f"more_{w}") for w in _WEIGHTS])
    rest = settled.filter(~is_ruler("conv", "code")).join(ahead, ["to_conv", "to_code"], "left")
    rest = rest.select("conv", "code", *[(F.col(w) + F.coalesce(F.col(f"more_{w}"), F.lit(0))).alias(w) for w in _WEIGHTS])
    return stored(of_rulers.union(rest), f"trie-ranks{level}")


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of nodes (conv, depth, parent, sibling, child; weights): the code of an arc is twice the depth of its node, one more for the exit."""
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    down = [F.col("conv"), enter.alias("code"), F.coalesce("child", "conv").alias("to_conv"), F.when(F.col("child").isNotNull(), enter + 2).otherwise(leave).alias("to_code"), *_WEIGHTS]
    up = [F.col("conv"), leave.alias("code"), F.coalesce("sibling", "parent").alias("to_conv"), F.when(F.col("sibling").isNotNull(), enter).when(F.col("parent").isNotNull(), leave - 2).alias("to_code"),
          *[F.lit(0).cast("long").alias(w) for w in _WEIGHTS]]
    return nodes.select(*down).union(nodes.select(*up))


def trie(rows: DataFrame, sizes: DataFrame, rulers: int = RULERS, last: int = LAST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of conversations, given as rows
    (conv_id, pos, digest, points) and sizes (conv_id, size); conversations without turns are members of the root. An empty table has no nodes, not even a root."""
    sums = stored(prefixes(rows), "trie-sums")
    keys = ["pos", "a", "b"]
    found = sums.groupBy(*keys).agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    found = stored(found, "trie-nodes")
    top = sizes.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs")).first()
    nothing = F.lit(None).cast("long")
    root = sums.sparkSession.createDataFrame([(top["conv"], 0, top["n_convs"])] if top["n_convs"] else [], "conv long, depth long, n_convs long")
    # parents: the first turns' is the root, the others' the node of the sequence before
    above = found.select((F.col("pos") + 1).alias("pos"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    named = salted_join(found.filter("pos > 1"), above, ["pos", "pa", "pb"], "conv").select(*keys, "conv", "n_convs", "points", "parent")
    named = named.union(found.filter("pos = 1").select(*keys, "conv", "n_convs", "points", F.lit(top["conv"]).cast("long").alias("parent")))
    named = stored(named, "trie-named")
    nodes = named.select("conv", F.col("pos").alias("depth"), "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    nodes = nodes.union(root.select("conv", "depth", nothing, "n_convs", F.lit(0).cast("long")))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv").alias("child"))
    linked = nodes.join(children, ["conv", "depth"], "left").join(next_sibling(nodes.filter("depth > 0")), ["conv", "depth"], "left")
    linked = stored(linked.withColumn("leaves", F.col("child").isNull().cast("long")), "trie-linked")
    ranks = ranked(tour(linked), rulers, last)
    sign = F.when(F.col("code") % 2 == 0, 1).otherwise(-1)
    below = ranks.groupBy("conv", F.floor(F.col("code") / 2).alias("depth")).agg(*[F.sum(F.col(w) * sign).alias(f"all_{w}") for w in _WEIGHTS])
    # what ends at a node: the last prefix of every conversation
    ends = sums.groupBy("conv_id").agg(F.max_by(F.struct(*keys), "pos").alias("end")).select("end.*", "conv_id")
    ends = ends.union(sizes.filter("size = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    sha = stored(ends_digest(ends), "trie-sha")
    of_nodes = named.join(sha, keys).select("conv", F.col("pos").alias("depth"), "sha")
    of_nodes = of_nodes.union(sha.filter("pos = 0").select(F.lit(top["conv"]).cast("long"), "pos", "sha"))
    every = linked.join(below, ["conv", "depth"]).join(of_nodes, ["conv", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("all_leaves").alias("n_leaves"),
                        F.col("all_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256"))


def of_conversations(conversations: DataFrame, group: int | None = None, heads: int = HEADS, rulers: int = RULERS, last: int = LAST) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), see turns() and trie(); with `group`, of conversations rebuilt as rebuilt() says."""
    own = stored(turns(conversations), "trie-own")
    if group:
        rows, sizes = rebuilt(own, group, heads)
    else:
        rows, sizes = own, own.groupBy("conv_id").agg(F.max("pos").alias("size"))
    return trie(rows, sizes, rulers, last)
