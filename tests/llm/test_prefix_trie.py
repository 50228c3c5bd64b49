"""The trie of conversations against one made node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import prefix_trie, queries

TABLE = "conv_id long, turn long, role string, text string"


def brute(rows, group=100, heads=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            tie = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), tie, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % heads if group else 0
        rebuilt[c] = (own.get(c - c % group, [])[:h] if group else []) + t[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids, who = children[node], members[node]
        below[node] = (sum(below[k][0] for k in kids) or 1, sum(below[k][1] for k in kids) + ((len(who) - 1) * len(node[-1][1]) if node else 0))
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations():
    """Ties, nulls, repeated rows, absent and short bases, equal conversations and a long one."""
    rng, rows = random.Random(5), []
    for c in [*range(330), 1000050, 777]:
        if c in (100, 200):
            continue
        for t in range(rng.choice([1, 1, 2, 3, 7])):
            rows.append((c, t, "user", f"same {t}") if c % 3 == 0 else (c, rng.choice([None, 0, 1, 2]), rng.choice(["user", None, ""]), rng.choice(["a", "bb", None, "", "é€"])))
    rows += [(5, t, "user", "long") for t in range(400)] + [(None, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("lists", [{}, {"rulers": 4, "last": 50}])
def test_trie_is_that_of_all_prefixes(spark, lists):
    rows = conversations()
    table = spark.createDataFrame(rows, TABLE).repartition(5).withColumn("pos", F.lit(7)).withColumn("a", F.lit("clash"))
    assert result(prefix_trie.of_conversations(table, 100, **lists)) == brute(rows)
    if lists:
        assert result(prefix_trie.of_conversations(table, **lists)) == brute(rows, None)


def test_op11_on_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_prefix_trie(spark, sf_dir)) == brute(rows)


def test_trie_edges(spark):
    assert prefix_trie.of_conversations(spark.createDataFrame([], TABLE), 100).collect() == []
    one = [(150, 0, None, None)]  # its turn goes, its base is absent
    for rows in (one, [(7, 1, "a", "x" * 100_000), (7, 1, "a", "x" * 100_000)]):
        assert result(prefix_trie.of_conversations(spark.createDataFrame(rows, TABLE), 100)) == brute(rows)


def test_list_of_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    ends = [(2, 1, 1, c) for c in range(500)] + [(k, 5, 5, k * 10 + j) for k in range(100) for j in range(k % 3 + 1)]
    random.Random(2).shuffle(ends)
    got = {(r["pos"], r["a"], r["b"]): r["sha"] for r in prefix_trie.ends_digest(spark.createDataFrame(ends, "pos long, a long, b long, conv_id long")).collect()}
    lists = defaultdict(list)
    for *key, c in ends:
        lists[tuple(key)].append(c)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in lists.items()}
