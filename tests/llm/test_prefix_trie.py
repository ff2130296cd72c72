import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import assert_same

from loomaudit.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_rebuilt(rows):
    """conv_id -> rebuilt turns."""
    own = defaultdict(list)
    for c, *turn in rows:
        if c is not None:
            own[c].append(turn)
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    own = {c: [(r or "", t or "") for _, r, t in turns] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """The nodes of conv_id -> turns."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(convs[c]) == len(node))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made_of(spark, convs):
    rows = [(c, 0, None, None) for c in convs] + [(c, d + 1, *t) for c, turns in convs.items() for d, t in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, depth bigint, role string, text string")


def test_rebuilt(spark):
    random.seed(1)
    rows = [(c, random.choice([None, *range(6)]), random.choice(["user", "assistant", None]), random.choice(["a", "bé", "", None])) for c in [*range(-7, 60), None] if c != 10 for _ in range(random.randint(1, 12))]
    got = defaultdict(list)
    for c, d, r, t in prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)).collect():
        got[c].append((d, r, t))
    want = brute_rebuilt(rows)
    assert {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])][1:] for c, turns in got.items()} == want
    assert all(sorted(d for d, _, _ in turns) == list(range(len(turns))) for turns in got.values())
    assert ours(prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(want)


@pytest.mark.parametrize("seed", range(4))
def test_random_tries(spark, seed):
    random.seed(seed)
    letters = ["a", "b", "cé", ""][: 1 + seed]
    convs = {random.randrange(10**6): [(random.choice(["u", "v"]), random.choice(letters)) for _ in range(random.randint(0, 9))] for _ in range(250)}
    assert ours(prefix_trie.nodes(made_of(spark, convs))) == brute(convs)


def test_chain_of_nested_conversations(spark):
    """Each conversation is a beginning of the next: a compressed tree of 70 points above one another."""
    convs = {100 - n: [("u", str(k)) for k in range(n)] for n in range(70)}
    assert ours(prefix_trie.nodes(made_of(spark, convs))) == brute(convs)


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    convs = {c: [("u", "hello"), ("v", "so")] for c in range(500)} | {1000 + c: [("u", "hello"), ("v", str(c))] for c in range(200)} | {5000: [("u", "x" * k) for k in range(600)], 5001: [("u", "x" * k) for k in range(300)] + [("u", "z")]}
    assert ours(prefix_trie.nodes(made_of(spark, convs))) == brute(convs)


def test_turnless_and_empty(spark):
    assert ours(prefix_trie.nodes(made_of(spark, {3: [], 1: []}))) == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
    rows = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.nodes(prefix_trie.rebuilt(rows)).collect() == []


def test_a_conversation_of_100_000_turns(spark):
    """One row of a conversation stays small: nodes are as many as its turns."""
    rows = spark.range(100_000).selectExpr("7L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text", "1 as depth")
    got = prefix_trie.nodes(prefix_trie.rebuilt(rows))
    assert got.count() == 100_000 - zlib.crc32(b"7") % 9 + 1


def test_query(spark, data):
    assert_same(queries.op12_prefix_trie(spark, data), queries.OP12_SQL, data)
