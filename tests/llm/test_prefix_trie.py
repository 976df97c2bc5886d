"""The trie of conversations against a plain one."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie
from tests.llm.odd import words

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, run=20):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, run)), [])[:h] + ts[h:])
    members, ends = {}, {}
    for c, ts in built.items():
        ends.setdefault(ts, []).append(c)
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, below = {}, {n: [0, 0] for n in members}
    for n in members:
        if n:
            children[n[:-1]] = children.get(n[:-1], 0) + 1
    for n, own_members in members.items():
        saved = (len(own_members) - 1) * len(words(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += n not in children
            below[n[:d]][1] += saved
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), *below[n], digest(n)) for n, m in members.items()),
        key=repr,
    )


def got(spark, rows, **options):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)


def made(rng, convs, few):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no it is", "what else is there", ""])) for c in range(convs) for t in range(rng.randrange(few))]


@pytest.mark.parametrize("shard_turns", [6, 50, 10**6])
def test_trie_by_brute_force(spark, shard_turns):
    rows = made(random.Random(shard_turns), 70, 6)
    assert got(spark, rows, shard_turns=shard_turns) == plain(rows)


def test_copies_that_span_shards(spark):
    """Equal conversations, turnless ones among them, over many shards."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 500, 20) for t in range(4)]
    rows += [(c, 0, "user", "x") for c in range(1001, 1040)] + [(c, t, "user", f"turn {t}") for c in range(1600, 1610) for t in range(6)]
    want = plain(rows)
    assert got(spark, rows, shard_turns=15) == want
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t % 7} words") for c in (20, 40) for t in range(300)] + [(21, t, "user", f"{t % 5}") for t in range(10)]
    assert got(spark, rows, shard_turns=100) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, None, "user", ""), (1, 2, None, "b c"), (1, 2, None, "b c"), (2, 0, "", ""), (-20, 1, "user", "a"), (-3, 1, "usera", ""), (-4, 1, "user", "a")]
    rows += [(40, 0, "user", "w " * 50_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = prefix_trie.trie(table.withColumns({c: F.lit("x") for c in ("ids", "words", "id", "said", "shard", "key", "n_convs")}))
    # rows of one turn number go by the dictionary; here they are alike or the role differs
    total = {r.conv_id: r.n_convs for r in out.collect() if r.depth == 0}
    assert total == {-20: 6}
    assert sum(r.saved_tokens for r in out.collect() if r.depth == 0) == sum(r[6] for r in plain(rows) if r[1] == 0)
    assert got(spark, []) == [] and got(spark, rows[:1]) == []


def test_balance():
    """Medians first: no search for a turn takes more than the logarithm of its neighbours."""
    lists = [[k] for k in range(1023)]
    tree, _ = prefix_trie.planted(lists, [[1]] * len(lists))
    depth, stack = {}, [(tree.same[0], 1)]
    while stack:
        at, d = stack.pop()
        if at:
            depth[at] = d
            stack += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert len(depth) == 1023 and max(depth.values()) == 10
