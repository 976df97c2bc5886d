import hashlib
import random
from collections import Counter, defaultdict

from millrace.llm import sharding
from tests.llm.odd import TEXTS, docs


def placed(rows, limit):
    """Shard of each row by the rule itself, as a bag of (id, text, shard)."""
    hashes = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16) for i, t, *_ in rows]
    sizes = [len((t or "").encode()) for _, t, *_ in rows]
    total = defaultdict(int)
    for h, n in zip(hashes, sizes):
        for d in range(61):
            total[d, h >> (60 - d)] += n
    found = []
    for (i, t, *_), h in zip(rows, hashes):
        depth = next((d for d in range(61) if total[d, h >> (60 - d)] <= limit), None)
        found.append((i, t, None if depth is None else format(h >> (60 - depth), f"0{depth}b") if depth else ""))
    return found


def test_shards_follow_the_rule(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(0, 400), "en", "a") for k in range(3000)]
    for limit in (1 << 30, 20_000, 700):
        got = [(r.doc_id, r.text, r.s) for r in sharding.sharded(docs(spark, rows), shard_bytes=limit).selectExpr("doc_id", "text", "shard_.name as s").collect()]
        assert Counter(got) == Counter(placed(rows, limit))


def test_rows_that_no_bit_parts_are_dealt_out(spark):
    rows = [(1, "y" * 100, "en", "a")] * 25 + [(2, "z" * 5000, "en", "a")] + [(k, "small", "en", "a") for k in range(3, 20)]
    got = sharding.sharded(docs(spark, rows), shard_bytes=1000).selectExpr("doc_id", "shard_.name as s", "shard_.bytes as n").collect()
    held = defaultdict(int)
    for r in got:
        held[r.s] += r.n
    assert len(got) == len(rows) and all(n <= 1000 for s, n in held.items() if n != 5000)
    assert Counter(Counter(r.s for r in got if r.doc_id == 1).values()) == Counter({10: 2, 5: 1})


def test_odd_rows(spark):
    got = sharding.sharded(docs(spark))
    assert got.columns == [*docs(spark).columns, "shard_"] and got.count() == len(TEXTS)
    assert {r.shard_.name for r in got.collect()} == {""}
    assert sharding.sharded(docs(spark, [])).count() == 0
