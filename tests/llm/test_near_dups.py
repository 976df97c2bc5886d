import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import near_dups
from millrace.llm.components import components
from tests.llm.odd import TEXTS, docs, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_of(text):
    own = words((text or "").translate(UP))
    parts = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_simhash_is_the_definition():
    texts = [t for _, t, *_ in TEXTS[:8]] + ["A b\vC  d", "É é É", "x " * 300, "a b"]
    assert near_dups.simhash(pa.array(texts)).tolist() == [print_of(t) for t in texts]


@pytest.mark.parametrize("leaf", [4, 16, 1000])
def test_groups_are_those_of_all_pairs(spark, leaf):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for k in range(260):  # chains and clusters of near fingerprints
        prints.append(rng.choice(prints) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1))
    own = sorted({p - 2**64 if p >> 63 else p for p in prints})
    near = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    frame = spark.createDataFrame([(p,) for p in own], "fingerprint long")
    found = near_dups.links(frame, leaf_rows=leaf, sample_rows=256).collect()
    assert set(found) and roots([(r.a, r.b) for r in found], own) == roots(near, own)


def test_a_hot_cluster_is_cut_into_blocks(spark):
    # all agree in one half, and so share a shard of one tree
    own = [int(x) for x in np.unique(np.random.default_rng(3).integers(0, 1 << 14, 3000))]
    frame = spark.createDataFrame([(p,) for p in own], "fingerprint long")
    found = near_dups.links(frame, leaf_rows=200, sample_rows=1000)
    near = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert roots([(r.a, r.b) for r in found.collect()], own) == roots(near, own)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    nodes = {n for p in pairs for n in p}
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in nodes} == roots(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = near_dups.grouped(docs(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert len(rows) == len(TEXTS)
    by_print = {}
    for r in rows:
        by_print.setdefault(r.fingerprint, []).append(r)
    blank = by_print[0]
    assert {r.component_id for r in blank} == {1} and len(blank) == 4
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = near_dups.drop_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted([(0, 27), (1, 0), (4, 4), (4, 30), (5, len(TEXTS[8][1])), (7, 27), (8, 11)])
    assert near_dups.drop_near_copies(docs(spark, [])).count() == 0


def test_groups_without_ids_keep_one_row(spark):
    rows = [(None, "the same text of some words", "en", "a")] * 3 + [(None, "another one of some other words", "en", "a")]
    assert near_dups.drop_near_copies(docs(spark, rows)).groupBy("text").count().where(F.col("count") > 1).count() == 0
