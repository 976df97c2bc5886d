"""The near-copy stage against brute-force Jaccard similarity."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import odd_sketch, similar
from tests.llm.odd import docs, words

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    own = words((text or "").translate(UP))
    return {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))}


def near_pairs(texts):
    sets, held, near = {k: shingles(t) for k, t in texts.items()}, defaultdict(list), set()
    for k, own in sets.items():
        shared = Counter(j for s in own for j in held[s])
        near |= {(j, k) for j, n in shared.items() if 5 * n >= 4 * (len(own) + len(sets[j]) - n)}
        for s in own:
            held[s].append(k)
    return near


def check(texts, kept):
    near = near_pairs(texts)
    assert [p for p in near if p[0] in kept and p[1] in kept] == []
    beside = defaultdict(set)
    for a, b in near:
        beside[a].add(b)
        beside[b].add(a)
    assert [k for k in texts if k not in kept and not beside[k] & kept] == []
    return near


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def made(rng, groups, copies, most):
    texts = {}
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(copies):
            texts[len(texts)] = " ".join(edited(rng, base, rng.randint(0, max(1, int(len(base) * most)))))
    return texts


@pytest.mark.parametrize("groups,copies,most", [(60, 5, 0.04), (1, 150, 0.02)])
def test_copies_by_brute_force(spark, groups, copies, most):
    texts = made(random.Random(groups), groups, copies, most)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, [(k, t, "en", "a") for k, t in texts.items()]), "").collect()]
    near = check(texts, set(got))
    assert len(got) == len(set(got)) and near and len(got) < len(texts)


def test_chain_of_versions(spark):
    """Each version is a copy of its neighbours only: what goes has one that stays, and the ends of the chain are no copies."""
    own = [f"w{k}" for k in range(400)]
    texts = {k: " ".join(own[25 * k : 25 * k + 300]) for k in range(5)}
    texts |= {10 + k: " ".join(f"v{j}" for j in range(20 * k, 20 * k + 200)) for k in range(30)}
    kept = {r.doc_id for r in similar.drop_copies(docs(spark, [(k, t, "en", "a") for k, t in texts.items()])).collect()}
    assert len(check(texts, kept)) > 30 and len(kept) > 8


def test_unlike_documents_of_one_passage(spark):
    """Documents that share a passage but are no copies: no pair is checked by whole sets, however many there are."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    for n in (200, 400):
        table = docs(spark, [(k, passage + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(60)), "en", "a") for k in range(n)])
        rows = odd_sketch.sketched(table, "doc_id", "text", 5)
        keys = odd_sketch.shared_keys(rows.select("node", F.explode("bands").alias("key")))
        sketches = odd_sketch.sketches_of(rows, keys)
        assert odd_sketch.close_in_groups(keys.withColumn("label", F.col("node")), sketches).count() == 0
    assert similar.drop_copies(table).count() == 400


def test_given_documents(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(table.select("doc_id", "text").collect())
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, FOLDER).collect()}
    check(texts, kept)


def test_odd_rows(spark):
    got = similar.drop_copies(docs(spark))
    assert got.columns == docs(spark).columns
    # of 5 and 6, which are alike, the hash of the set decides
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect() if r.doc_id not in (5, 6))
    assert kept == sorted([(0, 27), (1, 0), (4, 4), (4, 30), (7, 27), (8, 11)]) and got.count() == len(kept) + 1
    assert similar.drop_copies(docs(spark, [])).count() == 0
    alike = [(None, "the same text of some words", "en", "a")] * 3 + [(None, "another one of some other words", "en", "a")]
    assert similar.drop_copies(docs(spark, alike)).groupBy("text").count().where(F.col("count") > 1).count() == 0
