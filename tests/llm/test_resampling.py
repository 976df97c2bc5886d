"""Resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import resampling
from millrace.llm.arrays import chunks
from tests.llm.odd import LONG, TEXTS, docs

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def buckets(text):
    own = WORD.findall((text or "").translate(UP))
    runs = [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs], len(own)


def plain(rows, target, percent=5, least=20):
    found = [buckets(t) for _, t in rows]
    source, wanted = Counter(b for f, _ in found for b in f), Counter(b for t in target for b in buckets(t)[0])
    s_all, t_all = sum(source.values()) + 10000.0, sum(wanted.values()) + 10000.0
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((source[b] + 1.0) * t_all)))
    out = []
    for (i, _), (f, n) in zip(rows, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(spark, rows, target, **options):
    table = docs(spark, [(i, t, "en", "a") for i, t in rows])
    items = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in resampling.resampled(table, items, **options).collect()), key=repr)


def test_features_by_brute_force():
    rng = random.Random(2)
    signs = "ab9Z_-.,ä中 \n\t'" + "\x00\x7f"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += [None, "", "x" * 47 + " b " + "y" * 48 + " " + "z" * 49 + " c " + "w" * 5000 + " d", "q" * 49, LONG]
    for size in (1 << 20, 100):
        seen = []
        for chunk in chunks(pa.array(texts), size):
            bucket, text, words = resampling.features(chunk)
            assert [buckets(t)[1] for t in texts[chunk.rows]] == words.tolist()
            seen += [sorted(bucket[text == k].tolist()) for k in range(chunk.n)]
        assert seen == [sorted(buckets(t)[0]) for t in texts]


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_draw_by_brute_force(spark, percent):
    rng = random.Random(percent)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(60)))) for k in range(400)]
    target = [" ".join(f"w{rng.randrange(20)}" for _ in range(40)) for _ in range(20)]
    assert got(spark, rows, target, percent=percent) == plain(rows, target, percent)


def test_ties_go_by_the_smaller_id(spark):
    """Scores from few values: the cutoff lies within equal ones."""
    scores = [(k * 7919 % 1000, k % 5 - 2) for k in range(1000)] + [(None, 1)] * 3
    table = spark.createDataFrame(scores, "place long, score long")
    order = sorted(scores, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for wanted in (1, 2, 199, 200, 201, 203, 204, 500, 1003):
        kept = [tuple(r) for r in table.where(resampling.cutoff(table, wanted)).collect()]
        assert set(order[:wanted]) <= set(kept) and len(kept) <= wanted + 2
        assert sorted(kept, key=repr)[: len(kept)] == sorted(order[: len(kept)], key=repr)


def test_least_with(spark):
    rng = random.Random(1)
    for values in ([5], [3] * 9, [rng.randrange(-(10**12), 10**12) for _ in range(50)], [-(2**62), 2**62], [0, 1, 1, 1, 9]):
        table = spark.createDataFrame([(v,) for v in values], "v long")
        for wanted in (1, 2, len(values)):
            if wanted <= len(values):
                assert resampling.least_with(table, "v", wanted) == sorted(values, reverse=True)[wanted - 1]


def test_repeated_rows(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(30)))] * 10 + [(None, "one two " * 20)] * 10
    out = got(spark, rows, [], percent=35)
    assert sorted(r[4] for r in out if r[4]) == [1, 2, 3, 4, 5, 6, 7] and out == plain(rows, [], 35)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in TEXTS]
    for target in ([], [None, "", "word w1 w2"]):
        assert got(spark, rows, target, percent=60, min_words=1) == plain(rows, target, 60, 1)
    assert got(spark, [], ["a"]) == []
    table = docs(spark).select("*", F.lit(1).alias("score"), F.lit(1).alias("rank"), F.lit(1).alias("WORDS"), F.lit(1).alias("n_features"))
    assert resampling.resampled(table, table).count() == len(TEXTS)
