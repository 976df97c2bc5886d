"""Odd sketches and the groups of near copies against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import odd_sketch
from tests.llm.odd import TEXTS, docs, words
from tests.llm.test_near_dups import roots

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=2):
    own = words((text or "").translate(UP))
    return {tuple(own[i : i + size]) for i in range(max(len(own) - size + 1, 1))} if own else set()


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_groups(texts, size=2):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    own = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if near(sets[a], sets[b])]
    return {k: (len(sets[k]), r) for k, r in roots(pairs, own).items()}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def family(rng, copies, length, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.randint(0, most))) for _ in range(copies)]


def grouped(spark, texts, **options):
    table = docs(spark, [(k, t, "en", "a") for k, t in texts.items()])
    return {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch.grouped(table, **options).collect()}


@pytest.mark.parametrize("copies,most,size", [(5, 12, 2), (150, 9, 2), (40, 8, 5)])
def test_groups_by_brute_force(spark, copies, most, size):
    rng = random.Random(copies)
    made = [t for _ in range(300 // copies) for t in family(rng, copies, rng.randint(60, 200), most)]
    made += ["a", "A", "a b", "A B", "a b c d e f", "\x0ba  B ", "", None, "ä", "Ä"]
    texts = dict(enumerate(made))
    want = plain_groups(texts, size)
    assert grouped(spark, texts, size=size) == want
    assert len({r for _, r in want.values()}) < len(texts) - 20


def test_chain(spark):
    """A chain of versions is one component though its ends share nothing."""
    own = [f"w{k}" for k in range(900)]
    texts = {k: " ".join(own[20 * k : 20 * k + 240]) for k in range(30)}
    got = grouped(spark, texts)
    assert got == plain_groups(texts) and {r for _, r in got.values()} == {0}


def test_sketches_tell_the_similarity():
    rng = random.Random(3)
    for share in (0.7, 0.8, 0.9, 0.97):
        differ = []
        for _ in range(30):
            n = 1000
            both = round(2 * n * share / (1 + share))
            a = np.array(rng.sample(range(2**60), 2 * n - both), np.uint64)
            one, other = a[:n], a[n - both :]
            samples = np.array([odd_sketch.minima(s) for s in (one, other)])
            x, y = odd_sketch.odd_sketches(samples)
            differ.append(int(np.bitwise_count(x ^ y).sum()))
        m, k = odd_sketch.SKETCH_BITS, odd_sketch.SAMPLES
        estimate = 1 + m / (4 * k) * np.log(1 - 2 * np.mean(differ) / m)
        assert estimate == pytest.approx(share, abs=0.015)
        if share >= 0.8:
            assert max(differ) < odd_sketch.MOST_BITS


def test_sketches_of_sets_never_lose_a_pair():
    rng = np.random.default_rng(4)
    for n, differ in ((5, 1), (150, 30), (1000, 100), (20000, 4000)):
        for _ in range(20):
            every = rng.integers(0, 2**63, n, dtype=np.uint64)
            x, y = odd_sketch.set_sketches([every[differ // 2 :], every[: n - (differ - differ // 2)]])
            bits = int(np.bitwise_count(x ^ y).sum())
            assert bits <= differ and (bits + differ) % 2 == 0
            assert n > 1000 or bits > 0.8 * differ - 1


def test_parity_of_the_sketch():
    samples = np.arange(2 * odd_sketch.SAMPLES, dtype=np.uint32).reshape(2, -1)
    got = np.unpackbits(odd_sketch.odd_sketches(samples), axis=1)
    want = np.zeros_like(got)
    for row, own in enumerate(samples.tolist()):
        for k, v in enumerate(own):
            place = int(odd_sketch.mix(np.array([v + (k << 32)], np.uint64))[0] % np.uint64(odd_sketch.SKETCH_BITS))
            want[row, place] ^= 1
    assert (got == want).all()


def test_pairs_grow_with_rows_not_with_groups(spark):
    """Documents that share a passage but are not alike give no pair of sketches that passes."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {k: passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for k in range(400)}
    table = docs(spark, [(k, t, "en", "a") for k, t in texts.items()])
    rows = odd_sketch.sketched(table, "doc_id", "text", 2)
    members = rows.selectExpr("node", "1L AS key", "node AS label")
    assert odd_sketch.close_in_groups(members, odd_sketch.sketches_of(rows, members), block_rows=64).count() == 0
    assert {r for _, r in grouped(spark, texts).values()} == set(texts)


def test_blocks_find_all_pairs(spark):
    rng = random.Random(6)
    texts = dict(enumerate(family(rng, 120, 150, 3)))
    table = docs(spark, [(k, t, "en", "a") for k, t in texts.items()])
    rows = odd_sketch.sketched(table, "doc_id", "text", 2).dropDuplicates(["node"])
    members = rows.selectExpr("node", "1L AS key", "node AS label")
    sketches = odd_sketch.sketches_of(rows, members)
    whole, cut = ({tuple(r) for r in odd_sketch.close_in_groups(members, sketches, block_rows=n).collect()} for n in (1000, 7))
    assert whole == cut and len(whole) == rows.count() * (rows.count() - 1) // 2


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in odd_sketch.grouped(docs(spark)).collect()), key=repr)
    texts = {k: t for k, (_, t, *_) in enumerate(TEXTS)}
    ids = [i for i, *_ in TEXTS]
    sets = {k: shingles(t) for k, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    groups = roots(pairs, sorted(sets))
    low = {}
    for k, r in groups.items():
        low[r] = min([v for v in (low.get(r), ids[k]) if v is not None], default=None)
    assert got == sorted(((ids[k], len(sets[k]), low[groups[k]]) for k in sets), key=repr)
    assert odd_sketch.grouped(docs(spark, [])).count() == 0


def test_shingles_of_few_words():
    raw = odd_sketch.shingle_sets(pa.array(["a b", "a b c", "a b c d", "a", None]), 5)
    assert len(set(raw[:4])) == 4 and raw[4] == b"" and all(len(r) == 8 for r in raw[:4])
