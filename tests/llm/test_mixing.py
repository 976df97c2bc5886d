from collections import Counter, defaultdict
from fractions import Fraction

from millrace.llm import mixing
from millrace.llm.rows import numbered
from pyspark.sql import functions as F
from tests.llm.odd import TEXTS, docs, words


def targets(sizes):
    """Rounds of resharing with exact numbers. Sources in code point order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full) or 1
        over = {s for s in names if s not in full and Fraction(free * weight[s], rest) > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else Fraction(free * weight[s], rest) for s in names}
        full |= over


def check(spark, rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = targets(sizes)
    got = mixing.with_copies(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        m = r.mix_
        assert m.size == len(words(r.text)) and m.source_size == sizes[r.source] and abs(m.target - float(want[r.source])) <= 1e-6 * max(m.target, 1)
        assert m.copies <= 3
        taken[r.source] += m.size * m.copies
    return want, taken, got


def test_targets_and_draws(spark):
    rows = [(k, "a b c d e f g h"[: 1 + k % 16], "en", "src%d" % (k % 9 if k % 9 else k % 2)) for k in range(4000)] + [(k, "one word", "en", None) for k in range(4000, 4010)]
    want, taken, got = check(spark, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 12), s
    again = {r.doc_id: r.mix_.copies for r in mixing.with_copies(docs(spark, rows[::-1])).collect()}
    assert again == {r.doc_id: r.mix_.copies for r in got}
    whole = Counter(r.doc_id for r in mixing.mixed(docs(spark, rows)).collect())
    assert whole == Counter({k: n for k, n in again.items() if n})


def test_odd_rows(spark):
    check(spark, TEXTS)
    assert mixing.mixed(docs(spark)).columns == docs(spark).columns
    assert mixing.with_copies(docs(spark, [])).count() == 0
    assert [r.mix_.copies for r in mixing.with_copies(docs(spark, [(1, None, "en", None)])).collect()] == [0]


def test_numbered(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("k"), F.lit("x").alias("part"))
    got = numbered(frame.repartition(5), F.col("k"), "n").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(str(k) for k in range(1000)) and {r.part for r in got} == {"x"}
