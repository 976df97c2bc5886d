import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import personal_data as pd_
from tests.llm.odd import TEXTS, docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    return {"email": True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    found = [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if holds(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(spark, rows, **options):
    got = pd_.scanned(docs(spark, rows), **options)
    return got.select("doc_id", pd_.written(F.col("base")).alias("base"), pd_.written(F.concat("base", "found")).alias("all")).collect()


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = [t for (t,) in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += [
        "é😀 a@b.c a@b.com_x@c.com @x.y a@b a@b. a.@-.- %@1.2",
        "1.2.3.4.5 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 00000000000000001.1.1.1 1.2.3",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 0000000000000000 00000000000000000000",
        "+1 (017) 555-7713 +1234567 +12345678 +1----9999999 +1( +49 30 123456, +1234567890123456",
        "4111 1111 1111 1111 " * 700 + "x@y.zz " * 1300,
        "7" * 60_000 + " " + "a" * 60_000 + "@ " + "1." * 30_000 + "b" * 50_000,
    ]
    got = {r.doc_id: r.base for r in scan(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])}
    for k, t in enumerate(texts[:-1]):
        assert got[k] == base(t), (k, t[:80])
    assert got[len(texts) - 1] == ",".join(["ip:" + ":".join(map(str, (120003 + 8 * k, 120003 + 8 * k + 7))) for k in range(7500)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="12.@+-a é (_", max_size=60), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = frame.select("k", pd_.written(pd_.base_spans(F.col("t"))).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: base(t) for k, t in enumerate(texts)}


def test_running_sum(spark):
    for n in (0, 1, 511, 512, 513, 2000):
        frame = spark.createDataFrame([([k % 7 for k in range(n)],)], "a array<int>")
        got = frame.select(pd_.running_sum(F.col("a")).alias("s")).first().s
        assert got == [sum(k % 7 for k in range(i + 1)) for i in range(n)] if n < 600 else got[-1] == sum(k % 7 for k in range(n)) and len(got) == n


def test_contexts_find_unseen_identifiers(spark):
    """Six of eight values after `reach me:` are phones; the two others are taken. They make `or dial` sure in the next
    round, where three phones stand as well, and that finds one more; `order no` has no known value."""
    rows = [(k, f"Please reach me: +1 555 0000{k}0{k} today", "en", "a") for k in range(6)]
    rows += [(10, "please REACH  me: 555-88881 now", "en", "a"), (11, "reach me: 555-88882", "en", "a")]
    rows += [(20 + k, f"or dial +49 30 90000{k}", "en", "a") for k in range(3)] + [(30, "or dial 555-88881", "en", "a"), (31, "or dial 777-99991", "en", "a")]
    rows += [(40 + k, f"order no 12345{k}", "en", "a") for k in range(9)] + [(60, "order no 555-88882", "en", "a")]
    got = {r.doc_id: (r.base, r.all) for r in scan(spark, rows)}
    added = {k: a for k, (b, a) in got.items() if a != b}
    assert added == {10: "phone:18:27", 11: "phone:10:19", 30: "phone:8:17", 31: "phone:8:17"}
    once = {r.doc_id for r in scan(spark, rows, rounds=1) if r.all != r.base}
    assert once == {10, 11}


def test_odd_rows(spark):
    got = pd_.scanned(docs(spark)).collect()
    assert len(got) == len(TEXTS) and all(r.base == [] == r.found for r in got)
    twice = [(1, "a@b.cc", "en", "a")] * 3
    assert [r.base for r in scan(spark, twice)] == ["email:0:6"] * 3
    assert scan(spark, []) == []


@pytest.mark.parametrize("value,good", [("0.0.0.0", True), ("255.255.255.255", True), ("256.0.0.1", False), ("0000300.1.1.1", False), ("99999999999999999999.1.1.1", False)])
def test_parts_of_addresses(spark, value, good):
    assert spark.range(1).select(pd_.holds("ip", F.lit(value))).first()[0] == good


def test_contexts_reach_over_earlier_matches(spark):
    texts = ["office line 2: 555-88881", "a1 é2 x " * 90 + "77777 88888", "1 2 3 4 5 " * 40 + "b6"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", pd_.spans(F.col("t"), pd_.CANDIDATE).alias("s")).collect():
        assert r.s and all(s.before == r.t[max(s.start - pd_.REACH, 0) : s.start] for s in r.s)
    rows = [(k, f"office line {k}: +49 30 90000{k}", "en", "a") for k in range(6)] + [(9, texts[0], "en", "a")]
    assert {r.doc_id: r.all for r in scan(spark, rows) if r.all != r.base} == {9: "phone:15:24"}


def test_groups_of_digits_and_written_out_addresses(spark):
    rows = [(k, f"my phone: +1 555 0100{k:02}", "en", "a") for k in range(20)] + [(100 + k, f"mail me: a{k}@x.org", "en", "a") for k in range(20)]
    probes = {
        40: ("my phone: 030 123 4567", "phone:10:22"), 41: ("my phone: (030) 123-4567.", "phone:10:24"),
        42: ("office phone: 03012345678", "phone:14:25"), 43: ("office phone: ab-03012345678", ""),
        44: ("mail me: jane(at)example.com", "email:9:28"), 45: ("mail me: Jane.Roe [AT] example [dot] com today", "email:9:40"),
        46: ("pay 030 123 4567 now", ""), 47: ("my phone: 192.168.1x", "phone:10:20"), 48: ("write me: jane(at)example.com", "email:10:29"), 49: ("write me: 12345", ""),
    }
    got = {r.doc_id: r.all for r in scan(spark, rows + [(k, t, "en", "a") for k, (t, _) in probes.items()])}
    assert {k: got[k] for k in probes} == {k: want for k, (_, want) in probes.items()}
    assert all(got[k] == base(t) for k, t, *_ in rows)


def test_candidates_in_linear_time(spark):
    texts = ["12 34 " * 20_000, "12345 " + "a(at)" * 20_000, "1 " * 30_000 + "12345", "12.34-" * 20_000 + "x", "12345 " + "(" * 50_000, "12345 " + "ab " * 30_000]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.n for r in frame.select("k", F.size(pd_.candidate_spans(F.col("t"))).alias("n")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def plainly(seeds, candidates, rounds, min_seeds, confidence):
    """`learn_contexts` with dictionaries, for values that may be of every kind or of none."""
    edges = {(c, v) for c, v, _ in seeds if c} | {(c, v) for c, v in candidates if c}
    known = {(v, k) for _, v, k in seeds}
    scores, sure = {e: 1.0 for e in known}, {}
    for _ in range(rounds):
        sure = {}
        for c, k in {(c, k) for c, _ in edges for k in range(4)}:
            values = [v for d, v in edges if d == c]
            n_seeds = sum((v, k) in known for v in values)
            wide = c.startswith(pd_.WIDE)
            score = sum(scores.get((v, k), 0) for v in values) / len(values) * (1 - 1 / (1 + n_seeds))
            if n_seeds >= (pd_.WIDE_SEEDS if wide else min_seeds) and score >= (pd_.WIDE_CONFIDENCE if wide else confidence):
                sure[c, k] = score
        found = {}
        for c, v in edges:
            for k in range(4):
                formed = k == 3 or not c.startswith(pd_.WIDE)
                if (c, k) in sure and formed and not any(v == w for w, _ in known):
                    found[v, k] = 1 - (1 - found.get((v, k), 0)) * (1 - min(sure[c, k], 0.999999))
        scores = {e: 1.0 for e in known} | found
    return sure, {e: x for e, x in scores.items() if e not in known}


def test_scores_are_those_of_plain_loops(spark):
    import random

    rng = random.Random(11)
    words_ = [f"c{k}" for k in range(14)] + [pd_.WIDE + f"w{k}" for k in range(4)]
    values = [f"{k:05}" for k in range(150)]
    kind = {v: rng.choice([1, 3, 3, 3]) for v in values[:100]}
    seeds = [(rng.choice(words_ if kind[v] == 3 else words_[:4]), v, kind[v]) for v in rng.choices(values[:100], k=400)] + [(None, "77777", 3)]
    candidates = [(rng.choice(words_), rng.choice(values[90:])) for _ in range(120)] + [(None, "88888")]
    for rounds in (1, 3):
        want_contexts, want_values = plainly(seeds, candidates, rounds, 3, 0.5)
        contexts, found = pd_.learn_contexts(spark.createDataFrame(seeds, "context string, value string, kind int"), spark.createDataFrame(candidates, "context string, value string"), rounds)
        got_contexts, got_values = {(r.context, r.kind): r.score for r in contexts.collect()}, {(r.value, r.kind): r.score for r in found.collect()}
        assert got_contexts == pytest.approx(want_contexts) and got_values == pytest.approx(want_values)
        assert len(want_contexts) > 3 and len(want_values) > 3
