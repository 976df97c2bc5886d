import math
import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import quality
from tests.llm.odd import TEXTS, docs, words


def measure(text):
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    fives = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    number = Counter(fives)
    cover = {k for i, w in enumerate(fives) if number[w] > 1 for k in range(i, i + 5)}
    return {"n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#\n\t|", max_size=80)), max_size=6))
def test_measures(texts):
    got = quality.measures(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert {name: int(v[k]) for name, v in got.items()} == measure(t)


def test_measures_of_long_texts():
    texts = [t for _, t, *_ in TEXTS]
    got = quality.measures(pa.array(texts))
    assert [{name: int(v[k]) for name, v in got.items()} for k in range(len(texts))] == [measure(t) for t in texts]


def test_sketch_quantiles_are_within_their_error_and_merge(spark):
    rng = random.Random(6)
    values = {("en", "a"): [rng.lognormvariate(0, 2) for _ in range(900)], ("en", "b"): [0.0] * 40 + [rng.random() for _ in range(60)]}
    frame = spark.createDataFrame([(*k, v) for k, many in values.items() for v in many], "lang string, source string, v double")
    found = frame.select("lang", "source", quality.F.lit("v").alias("feature"), quality.bucket(frame.v).alias("bucket")).groupBy("lang", "source", "feature", "bucket").agg(quality.F.count("*").alias("n"))

    def near(q, many):
        many = sorted(many)
        return all(abs(x - many[math.ceil(r * len(many)) - 1]) <= 0.021 * max(x, 1e-3) for x, r in zip(q, (0.25, 0.75)))

    for r in quality.quantiles(found, ["lang", "source"]).collect():
        assert near(r.q, values[r.lang, r.source])
    (r,) = quality.quantiles(found, ["lang"]).collect()
    assert near(r.q, values["en", "a"] + values["en", "b"]) and r.docs == 1000


def test_thresholds_follow_the_group(spark):
    def text(k, sign):
        return " ".join(f"w{k}x{j}" + (sign if j % 2 else "") for j in range(40))

    rows = [(k, text(k, ""), "en", "prose") for k in range(200)] + [(k, text(k, "##"), "en", "code") for k in range(200, 400)]
    rows += [(400, text(400, "######"), "en", "prose"), (401, text(401, ""), "en", "code"), (402, text(402, "######"), "xx", "new")]
    got = {r.doc_id: r.kept for r in quality.judged(quality.measured(docs(spark, rows))).collect()}
    assert len(got) == 403 and all(got[k] for k in range(400)) and not got[400] and got[401]


def test_odd_rows(spark):
    got = quality.judged(quality.measured(docs(spark))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judged(quality.measured(docs(spark, []))).count() == 0


def test_each_feature_alone_rejects(spark):
    def text(k, sign="", lines=None):
        lines = lines or [" ".join(f"w{k:03}x{i:02}{j}" + sign for j in range(5)) for i in range(20)]
        return "\n".join(lines)

    rows = [(k, text(k), "en", "a") for k in range(200)]
    repeat = text(201).replace("\n", " ").split()
    dup = [f"v{j}" + "bcdefg" for j in range(4)]
    rows += [
        (200, " ".join(f"word{j}letters{j}more" for j in range(100)), "en", "a"),
        (201, text(201, lines=[" ".join(repeat + repeat[:5])]), "en", "a"),
        (202, text(202, lines=text(202).split("\n") + [" ".join(dup)] * 2), "en", "a"),
        (203, " ".join(f"w203x{j:03}" if j % 5 else f"w203x{j:02}#" for j in range(100)), "en", "a"),
    ]
    measured = quality.measured(docs(spark, rows))
    got = {r.doc_id: r for r in quality.judged(measured).collect()}
    assert [k for k in range(200) if not got[k].kept] == []
    for k, name in zip(range(200, 204), ("word_length", "repeat_share", "dup_line_share", "symbol_share")):
        assert not got[k].base_failed and not got[k].kept
        fenced = quality.fences(quality.sketches(measured)).first()
        values = measured.where(f"doc_id = {k}").select(*[v.alias(n) for n, v in quality.features().items()]).first().asDict()
        assert [n for n, v in values.items() if not fenced[f"{n}_low"] <= v <= fenced[f"{n}_high"]] == [name]
