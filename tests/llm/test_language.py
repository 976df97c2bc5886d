import binascii

import numpy as np
import pyarrow as pa

from millrace.llm import language
from tests.llm.odd import TEXTS, docs


def test_windows_hold_every_byte():
    texts = ["", "ä" * 300, "x" * 256, "y" * 257, None]
    found = {}
    for rows, x, text, size in language.windows(pa.array(texts)):
        for w, t, n in zip(x, text, size):
            found.setdefault(rows.start + int(t), []).append((bytes(w), int(n)))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert b"".join(w for w, _ in found[k]).rstrip(b"\0") == raw and len(found[k]) == max(-(-len(raw) // 256), 1)
        assert sum(n for _, n in found[k]) == max(len(raw), 1)


def test_fast_tables_are_the_convolution():
    net = language.fit(["alpha beta gamma", "eins zwei drei", "un deux trois"] * 5, ["a", "b", "c"] * 5, epochs=2)
    x = np.random.default_rng(0).integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    slow = np.concatenate([z.max(axis=1) for z in language._convolve(net, x)], axis=1)
    slow = language._log_softmax(np.maximum(slow + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(slow, language.log_probabilities(net, x), atol=1e-4)


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(table, language.train(table)).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_part_are_not_used(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = table.withColumn("lang", language.F.when(language.held_out(), "xx").otherwise(table.lang))
    a, b = language.train(table), language.train(hidden)
    assert a.languages == b.languages and np.array_equal(a.out, b.out)


def test_odd_rows(spark):
    table = docs(spark)
    net = language.train(table, rows_per_language=5)
    rows = language.predict(table, net).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (binascii.crc32(own.encode()) % 4 == 2)
    lang = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
    assert [lang[k] for k in (1, 2, 3, 8)] == ["und"] * 4 and lang[5] != "und"
    kept = language.keep_identified(table, net, 0.0)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 9}
    none = language.train(docs(spark, []))
    assert none.languages == [] and {r.lang_pred for r in language.predict(table, none).collect()} == {"und"}
    assert language.predict(docs(spark, []), net).count() == 0
