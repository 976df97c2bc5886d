"""Quality rules with thresholds that follow the data: mergeable quantile sketches per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import chunks, mix, shingle_hashes, span_hashes, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Relative error of a sketch: bucket k holds the values from just over GAMMA**(k-1) to GAMMA**k.
ERROR = 0.02
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Smaller values count as zero.
LEAST = 1e-4
#: Fences lie as far beyond the outer two of these quantiles as those lie from the middle one.
RANKS = (0.01, 0.5, 0.99)
#: Features of a document, and whether low values are odd as well; a low share of signs or repeats is not.
FEATURES = {"word_length": True, "symbol_share": False, "dup_line_share": False, "repeat_share": False}
#: A sketch of fewer documents gives way to that of the language, and then to that of all.
MIN_DOCS = 50
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a batch, by the contract of the query; equal lines and windows are found by 64-bit hashes."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    out = {name: np.zeros(len(texts), np.int64) for name in names}
    for chunk in chunks(texts):
        data, begin, n = chunk.data, chunk.begin, chunk.n
        own = words(data, begin)
        rows = chunk.rows
        out["n_words"][rows] = own.count
        inner = np.zeros(len(data) + 1, np.int32)
        inner[own.start] += 1
        inner[own.end] -= 1
        letter = np.cumsum(inner[:-1], dtype=np.int8).view(bool) & ((data & 0xC0) != 0x80)
        total = np.concatenate([[0], np.cumsum(letter)])
        out["word_chars"][rows] = np.diff(total[begin])
        total = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
        out["n_symbols"][rows] = np.diff(total[begin])
        # lines end at \n and at the end of a text
        final = begin[1:] - 1
        ends = np.union1d(np.flatnonzero(data == 10), final)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = np.searchsorted(begin, starts, "right") - 1
        full = np.searchsorted(own.start, ends) > np.searchsorted(own.start, starts)
        starts, ends, text = starts[full], ends[full], text[full]
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        key = span_hashes(data, starts, ends) ^ salt[text]
        _, first = np.unique(key, return_index=True)
        held = np.bincount(text, minlength=n)
        out["n_lines"][rows] = held
        out["n_dup_lines"][rows] = held - np.bincount(text[first], minlength=n)
        key, text = shingle_hashes(span_hashes(data, own.start, own.end), own.first, WINDOW)
        again = np.flatnonzero(_repeated(key ^ salt[text]))
        if len(again):
            before = np.cumsum(np.maximum(own.count - WINDOW + 1, 0)) - np.maximum(own.count - WINDOW + 1, 0)
            word = own.first[text[again]] + again - before[text[again]]
            cover = np.zeros(len(own.start) + WINDOW + 1, np.int64)
            np.add.at(cover, word, 1)
            np.add.at(cover, word + WINDOW, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(own.start)] > 0)])
            out["n_repeat_words"][rows] = np.diff(covered[own.first])
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`(doc_id, lang, source)` and the counts of every row. A null text has no words; repeated rows stay apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(found[c]) for c in names], ["doc_id", "lang", "source", *names])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source")]
    return rows.mapInArrow(run, ", ".join(kinds + [f"{c} long" for c in names]))


def features() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value from 0 on; values under `LEAST` share the lowest."""
    k = F.ceil(F.log(value) / F.lit(math.log(GAMMA)))
    return F.when(value < LEAST, F.lit(math.floor(math.log(LEAST) / math.log(GAMMA)))).otherwise(k).cast("int")


def _value(k: Column) -> Column:
    middle = F.pow(F.lit(GAMMA), k) * F.lit(2 / (1 + GAMMA))
    return F.when(k <= math.floor(math.log(LEAST) / math.log(GAMMA)), 0.0).otherwise(middle)


def sketches(rows: DataFrame) -> DataFrame:
    """`(lang, source, feature, bucket, n)`: a sketch is its counts by bucket, and sketches merge by adding them. Spark
    combines the counts within tasks, so a large group costs a row for each bucket and task."""
    parts = [F.struct(F.lit(name).alias("feature"), bucket(value).alias("bucket")) for name, value in features().items()]
    return rows.select("lang", "source", F.inline(F.array(*parts))).groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def quantiles(found: DataFrame, keys: list[str], wanted: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """`keys, feature, docs, q` of the merged sketches: for each wanted rank the value of the first bucket that reaches it."""
    per = Window.partitionBy(*keys, "feature")
    merged = found.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("docs", F.sum("n").over(per)).withColumn("upto", F.sum("n").over(per.orderBy("bucket")))
    ranks = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("docs")), F.col("bucket"))) for q in wanted]
    return run.groupBy(*keys, "feature", "docs").agg(F.array(*map(_value, ranks)).alias("q"))


def fences(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each language and source: `(lang, source, <feature>_low, <feature>_high ...)`.

    The quantiles come from the sketch of the language and source if it holds `min_docs` documents, else from that of
    the language, else from that of all; the coarser ones are merged from the finer. A side on which the quantiles
    coincide shows no spread; there the next coarser sketch that shows one is asked, and if none does, the fence is the
    end of the bucket that holds them all.
    """
    fine = quantiles(found, ["lang", "source"], RANKS).select("lang", "source", "feature", F.col("docs").alias("n0"), F.col("q").alias("q0"))
    lang = quantiles(found, ["lang"], RANKS).select(F.col("lang").alias("lang1"), F.col("feature").alias("f1"), F.col("docs").alias("n1"), F.col("q").alias("q1"))
    every = quantiles(found, [], RANKS).select(F.col("feature").alias("f2"), F.col("q").alias("q2"))
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("feature") == F.col("f1"))).join(every, F.col("feature") == F.col("f2"))

    def chosen(side: int) -> Column:
        spread = lambda k: F.col(f"q{k}")[side] != F.col(f"q{k}")[1]
        full = [F.col(f"n{k}") >= min_docs for k in (0, 1)]
        q = F.when(full[0] & spread(0), F.col("q0")).when(full[1] & spread(1), F.col("q1")).when(spread(2), F.col("q2"))
        return q.when(full[0], F.col("q0")).when(full[1], F.col("q1")).otherwise(F.col("q2"))

    # a quantile is the middle of its bucket; fences count from the bucket's ends
    low = chosen(0)[0] * ((1 + GAMMA) / 2 / GAMMA) - (chosen(0)[1] - chosen(0)[0])
    high = F.greatest(chosen(2)[2] * ((1 + GAMMA) / 2), F.lit(LEAST)) + (chosen(2)[2] - chosen(2)[1])
    ends = joined.select("lang", "source", "feature", low.alias("low"), (high * (1 + 1e-9)).alias("high"))
    own = lambda name, value: F.max(F.when(F.col("feature") == name, value))
    columns = []
    for name, both in FEATURES.items():
        columns += [own(name, F.col("low") * (1 - 1e-9) if both else F.lit(0.0)).alias(f"{name}_low"), own(name, F.col("high")).alias(f"{name}_high")]
    return ends.groupBy("lang", "source").agg(*columns)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The measured rows with `base_failed` and `kept`: not failed, and within the fences of language and source in all
    features. Fences are drawn from the documents that don't fail; null languages and sources are groups like others.
    The fences are joined by both keys; Spark splits the partitions of large groups."""
    rows = rows.withColumn("base_failed", base_failed())
    ends = fences(sketches(rows.where("not base_failed")), min_docs).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    match = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    inside = F.lit(True)
    for name, value in features().items():
        inside = inside & value.between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return rows.join(ends, match, "left").select(*rows.columns, kept.alias("kept"))
