"""Importance resampling towards a target: n-gram gains as an array, scores from it, and a cutoff found by bisection.

The features of a text are its runs of one to three words, hashed to 10,000 buckets. How much more often a bucket occurs in
the target than in the documents is its gain; a document's weight is the sum of its gains, and its score adds noise that
depends on its id alone, so that the highest scores are a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import LOWER, Chunk, chunks
from millrace.llm.rows import fresh, numbered
from millrace.session import cut_lineage

BUCKETS = 10_000
WORDS = 3
SEED = 42
#: Percent of the documents with enough words that are drawn.
PERCENT = 5
MIN_WORDS = 20
#: Halvings of the range that one count job makes: it counts at 2**HALVINGS - 1 thresholds.
HALVINGS = 4
#: Longer words are hashed one by one.
LONG_WORD = 48
_PART_OF_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _crc_bytes() -> np.ndarray:
    """The CRC-32 register after each byte, from the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _crc_bytes()


def _shifts() -> np.ndarray:
    """`[n, k, v]`: what byte `k` of a CRC, if it is `v`, becomes when `n` more zero bytes follow (CRC is linear)."""
    table = np.zeros((LONG_WORD + 2, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(table)):
        table[n] = (table[n - 1] >> np.uint32(8)) ^ _STEP[table[n - 1] & 255]
    return table


_SHIFTS = _shifts()


def _longer(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two texts one after the other, from their own ones and the second one's length."""
    out = tail.copy()
    for k in range(4):
        out ^= _SHIFTS[length, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int | None = None) -> np.ndarray:
    """CRC-32 of spans, one byte of all spans a step; `first` is a byte that goes before each."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    if first is not None:
        crc = (crc >> np.uint32(8)) ^ _STEP[(crc ^ np.uint32(first)) & np.uint32(255)]
    length = end - start
    live = np.flatnonzero(length > 0)
    at = 0
    while len(live):
        own = crc[live]
        crc[live] = (own >> np.uint32(8)) ^ _STEP[(own ^ data[start[live] + at]) & np.uint32(255)]
        at += 1
        live = live[length[live] > at]
    return ~crc


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(bucket, text, words)`: the bucket and the text of every feature of a run of texts, and each text's number of words."""
    data = LOWER[chunk.data]
    inside = _PART_OF_WORD[data]
    # the byte behind each text is a blank
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    change = np.concatenate([[0], change]) if inside[0] else change
    start, end = change[0::2], change[1::2]
    first = np.searchsorted(start, chunk.begin)
    text = np.repeat(np.arange(chunk.n), np.diff(first))
    length = end - start
    usual = np.minimum(length, LONG_WORD)
    word, spaced = _crcs(data, start, start + usual), _crcs(data, start, start + usual, 0x20)
    crc, own, found = word, text, []
    raw = None
    for k in range(WORDS):
        if k:
            n = max(len(start) - k, 0)
            crc = _longer(crc[:n], spaced[k:], usual[k:] + 1)
            same = text[:n] == text[k:]
            own = np.where(same, text[:n], -1)
        # a long word's own CRC, and that of every run with such a word
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            raw = raw or data.tobytes()
            for j in range(max(i - k, 0), min(i, len(own) - 1) + 1):
                if own[j] >= 0:
                    crc[j] = zlib.crc32(b" ".join(raw[start[x] : end[x]] for x in range(j, j + k + 1)))
        found.append((crc[own >= 0], own[own >= 0]))
    bucket = np.concatenate([c for c, _ in found]) % np.uint32(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([t for _, t in found]), np.diff(first)


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each bucket occurs in all texts. Tasks hand on one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                total += np.bincount(features(chunk)[0], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": own, "n": total[own]})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # at most BUCKETS rows
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [(t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u between 0 and 1 from the seed and the key alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    u = (F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """`(doc_id, words, n_features, weight)` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                bucket, text, words = features(chunk)
                weight = np.zeros(chunk.n, np.int64)
                np.add.at(weight, text, gain[bucket])
                ids = batch.column("doc_id").slice(chunk.rows.start, chunk.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(np.bincount(text, minlength=chunk.n)), pa.array(weight)], ["doc_id", "words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, words long, n_features long, weight long")


def least_with(rows: DataFrame, value: str, wanted: int) -> int:
    """The largest whole number c such that at least `wanted` rows have a `value` of c or more; there must be so many.

    Every job counts the rows at or above a few thresholds, by which the range of c is halved several times.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        # between low, which enough rows reach, and high + 1
        step = max((high + 1 - low) >> HALVINGS, 1)
        marks = [m for m in range(low + step, low + (step << HALVINGS), step) if m <= high]
        counts = rows.agg(*[F.count(F.when(F.col(value) >= F.lit(m), 1)) for m in marks]).first()
        reached = [m for m, n in zip(marks, counts) if n >= wanted]
        missed = [m for m, n in zip(marks, counts) if n < wanted]
        low, high = max([low, *reached]), min([high, *(m - 1 for m in missed)])
    return low


def cutoff(rows: DataFrame, wanted: int, score: str = "score", place: str = "place") -> Column:
    """A condition for the `wanted` rows of the highest score, equal ones by the smaller `place`, a whole number or null,
    which comes last; more rows only if they agree in both."""
    least = least_with(rows, score, wanted)
    tied = rows.where(F.col(score) == least)
    above, same, named = rows.agg(F.count(F.when(F.col(score) > least, 1)), F.count(F.when(F.col(score) == least, 1)), F.count(F.when(F.col(score) == least, F.col(place)))).first()
    if above + same == wanted or above + named < wanted:
        return F.col(score) >= least
    most = -least_with(tied.where(F.col(place).isNotNull()).select((-F.col(place)).alias("back")), "back", wanted - above)
    return (F.col(score) > least) | ((F.col(score) == least) & (F.col(place) <= most))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """`(doc_id, n_features, weight, score, rank)` of every row: the place by falling score of those that are drawn, and null
    of the others. Of the rows with `min_words` words or more, `percent` percent are drawn, rounded down; equal scores go by
    the smaller id.

    Words are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased. Ids are whole numbers. Null
    texts and texts without words weigh nothing; null ids come last among equals and share a draw; repeated rows stay, and if
    only some of them are drawn, it does not matter which; an empty table gives no rows, an empty target is like one without features.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = cut_lineage(rows, "scores")
    able = rows.where(F.col("words") >= min_words)
    wanted = able.count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*names, none)
    drawn = (F.col("words") >= min_words) & cutoff(able, wanted, place="doc_id")
    order, at = fresh(rows, "order"), fresh(rows, "at")
    # the last part only spreads rows that agree in all others over the ranges
    key = F.struct(-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.monotonically_increasing_id())
    ranked = numbered(rows.where(drawn).withColumn(order, key), F.col(order), at)
    ranked = ranked.select(*names, F.when(F.col(at) < wanted, F.col(at) + 1).alias("rank"))
    return ranked.unionByName(rows.where(~drawn | drawn.isNull()).select(*names, none))
