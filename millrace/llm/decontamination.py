"""Benchmark items inside documents: containment search by size-partitioned min-hash sketches, checked on whole shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrays import LOWER, chunks, shingle_hashes, span_hashes, words
from millrace.llm.rows import fresh
from millrace.session import cut_lineage

SHINGLE = 5
CONTAINMENT = 0.8
#: Slots of each filter that tasks hold, a byte each. Fixed, so what is broadcast does not grow; fuller filters only
#: let more rows through to the joins.
SLOTS = 1 << 22

UPPER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
LOWER_TEXT = UPPER_TEXT.lower()
#: Characters that are left out: ASCII but for letters, digits and blanks.
OMITTED = r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]"
_OMIT = np.array([b < 128 and not (chr(b).isalnum() or b == 32 or 9 <= b <= 13) for b in range(256)])


def plain_words(text: Column) -> Column:
    """Words of the plain form: A-Z and À-Þ lower-cased, ASCII signs left out, cut at blanks."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER_TEXT, LOWER_TEXT), OMITTED, "")
    return F.filter(F.split(plain, "[ \\t-\\r]+"), lambda w: w != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of `size` plain words; none if there are fewer words."""
    own = plain_words(text)
    at = F.when(F.size(own) >= size, F.sequence(F.lit(1), F.size(own) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(own, i, size), " ")))


def hashed(texts: pa.Array, size: int = SHINGLE):
    """Of runs of texts: the chunk's rows, plain bytes, words, shingle hashes, their texts, and the first word of each."""
    for chunk in chunks(texts):
        data = LOWER[chunk.data]
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][accent] += 0x20
        keep = ~_OMIT[data]
        begin = np.concatenate([[0], np.cumsum(keep)])[chunk.begin]
        data = data[keep]
        own = words(data, begin)
        h, text = shingle_hashes(span_hashes(data, own.start, own.end), own.first, size)
        before = np.cumsum(np.maximum(own.count - size + 1, 0)) - np.maximum(own.count - size + 1, 0)
        word = own.first[text] + np.arange(len(h)) - before[text]
        yield chunk.rows, data, own, h, text, word


def _slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(34) & mask).astype(np.int64)


def _texts(data: np.ndarray, own, word: np.ndarray, size: int) -> pa.Array:
    """The runs of `size` words that begin at the given ones, joined by blanks."""
    raw = data.tobytes()
    runs = (zip(own.start[w : w + size].tolist(), own.end[w : w + size].tolist()) for w in word.tolist())
    return pa.array([b" ".join(raw[a:b] for a, b in run).decode() for run in runs], pa.string())


def _class_of(n: Column) -> Column:
    """Size class: 1 + the whole logarithm of the number of shingles."""
    return (F.floor(F.log2(n.cast("double") + 0.5)) + 1).cast("int")


def item_shingles(items: DataFrame, item_col: str, text_col: str, size: int, containment: float) -> DataFrame:
    """`(item, shingle, words, h, n_item, size_class, sketched)` of the items; `item` is the id with a hash of the text, so
    texts under one id stay apart. An item of fewer words than a shingle has one, all its words. The sketch of an item of n shingles is its
    n - ceil(containment * n) + 1 smallest hashes: a text that holds the wanted share holds one of these."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(1, size + 1):
                for rows, data, own, h, text, word in hashed(batch.column("text"), n):
                    mine = (own.count[text] == n) | (n == size)
                    h, text, word = h[mine], text[mine], word[mine]
                    place = pa.array(text + rows.start)
                    ids = [batch.column("item_id").take(place), batch.column("item_hash").take(place)]
                    number = pa.array(np.full(len(h), n, np.int32))
                    yield pa.RecordBatch.from_arrays([*ids, _texts(data, own, word, n), number, pa.array(h.view(np.int64))], ["item_id", "item_hash", "shingle", "words", "h"])

    rows = items.select(F.col(item_col).alias("item_id"), F.xxhash64(F.col(text_col)).alias("item_hash"), F.col(text_col).alias("text"))
    own = rows.mapInArrow(run, f"item_id {kind}, item_hash long, shingle string, words int, h long").distinct()
    own = own.select(F.struct("item_id", "item_hash").alias("item"), "shingle", "words", "h")
    # equal hashes of different shingles of one item would spoil the rank; the shingle decides
    per = Window.partitionBy("item")
    own = own.withColumn("n_item", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy("h", "shingle")))
    wanted = F.ceil(F.lit(containment) * F.col("n_item") - 1e-9)
    return own.select("item", "shingle", "words", "h", "n_item", _class_of(F.col("n_item")).alias("size_class"), (F.col("rank") <= F.col("n_item") - wanted + 1).alias("sketched"))


def _filter_table(own: DataFrame, slots: int) -> np.ndarray:
    """For each slot the least size class of the hashes that fall on it, 255 if none. At most `slots` rows are collected."""
    low, high = F.col("h").bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned("h", 34).bitwiseAND(F.lit(slots - 1))
    found = own.select(F.explode(F.array(low, high)).alias("slot"), "size_class").groupBy("slot").agg(F.min("size_class").alias("c")).toPandas()
    table = np.full(slots, 255, np.uint8)
    table[found["slot"].to_numpy(np.int64)] = found["c"].to_numpy(np.uint8)
    return table


def contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    slots: int = SLOTS,
) -> DataFrame:
    """`(doc_id, text_hash, item_id, n_shared, n_item, containment)` of every document and item of whose distinct
    shingles the document has at least the given share, anywhere in its text.

    The documents are read once. Tasks hold two filters of fixed size, of the sketches and of all shingles of the items,
    marked with the least size class of the items: a document with too few shingles for a class passes it over. A
    document that meets the sketch filter hands on those of its shingles that meet the other one, as text; joins on
    sketch and shingle do the rest exactly. An item of fewer than `size` plain words is one shingle of as many words;
    documents are searched for runs of such lengths only if there are such items. Null texts, and texts and items
    without plain words, match nothing. Rows alike in id and text count once, among documents and among items; null ids are ids like others.
    """
    spark = docs.sparkSession
    own = cut_lineage(item_shingles(items, item_col, item_text_col, size, containment), "item-shingles")
    tables = spark.sparkContext.broadcast((_filter_table(own.where("sketched"), slots), _filter_table(own, slots)))
    kind = docs.schema[id_col].dataType
    lengths = sorted(r[0] for r in own.select("words").distinct().collect())  # at most `size` rows
    # the least number of shingles that a document of each class's items must have
    need = np.array([0, *(np.ceil(containment * 2.0**c - 1e-9) for c in range(254)), np.inf])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, every = tables.value
        for batch in batches:
            for n in lengths:
                for rows, data, words_, h, text, word in hashed(batch.column("text"), n):
                    a, b = _slots(h, slots)
                    room = np.maximum(words_.count - n + 1, 0)[text]
                    hit = np.flatnonzero(every[a] < 255)
                    hit = hit[need[np.maximum(every[a[hit]], every[b[hit]])] <= room[hit]]
                    asked = need[np.maximum(sketch[a[hit]], sketch[b[hit]])] <= room[hit]
                    chosen = np.zeros(len(words_.count), bool)
                    chosen[text[hit[asked]]] = True
                    live = chosen[text[hit]]
                    hit, asked = hit[live], asked[live]
                    _, once = np.unique(np.stack([text[hit].astype(np.uint64), h[hit]]), axis=1, return_index=True) if len(hit) else (None, hit)
                    hit, asked = hit[once], asked[once]
                    place = pa.array(text[hit] + rows.start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(place), batch.column("text_hash").take(place), pa.array(h[hit].view(np.int64)), _texts(data, words_, word[hit], n), pa.array(asked)],
                        ["doc_id", "text_hash", "h", "shingle", "asked"],
                    )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("text_hash long, h long, shingle string, asked boolean").fields])
    hits = cut_lineage(rows.mapInArrow(run, schema), "shared-shingles").distinct()
    key = F.struct("doc_id", "text_hash").alias("doc")
    asked = hits.where("asked").select(key, "h").join(own.where("sketched").select("h", "item"), "h").select("doc", "item").distinct()
    # the asked pairs bring the shingles of their item and then look for them among the document's, so a shingle
    # that many documents and items share makes no rows for pairs that nobody asks about
    wanted = asked.join(own.select("item", "shingle", "n_item"), "item")
    shared = wanted.join(hits.select(key, "shingle"), ["doc", "shingle"])
    counted = shared.groupBy("doc", "item", "n_item").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    found = counted.where(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_item") - 1e-9))
    return found.select("doc.doc_id", "doc.text_hash", "item.item_id", "n_shared", "n_item", share.alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no item."""
    own, hashed = fresh(docs, "id"), fresh(docs, "hash")
    found = contained(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct()
    match = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(hashed))
    return docs.join(cut_lineage(found, "contaminated"), match, "left_anti")
