"""Near copies by Jaccard similarity: MinHash bands name candidates, odd sketches sift them, whole sets confirm them.

A text is its set of distinct word shingles, as 64-bit hashes; equal sets are one node. MinHash takes 640 samples of a set.
Eight in a row are a band: nodes that agree in a band share a key. The samples are also folded into an odd sketch, 2048 bits
of which each sample turns one over; the number of bits in which two sketches differ tells how many samples differ, most
exactly for similar sets. A second one folds the set itself: it never differs in more bits than the sets have elements apart,
so it passes over no similar pair, and for sets up to its own size it passes over nearly all others. Pairs that pass both are
compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import LOWER, chunks, mix, shingle_hashes, single_spaced, span_hashes, words
from millrace.llm.components import components
from millrace.session import cut_lineage

SHINGLE = 2
#: Copies share at least so much of their shingles: a fraction, so that the check is exact.
SIMILAR = (4, 5)
#: Of pairs with a similarity of 0.8, (1 - 0.8**8)**80 = 4e-7 agree in no band.
BANDS = 80
BAND_ROWS = 8
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 2048
#: Pairs whose samples' sketches differ in more bits are passed over: as many as a similarity of 0.68 gives on average, five
#: standard deviations beyond what 0.8 gives.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * 0.32 / SKETCH_BITS)))
#: Rows of a block when the sketches of a large group are compared.
BLOCK_ROWS = 2048
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)).astype(np.uint32)[:, None] | np.uint32(1)
_SALTS = mix(np.arange(10001, SAMPLES + 10001, dtype=np.uint64)).astype(np.uint32)[:, None]
_SLICE = 512


def shingles(texts: pa.Array, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """`(rows, hashes, first)` of runs of texts: the shingles of each, A-Z lower-cased; fewer words are one shingle."""
    for chunk in chunks(texts):
        data, begin = single_spaced(LOWER[chunk.data], chunk.begin)
        own = words(data, begin)
        word = span_hashes(data, own.start, own.end)
        hashes, text = shingle_hashes(word, own.first, size)
        few = np.flatnonzero((own.count > 0) & (own.count < size))
        short = word[own.first[few]] if len(few) else np.zeros(0, np.uint64)
        for k in range(1, size - 1):
            more = np.flatnonzero(own.count[few] > k)
            short[more] = mix(short[more] * np.uint64(0x9DDFEA08EB382D69) + word[own.first[few[more]] + k])
        # a run of fewer words is no shingle of a longer text
        short = mix(short + own.count[few].astype(np.uint64))
        text = np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        yield chunk.rows, np.concatenate([hashes, short])[order], np.searchsorted(text[order], np.arange(chunk.n + 1))


def shingle_sets(texts: pa.Array, size: int) -> list[bytes]:
    """The sorted 64-bit hashes of each text's different shingles."""
    return [np.unique(h[a:b]).tobytes() for _, h, first in shingles(texts, size) for a, b in zip(first[:-1], first[1:])]


def minima(own: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    own = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), _SLICE):
        np.minimum(out, ((own[None, at : at + _SLICE] ^ _SALTS) * _FACTORS).min(axis=1), out=out)
    return out


def parities(place: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, the parity of the number of times that each of `SKETCH_BITS` places occurs, as bytes of bits."""
    odd = np.bincount(row * SKETCH_BITS + place, minlength=rows * SKETCH_BITS).reshape(rows, SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), axis=1)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of each row of samples."""
    place = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return parities(place.astype(np.int64).ravel(), np.repeat(np.arange(len(samples)), SAMPLES), len(samples))


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The odd sketch of each whole set."""
    place = np.concatenate([np.zeros(0, np.uint64), *sets]) % np.uint64(SKETCH_BITS)
    return parities(place.astype(np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))


def band_keys(samples: np.ndarray) -> np.ndarray:
    bands = samples.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), bands.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + bands[:, :, k])
    return key


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`(doc_id, text_hash, n, node, sketch, bands)` of every row, written to the shared folder: the number of distinct
    shingles, a hash of their set, its two odd sketches and its band keys; the last three are null for texts without words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, first in shingles(batch.column("text"), size):
                ids = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "text_hash")]
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
                n = np.array([len(s) for s in sets])
                sets = [s for s in sets if len(s)]
                samples = np.array([minima(s) for s in sets], np.uint32).reshape(-1, SAMPLES)
                at = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), mask=n == 0)
                node = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
                sketch = pa.array([x.tobytes() + y.tobytes() for x, y in zip(odd_sketches(samples), set_sketches(sets))], pa.binary())
                keys = band_keys(samples).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), node.take(at), sketch.take(at), bands.take(at)], ["doc_id", "text_hash", "n", "node", "sketch", "bands"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, n long, node long, sketch binary, bands array<long>"
    return cut_lineage(rows.mapInArrow(run, schema), "sketched")


def representatives(rows: DataFrame) -> DataFrame:
    """`(node, low, copies)`: the row of the smallest id of each node as `(null, doc_id, text_hash)`, and its number of rows."""
    held = rows.where("node is not null").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "copies"))
    return cut_lineage(held.groupBy("node").agg(low.alias("low")).select("node", "low", "low.copies"), "nodes")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The distinct `(key, node)` of keys that two nodes or more have."""
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    return cut_lineage(keys.join(shared, "key").distinct(), "members")


def sketches_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """`(node, sketch)` of the nodes of `members`, with their number of shingles: a struct `(n, bits)`."""
    some = rows.select("node", F.struct("n", F.col("sketch").alias("bits")).alias("sketch")).join(members.select("node").distinct(), "node", "left_semi")
    return cut_lineage(some.dropDuplicates(["node"]), "sketches")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """`(node, shingles)`: the whole sets of the nodes of `members`, from the text of each node's representative."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    some = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("low.doc_id").alias("id"), F.col("low.text_hash").alias("hash"))
    texts = rows.join(some, rows["text_hash"].eqNullSafe(some["hash"]) & rows["doc_id"].eqNullSafe(some["id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(shingle_sets(batch.column("text"), size), pa.binary())], ["node", "shingles"])

    # a repeated row gives its node twice
    return cut_lineage(texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs with the value of both ends as `x` and `y`."""
    one = table.select(F.col("node").alias("a"), F.col(value).alias("x"))
    other = table.select(F.col("node").alias("b"), F.col(value).alias("y"))
    return pairs.join(one, "a").join(other, "b")


class Sketches:
    """The sketches of some nodes as arrays."""

    def __init__(self, column: pa.Array):
        raw = b"".join(column.field("bits").to_pylist())
        bits = np.frombuffer(raw, np.uint64).reshape(len(column), -1)
        half = SKETCH_BITS // 64
        self.n, self.samples, self.sets = column.field("n").to_numpy(zero_copy_only=False), bits[:, :half], bits[:, half:]

    def close(self, mine, other: "Sketches", theirs) -> np.ndarray:
        """Which pairs can be similar: sets of sizes x and y are if they have at most (x + y) / 9 elements apart."""
        part, whole = SIMILAR
        apart = np.bitwise_count(self.sets[mine] ^ other.sets[theirs]).sum(axis=-1, dtype=np.int64)
        near = (whole + part) * apart <= (whole - part) * (self.n[mine] + other.n[theirs])
        return near & (np.bitwise_count(self.samples[mine] ^ other.samples[theirs]).sum(axis=-1, dtype=np.int64) <= MOST_BITS)


def close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The `(a, b)` whose sketches differ in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (Sketches(batch.column(c)) for c in "xy")
            yield batch.select(["a", "b"]).filter(pa.array(x.close(slice(None), y, slice(None))))

    return _with(pairs, sketches, "sketch").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The `(a, b)` whose whole sets are similar enough."""
    part, whole = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(x) + len(y)
                fits = whole * min(len(x), len(y)) >= part * max(len(x), len(y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if fits else 0
                good.append(fits and whole * shared >= part * (n - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _with(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def first_of(members: DataFrame, order: Column) -> DataFrame:
    """`(key, pivot)`: the node of each key that comes first."""
    return members.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))


def close_in_groups(members: DataFrame, sketches: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The distinct `(a, b)`, a < b, that share a key, have different labels and close sketches. `members`: `(key, node, label)`.

    Large groups are cut into blocks and every two blocks meet in one task, where their sketches are compared as bits; only
    close pairs become rows. So the work on unlike nodes that share a key is one bit count for each pair, never a row.
    """
    sized = members.join(members.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = met.select(task.alias("task"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label").join(sketches, "node")
    dealt = dealt.select("task", "key", "i", "j", "own", "node", "label", "sketch").repartition("task").sortWithinPartitions("task", "key", "i", "j")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        own, i, node, label = (rows.column(c).to_numpy() for c in ("own", "i", "node", "label"))
        held, left = Sketches(rows.column("sketch").combine_chunks()), own == i
        same = rows.column("j")[0].as_py() == i[0]
        rest = np.flatnonzero(left if same else ~left)
        found = []
        for at in np.flatnonzero(left):
            other = rest[label[rest] != label[at]]
            other = other[node[other] > node[at]] if same else other
            near = other[held.close(at, held, other)]
            found.append(np.stack([np.full(len(near), node[at]), node[near]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            marks = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for start, end in zip([0, *cuts[:-1]], cuts):
                yield compare(held.slice(start, end - start))
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and held.num_rows:
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`(key, node, label)` of the keys under which two components or more meet."""
    own = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    mixed = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return own.join(mixed, "key")


def _joined(pairs: DataFrame, sets: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """`(links, roots)`: links with the components of all similar pairs among `pairs` and `known`, and those components. Each
    node is compared with the first of its partners, and with the others only if they are in another component then."""
    best = cut_lineage(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")), sets), "links")
    links = best if known is None else known.unionByName(best)
    roots = components(links)
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = cut_lineage(confirmed(apart, sets), "links")
    if more.isEmpty():
        return links, roots
    links = links.unionByName(more)
    return links, components(links)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` of every row: the smallest id that links reach, the own one included.

    Two rows are linked if their sets of distinct shingles of `size` words have a Jaccard similarity of 0.8 or more. The
    nodes of a key are first compared with one of them, which joins groups of copies by as many comparisons as they have
    nodes; only where components still meet under a key are all its sketches compared. Links that would join what is
    joined already are not looked at. Null texts and texts without words are linked with nothing and keep their own id;
    fewer words are one shingle; null ids count as larger than all others; repeated rows stay repeated; an empty table
    gives no rows.
    """
    rows = sketched(docs, id_col, text_col, size)
    nodes = representatives(rows)
    members = shared_keys(rows.where("node is not null").select("node", F.explode("bands").alias("key")))
    sketches = sketches_of(rows, members)
    sets = sets_of(docs, id_col, text_col, size, nodes, members)
    stars = members.join(first_of(members, F.xxhash64("node")), "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut_lineage(close_pairs(stars, sketches), "stars")
    links, roots = _joined(stars, sets, None)
    rest = cut_lineage(close_in_groups(_labelled(members, roots), sketches), "close")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut_lineage(rest.join(tried, ["a", "b"], "left_anti"), "close")
    if not rest.isEmpty():
        links, roots = _joined(rest, sets, links)
    member = nodes.join(roots, "node", "left").select("node", F.col("low.doc_id").alias("low"), F.coalesce("root", "node").alias("root"))
    label = member.join(member.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    worded = rows.where("node is not null").join(label, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return worded.unionByName(rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
