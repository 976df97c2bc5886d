"""Near copies: 64-bit SimHash fingerprints, found by vantage-point trees over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import LOWER, chunks, single_spaced, words
from millrace.llm.components import components
from millrace.llm.rows import first_by_hash, one_of_each
from millrace.session import cut_lineage

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Rows that a shard of the tree should keep. A block has at most twice as many that are kept and `ASKED` times as many
#: that ask.
LEAF_ROWS = 4096
ASKED = 16
#: Fingerprints from which vantage points and medians are taken; all fingerprints are indexed.
SAMPLE_ROWS = 1 << 15
_SLICE = 1 << 16


def simhash(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a batch of texts (null: empty). A bit is set if set in over half the XXH64 of the
    shingles of words, A-Z lower-cased; a text of fewer words is one shingle, one without words gives zero."""
    out = np.zeros(len(text), np.uint64)
    digest = xxhash.xxh64_intdigest
    for chunk in chunks(text):
        data, begin = single_spaced(LOWER[chunk.data], chunk.begin)
        own = words(data, begin)
        raw = data.tobytes()
        for i, (first, count) in enumerate(zip(own.first.tolist(), own.count.tolist())):
            if not count:
                continue
            n = max(count - shingle + 1, 1)
            ones = np.zeros(64, np.int64)
            for at in range(first, first + n, _SLICE):
                to = min(at + _SLICE, first + n)
                last = min(shingle, count) - 1
                spans = zip(own.start[at:to].tolist(), own.end[at + last : to + last].tolist())
                h = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), ">u8", to - at)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            bits = np.packbits(2 * ones > n)
            out[chunk.rows.start + i] = bits.view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`(doc_id, text_hash, fingerprint)` of every row, repeated rows and null ids included. `text_hash` tells
    rows of one id with different texts apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(simhash(batch.column("text"), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fingerprint"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fingerprint long")


class Tree(NamedTuple):
    """A complete binary tree in heap order. At node k, what lies within `median[k]` of `vantage[k]` goes left."""

    levels: int
    vantage: np.ndarray
    median: np.ndarray


def plant(codes: np.ndarray, levels: int) -> Tree:
    """Vantage points and medians from a sample; a node whose codes are all alike sends everything left."""
    nodes = (1 << levels) - 1
    vantage, median = np.zeros(nodes, np.uint64), np.full(nodes, 64, np.int64)
    parts = {0: np.sort(codes)}
    for k in range(nodes):
        own = parts.pop(k, codes[:0])
        if len(own):
            vantage[k] = own[int(mix_int(k)) % len(own)]
            d = np.bitwise_count(own ^ vantage[k])
            # the cut nearest to half of the rows
            below = np.cumsum(np.bincount(d, minlength=66))[:65]
            best = int(np.argmin(np.abs(2 * below - len(own))))
            if 0 < below[best] < len(own):
                median[k] = best
            parts[2 * k + 1], parts[2 * k + 2] = own[d <= median[k]], own[d > median[k]]
    return Tree(levels, vantage, median)


def mix_int(k: int) -> int:
    return xxhash.xxh32_intdigest(k.to_bytes(8, "little"), SEED)


def home(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The shard in which each code is kept."""
    node = np.zeros(len(codes), np.int64)
    for _ in range(tree.levels):
        d = np.bitwise_count(codes ^ tree.vantage[node])
        node = 2 * node + 1 + (d > tree.median[node])
    return node


def visits(tree: Tree, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """`(position, shard)` for every shard that can hold a code within the radius: by the triangle inequality a
    branch is left out only if all in it lie further than the radius."""
    at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for _ in range(tree.levels):
        d = np.bitwise_count(codes[at] ^ tree.vantage[node]).astype(np.int64)
        left, right = d - radius <= tree.median[node], d + radius > tree.median[node]
        at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return at, node


def _halves(fp: np.ndarray, tree: int) -> np.ndarray:
    return fp >> np.uint64(32) if tree == 0 else fp & np.uint64(0xFFFFFFFF)


def linked(kept: np.ndarray, asked: np.ndarray, radius: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """`(fingerprint, root)`: a forest that joins what the pairs of a block join that lie within the radius, and within
    half of it in the tree's half; it has at most a row for each fingerprint, however many pairs there are."""
    names = np.unique(np.concatenate([kept, asked]))
    root = np.arange(len(names))
    rows, cols = np.searchsorted(names, kept), np.searchsorted(names, asked)
    own, other = (_halves(fp, tree).astype(np.uint32) for fp in (kept, asked))
    step = max((1 << 20) // max(len(asked), 1), 1)
    for at in range(0, len(kept), step):
        i, j = np.nonzero(np.bitwise_count(own[at : at + step, None] ^ other[None, :]) <= radius // 2)
        near = np.bitwise_count(kept[at + i] ^ asked[j]) <= radius
        i, j = rows[at + i[near]], cols[j[near]]
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    joined = np.flatnonzero(root != np.arange(len(names)))
    return names[joined], names[root[joined]]


def links(prints: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`(a, b)` of distinct fingerprints whose connected components are those of all pairs within the radius.

    Two fingerprints within three bits agree to within one bit in one of their 32-bit halves. So there is a tree for
    each half, searched with radius one: far fewer shards overlap than with radius three over 64 bits. Every
    fingerprint is kept in one shard of each tree and asked of all shards that the triangle bounds leave.
    Larger shards are cut into blocks on both sides and every pair of blocks is compared, so no group holds more
    than two blocks, whatever the distribution. `prints`: one column `fingerprint`, distinct.
    """
    total = prints.count()
    near = radius // 2
    some = first_by_hash(prints, sample_rows, "fingerprint")
    sample = np.array([r[0] for r in some.collect()], np.int64).view(np.uint64)
    levels = max(0, min(int(np.ceil(np.log2(max(total, 1) / leaf_rows))), int(np.log2(max(len(sample), 8) / 8))))
    trees = [plant(_halves(sample, k), levels) for k in (0, 1)]

    def routed(batches):
        for batch in batches:
            fp = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                codes = _halves(fp, k)
                yield k, False, fp, home(tree, codes)
                at, shard = visits(tree, codes, near)
                yield k, True, fp[at], shard

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, asked, _, shard in routed(batches):
            leaf, n = np.unique(shard, return_counts=True)
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(leaf), k), "asked": np.full(len(leaf), asked), "shard": leaf, "n": n})

    counted = prints.mapInArrow(sizes, "tree long, asked boolean, shard long, n long").groupBy("tree", "asked", "shard").agg(F.sum("n").alias("n"))
    # a row for each shard: at most 4 * 2**levels, bounded by the sample
    most = {False: 2 * leaf_rows, True: ASKED * leaf_rows}
    blocks = {(r.tree, r.asked, r.shard): -(-r.n // most[r.asked]) for r in counted.collect()}
    many = {k: v for k, v in blocks.items() if v > 1}

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, asked, fp, shard in routed(batches):
            own = np.array([many.get((k, asked, s), 1) for s in shard.tolist()], np.int64)
            other = np.array([many.get((k, not asked, s), 1) for s in shard.tolist()], np.int64)
            block = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % own
            row = np.repeat(np.arange(len(fp)), other)
            across = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
            key = (k << 62) | (shard[row] << 32) | (np.where(asked, across, block[row]) << 16) | np.where(asked, block[row], across)
            yield pa.RecordBatch.from_pydict({"task": key, "asked": np.full(len(row), asked), "fp": fp[row].view(np.int64)})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp, asked = rows["fp"].to_numpy().view(np.uint64), rows["asked"].to_numpy()
        a, b = linked(fp[~asked], fp[asked], radius, int(rows["task"].iat[0]) >> 62)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(blocked, "task long, asked boolean, fp long").groupBy("task").applyInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, **sizes) -> DataFrame:
    """`(doc_id, text_hash, fingerprint, root, component_id)` for every row: the smallest fingerprint and the smallest
    id that links of at most `radius` bits reach, the own ones included.

    Equal fingerprints are gathered first, so copies cost one row in the search, however many there are. Null and
    empty texts have the fingerprint zero and are linked like any other; null ids count as larger than all others;
    repeated rows give repeated rows; an empty table gives none. Fingerprints count as signed numbers here.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "fingerprints")
    roots = components(links(distinct.select("fingerprint"), radius, **sizes))
    member = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    label = member.join(least, "root").select("fingerprint", "root", "component_id")
    return prints.join(label, "fingerprint", "left").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **sizes) -> DataFrame:
    """The rows of `docs`, one of each group of near copies: the one whose id is the component's. Of rows that share
    that id, and of groups without any id, one is kept."""
    found = grouped(docs, id_col, text_col, radius, **sizes)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
    chosen = own.agg(F.first("doc_id").alias("id"), F.min("text_hash").alias("hash"), F.count("*").alias("copies")).drop("root")
    return one_of_each(docs, chosen, id_col, text_col)
