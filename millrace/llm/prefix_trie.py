"""Prefix trie of conversations: range shards of encoded turns, a ternary search tree in each, and nodes on the cuts merged.

Turns are numbered by a dictionary of their distinct (role, text); a conversation is its list of numbers. The lists are sorted
and cut into ranges, so a node of the trie lies in one shard or in neighbours. Every measure of a node is a sum or a minimum
over its shards once each shard knows how much of its first and last list its neighbours share: a node counts where its first
list lies, a leaf where its last one does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import mix
from millrace.llm.rows import numbered, word_count
from millrace.session import cut_lineage

#: Conversations that shed their own first turns for those of the first of each run of so many ids.
RUN = 20
#: Turns that a shard should hold.
SHARD_TURNS = 400_000


def turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """`(conv_id, ids, words)`: the turns of each conversation as numbers of a dictionary, and the words of each turn's text.

    Null roles and texts are empty. Turns go by their number, null first, and equal numbers by their place in the
    dictionary. Rows without a conversation belong to none.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    # the length of the role keeps apart what would read alike when joined
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    own = rows.where(F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), said.alias("said"), word_count(text).alias("words"))
    own = cut_lineage(own, "turns")
    entries = numbered(own.groupBy("said").agg(F.first("words").alias("words")).select("said"), F.col("said"), "id")
    listed = own.join(entries, "said").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t"))
    return cut_lineage(listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")), "conversations")


def rebuilt(convs: DataFrame, run: int = RUN) -> DataFrame:
    """The conversations with their first turns from the first one of their run of ids: as many as the remainder by 4 of the
    CRC-32 of their id says, or all if it has fewer; then what is left of their own without as many first turns."""
    head = convs.where(F.col("conv_id") % run == 0).select(F.col("conv_id").alias("first"), F.col("ids").alias("head"), F.col("words").alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = convs.join(head, F.col("conv_id") - F.col("conv_id") % run == F.col("first"), "left")

    def joined(head: str, own: str) -> Column:
        return F.concat(F.coalesce(F.slice(head, F.lit(1), h), F.array().cast("array<long>")), F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0))))

    return both.select("conv_id", joined("head", "ids").alias("ids"), joined("head_words", "words").alias("words"))


def shards(convs: DataFrame, shard_turns: int) -> DataFrame:
    """`(shard, conv_id, ids, words, before, after)`: ranges of the sorted lists, equal ones by id, with the number of turns
    that the first list of a shard shares with the list before it, and its last one with the one behind; -1 at the ends."""
    total = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    cut = convs.repartitionByRange(max(1, -(-total // shard_turns)), "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    cut = cut_lineage(cut, "shards")
    ends = cut.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    order = Window.orderBy("shard")  # over one row for each shard

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        at = F.array_position(same, False)
        return F.coalesce(F.when(at > 0, at - 1).otherwise(F.size(same)), F.lit(-1)).cast("long")

    known = ends.select("shard", shared(F.lag("high").over(order), F.col("low")).alias("before"), shared(F.col("high"), F.lead("low").over(order)).alias("after"))
    return cut.join(known, "shard")


class Tree(NamedTuple):
    """A ternary search tree: lower, equal and higher neighbour of each place (0: none), its turn, words, and the lists ending there."""

    low: list[int]
    same: list[int]
    high: list[int]
    turn: list[int]
    words: list[int]
    ends: list[list[int]]


def planted(lists: list[tuple[int, ...]], words: list[list[int]]) -> tuple[Tree, list[int]]:
    """The tree of sorted, distinct lists, and the place of each list's last turn (0 for the empty one). Medians go first, so
    the neighbours of a place are balanced."""
    tree = Tree([0], [0], [0], [0], [0], [[]])
    place = [0] * len(lists)
    stack = [(0, len(lists))]
    while stack:
        a, b = stack.pop()
        if a >= b:
            continue
        k = (a + b) // 2
        stack += [(a, k), (k + 1, b)]
        at = 0
        for turn, n in zip(lists[k], words[k]):
            links, up = tree.same, at
            at = links[up]
            while at and tree.turn[at] != turn:
                links, up = (tree.low if turn < tree.turn[at] else tree.high), at
                at = links[up]
            if not at:
                at = links[up] = len(tree.turn)
                for column, value in zip(tree, (0, 0, 0, turn, n, [])):
                    column.append(value)
        place[k] = at
    return tree, place


_COLUMNS = "depth conv_id parent_conv_id n_convs n_children n_leaves saved_tokens".split()
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS) + ", ends_sha256 string, ends binary, shard long, key binary, parent_key binary"


def _keys(turns: list[int], key: list[int], up: int) -> int:
    """A 128-bit name of the path to a place, from its parent's."""
    one, other = (mix(np.array([(key[up] >> s & (1 << 64) - 1) ^ int(mix(np.array([turns + f], np.uint64))[0])], np.uint64))[0] for s, f in ((64, 1), (0, 1 << 40)))
    return int(one) << 64 | int(other)


def measured(shard: int, ids: list[list[int]], words: list[list[int]], convs: list[int], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard. Those that a neighbour has as well come with `key` and with what this shard adds to them: sums, the
    smallest member, and the members that end there as text. Others are whole; `parent_key` is set where the parent is not."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k], convs[k]))
    lists, own, ends = [], [], []
    for k in order:
        if not lists or lists[-1] != ids[k]:
            lists.append(ids[k])
            own.append(words[k])
            ends.append([])
        ends[-1].append(convs[k])
    tree, place = planted(lists, own)
    for at, members in zip(place, ends):
        tree.ends[at] = members
    # parents come before their children
    visit, up, depth = [0], {0: 0}, {0: 0}
    for at in visit:
        stack = [tree.same[at]]
        while stack:
            k = stack.pop()
            if k:
                visit.append(k)
                up[k], depth[k] = at, depth[at] + 1
                stack += [tree.low[k], tree.high[k]]

    def path(of: list[int], n: int) -> list[int]:
        """The places of the first `n` turns of a list, the root before them."""
        found = [0] if n >= 0 else []
        for turn in of[: max(n, 0)]:
            at = tree.same[found[-1]]
            while tree.turn[at] != turn:
                at = tree.low[at] if turn < tree.turn[at] else tree.high[at]
            found.append(at)
        return found

    head, tail = path(lists[0], before), path(lists[-1], after)
    foreign, cut = set(head), {*head, *tail}
    # the last list ends at a place that goes on in the next shard
    unsure = place[-1] if after >= len(lists[-1]) else -1
    size = len(tree.turn)
    members, low, children, leaves, spent = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for at in reversed(visit):
        members[at] += len(tree.ends[at])
        low[at] = min((v for v in (low[at], *tree.ends[at][:1]) if v is not None))
        leaves[at] += not tree.same[at] and at != unsure
        spent[at] += (members[at] - (at not in foreign)) * tree.words[at]
        if at:
            to = up[at]
            members[to] += members[at]
            low[to] = low[at] if low[to] is None else min(low[to], low[at])
            children[to] += at not in foreign
            leaves[to] += leaves[at]
            spent[to] += spent[at]
    key = [0] * size
    for at in [*head[1:], *tail[1:]]:
        key[at] = _keys(tree.turn[at], key, up[at])
    name = lambda at: key[at].to_bytes(16, "big") + depth[at].to_bytes(8, "big") if at in cut else None
    rows = []
    for at in visit:
        text = ",".join(map(str, tree.ends[at])).encode()
        whole = at not in cut
        parent = None if at == 0 or up[at] in cut else low[up[at]]
        sha, ended = (hashlib.sha256(text).hexdigest(), None) if whole else (None, text)
        rows.append((depth[at], low[at], parent, members[at], children[at], leaves[at], spent[at], sha, ended, shard, name(at), name(up[at]) if at else None))
    names = [*_COLUMNS, "ends_sha256", "ends", "shard", "key", "parent_key"]
    kinds = [pa.int64()] * len(_COLUMNS) + [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def _one_shard(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in ("shard", "before", "after")}
    found = measured(first["shard"], *(table.column(c).to_pylist() for c in ("ids", "words", "conv_id")), first["before"], first["after"])
    return pa.Table.from_batches([found])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key, in the order of their shards, become one. Only sums and the state of the digest are held."""
    held, digest, sums = None, None, None

    def done() -> pa.RecordBatch:
        depth, parent_key = sums["depth"], sums["parent_key"]
        values = [depth, sums["conv_id"], None, *(sums[c] for c in _COLUMNS[3:]), digest.hexdigest(), None, None, held, parent_key]
        names = [*_COLUMNS, "ends_sha256", "ends", "shard", "key", "parent_key"]
        kinds = [pa.int64()] * len(_COLUMNS) + [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in (*_COLUMNS, "ends", "key", "parent_key")}
            if row["key"] != held:
                if held is not None:
                    yield done()
                held, digest, sums = row["key"], hashlib.sha256(), row
                digest.update(row["ends"])
                some = bool(row["ends"])
                continue
            sums["conv_id"] = min(sums["conv_id"], row["conv_id"])
            for c in _COLUMNS[3:]:
                sums[c] += row[c]
            if row["ends"]:
                digest.update(b"," * some + row["ends"])
                some = True
    if held is not None:
        yield done()


def trie(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    run: int = RUN,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """`(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)` of every node of the trie of
    the rebuilt conversations, from the root of depth 0 on: its smallest member, its parent's, the numbers of members, of
    children and of childless nodes in its subtree, the words that sharing saves there, and a digest of the members that end there.

    A conversation's turns are one list of numbers, 16 bytes a turn. A shard holds about `shard_turns` of them; equal lists, however
    many, are spread over shards like others. Roles and texts may be null, turn numbers may be null or repeated (see
    `turns`); rows without a conversation are passed over; a table without any gives no rows.
    """
    lists = rebuilt(turns(rows, id_col, turn_col, role_col, text_col), run)
    dealt = shards(cut_lineage(lists, "rebuilt"), shard_turns)
    found = cut_lineage(dealt.groupBy("shard").applyInArrow(_one_shard, _SCHEMA), "nodes")
    parts = found.where("key is not null").repartition("key").sortWithinPartitions("key", "shard")
    merged = cut_lineage(parts.mapInArrow(_merged, _SCHEMA), "merged")
    every = found.where("key is null").unionByName(merged)
    parent = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("low"))
    names = ["conv_id", "depth", "parent_conv_id", *_COLUMNS[3:], "ends_sha256"]
    beyond = every.where("parent_key is not null").join(parent, "parent_key").withColumn("parent_conv_id", F.col("low"))
    return every.where("parent_key is null").select(*names).unionByName(beyond.select(*names))
