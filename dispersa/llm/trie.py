"""Conversation prefix trie: double arrays over range shards of turn sequences, shared upper nodes merged in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import drop_table, give_back, materialise

#: Turns of the sequences in one shard's double array.
SHARD_TURNS = 50_000

#: Ids of one range of 2^12 are joined to one text before the ids of equal sequences meet.
RANGE_BITS = 12

#: Free slots at which a node of several children is tried before it goes to the end of the arrays.
TRIES = 32

NODE = "edge boolean, key string, up string, conv_id long, depth long, parent_conv_id long, n long, children long, leaves long, saved long, size long, ends string"


class DoubleArray:
    """BASE and CHECK: the child of node s by code c is at base[s] + c, which is a child of s only if check says so."""

    def __init__(self, room: int):
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0], self.free, self.end = 0, 1, 1  # the root stands at 0; no slot before `free` is free, all from `end` on are

    def _grow(self, least: int) -> None:
        more = max(least, 2 * len(self.check)) - len(self.check)
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        holes = self.free + np.flatnonzero(self.check[self.free : self.end] < 0)[:n]
        return np.concatenate([holes, np.arange(self.end, self.end + n - len(holes))])

    def _take(self, slots: np.ndarray, parents: np.ndarray) -> None:
        high = int(slots.max()) + 1
        if high > len(self.check):
            self._grow(high)
        self.check[slots] = parents
        self.end = max(self.end, high)

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of one level, those of a parent side by side."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        many = np.diff(np.concatenate([first, [len(parents)]]))
        for low, n in zip(first[many > 1].tolist(), many[many > 1].tolist()):
            own = codes[low : low + n]
            shape = own - own.min()
            for slot in self._free(TRIES).tolist():
                at = slot + shape
                inside = at[at < self.end]
                if (self.check[inside] < 0).all():
                    break
            else:
                at = self.end + shape
            self.base[parents[low]] = at[0] - own[0]
            self._take(at, parents[low])
        alone = first[many == 1]
        if len(alone):
            at = self._free(len(alone))
            self._take(at, parents[alone])
            self.base[parents[alone]] = at - codes[alone]
            self.free = int(at[-1])

    def child(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by codes, -1 where there is none."""
        at = self.base[nodes] + codes
        there = (at > 0) & (at < len(self.check))
        return np.where(there & (self.check[np.where(there, at, 0)] == nodes), at, -1)


def _levels(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each depth with the rows that are longer."""
    rows, depth = np.flatnonzero(sizes > 0), 0
    while len(rows):
        yield depth, rows
        depth += 1
        rows = rows[sizes[rows] > depth]


def pack(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """Double array of sequences in lexicographic order, and the dense turn ids that it is built over, numbered level by level."""
    trie, dense, fresh = DoubleArray(len(codes) + 16), np.full(int(codes.max(initial=-1)) + 1, -1, np.int64), 0
    node = np.zeros(len(sizes), np.int64)
    for depth, rows in _levels(sizes):
        turn, parent = codes[starts[rows] + depth], node[rows]
        new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (parent[1:] != parent[:-1])])
        unseen, at = np.unique(turn[dense[turn] < 0], return_index=True)
        dense[unseen[np.argsort(at)]] = np.arange(fresh, fresh + len(unseen))
        fresh += len(unseen)
        trie.add(parent[new], dense[turn[new]])
        node[rows] = trie.child(parent, dense[turn])
    return trie, dense


def _paths(keys: list[str]) -> list[str]:
    """Digests of all prefixes of a sequence, the empty one first."""
    state, out = hashlib.sha256(), []
    for key in ["", *keys]:
        state.update(key.encode())
        out.append(state.hexdigest())
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard of distinct sequences in order; those on the first and on the last sequence may go on in other shards."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    lists = rows.column("keys").combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    sizes, starts = np.diff(starts), starts[:-1] - starts[0]
    turns = lists.flatten().dictionary_encode()
    codes = turns.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = rows.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    times, first = rows.column("n").to_numpy(), rows.column("first").to_numpy()
    trie, dense = pack(codes, starts, sizes)

    slots = len(trie.check)
    n, conv = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    own, depth_of, last = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(len(sizes), np.int64)
    edge, rows_at = np.zeros(slots, bool), []
    n[0], conv[0], edge[0] = times.sum(), first.min(), True
    names = {0: _paths([])[0]}
    ends = {i: _paths([turns.dictionary[int(c)].as_py() for c in codes[starts[i] : starts[i] + sizes[i]]]) for i in {0, len(sizes) - 1}}
    for depth, longer in _levels(sizes):
        at = starts[longer] + depth
        node = trie.child(last[longer], dense[codes[at]])
        np.add.at(n, node, times[longer])
        np.minimum.at(conv, node, first[longer])
        own[node], depth_of[node], last[longer] = size[at], depth + 1, node
        rows_at.append(np.unique(node))
        for i, path in ends.items():
            if sizes[i] > depth:
                edge[last[i]] = True
                names[int(last[i])] = path[depth + 1]
    up, children = trie.check, np.zeros(slots, np.int64)
    leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for node in reversed(rows_at):
        node = node[~edge[node]]
        leaves[node] += children[node] == 0
        saved[node] += (n[node] - 1) * own[node]
        for kept in (leaves, saved):
            np.add.at(kept, up[node], kept[node])
        np.add.at(children, up[node], 1)
    done = np.full(slots, -1, np.int64)
    done[last] = np.arange(len(last))
    hashes = rows.column("ends").combine_chunks()
    for node in [np.zeros(1, np.int64), *rows_at]:
        outer, above = edge[node], edge[up[node]]
        key = pa.array([names[x] if e else None for x, e in zip(node.tolist(), outer.tolist())], pa.string())
        parent = pa.array([names[x] if e and y else None for x, e, y in zip(up[node].tolist(), above.tolist(), node.tolist())], pa.string())
        ended = hashes.take(pa.array(done[node], mask=done[node] < 0))
        columns = [outer, key, parent, conv[node], depth_of[node], pa.array(conv[up[node]], mask=above), n[node], children[node], leaves[node], saved[node], own[node], ended]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each key; rows come sorted by key and are hashed as they pass."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[str, str]] = []
        for same, ids in zip(batch.column("same").to_pylist(), batch.column("ids").to_pylist()):
            if same == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = same, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["same", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["same", "ends"])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): digests of a conversation's (role, text) turns in order, and the texts' UTF-8 bytes.

    Turns go by turn number, null first, then by role, then by digest. Null role or text is empty. Rows without conv_id belong to no
    conversation. A repeated row is a turn of its own. Other columns are ignored. A conversation is one row of 32 characters a turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    named = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    sorted_turns = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return sorted_turns.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5 in place of as many of its own."""
    head = sequences.select(F.col("conv_id").alias("_from"), F.slice("keys", 1, 8).alias("_keys"), F.slice("sizes", 1, 8).alias("_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    both = sequences.withColumn("_h", h).join(head, F.expr("conv_id - conv_id % 5 = _from"), "left")
    join = lambda own, their: F.concat(F.coalesce(F.slice(their, F.lit(1), F.col("_h")), F.slice(own, 1, 0)), F.slice(own, F.col("_h") + 1, F.size(own)))
    return both.select("conv_id", join("keys", "_keys").alias("keys"), join("sizes", "_sizes").alias("sizes"))


def _distinct(sequences: DataFrame) -> DataFrame:
    """(keys, sizes, n, first, ends): each sequence once, with its conversations' number, least id and digest of ids."""
    rows = materialise(sequences.withColumn("same", F.md5(F.array_join("keys", "").cast("binary"))))
    counted = rows.groupBy("same").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = rows.groupBy("same", F.shiftright("conv_id", RANGE_BITS).alias("part")).agg(ids.alias("ids"))
    ends = chunks.repartition("same").sortWithinPartitions("same", "part").select("same", "ids").mapInArrow(_digests, "same string, ends string")
    one = rows.join(counted.withColumnRenamed("same", "_same"), F.expr("conv_id = first AND same = _same"))
    found = materialise(one.join(ends, "same").select("keys", "sizes", "n", "first", "ends"))
    drop_table(rows)
    return found


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(key, leaves, saved) summed over each node and all below it: distances double with each round, so rounds are log2 of the depth."""
    state = materialise(nodes.select("key", "up", "leaves", "saved"))
    while not state.where("up IS NOT NULL").isEmpty():
        gain = state.where("up IS NOT NULL").groupBy(F.col("up").alias("_key")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        above = state.select(F.col("key").alias("_up"), F.col("up").alias("_next"))
        nearer = state.join(gain, F.col("key") == F.col("_key"), "left").join(above, F.col("up") == F.col("_up"), "left")
        added = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")]
        state, old = materialise(nearer.select("key", F.col("_next").alias("up"), *added)), state
        drop_table(old)
    return state.select("key", "leaves", "saved")


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, keys, sizes): members, children, leaves and the bytes that sharing prefixes saves.

    Equal sequences are one row first, whatever their number. Sequences are then dealt by ranges of their order, so a prefix of any
    weight is split over shards. A shard packs its sequences into a double array, walks all of them through it and sums up what
    lies below each node. Nodes on a shard's first and last sequence can go on in its neighbours: these few are merged by digests
    of their paths, and their subtrees are summed by doubling. No conversation at all: no node, not even a root.
    """
    unique = _distinct(sequences)
    turns = unique.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0]
    shards = -(-turns // shard_turns) or 1
    dealt = unique.repartitionByRange(shards, "keys").sortWithinPartitions("keys")
    nodes = materialise(dealt.mapInArrow(give_back(_shard), NODE))
    met = nodes.where("edge").groupBy("key").agg(
        F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("ends").alias("ends"),
    )
    below = met.where("up IS NOT NULL").groupBy(F.col("up").alias("_of")).agg(F.count("*").alias("_more"))
    upper = met.join(below, F.col("key") == F.col("_of"), "left").withColumn("children", F.col("children") + F.coalesce("_more", F.lit(0)))
    upper = materialise(upper.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size")).drop("_of", "_more"))
    summed = upper.drop("leaves", "saved").join(_subtree_sums(upper), "key")
    parents = upper.select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ends"]
    inner = nodes.where("NOT edge").join(parents, "up", "left").withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id"))
    outer = summed.join(parents, "up", "left").withColumn("parent_conv_id", F.col("_parent"))
    both = inner.select(columns).union(outer.select(columns))
    named = both.withColumnsRenamed({"n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"})
    return named.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))).drop("ends")
