"""The prefix trie of conversations: shared beginnings, and what storing them once would save.

A node is a sequence of turns that at least one conversation starts with. Its digest is a rolling sum of
the turns' hashes, so that a conversation can be cut anywhere and each part be digested by itself. Tasks
get parts of conversations in the order of their contents and build one table for each slice: the
distinct digests get slots from a minimal perfect hash, each slot is verified against its whole digest,
depth, parent and content, counts are scattered into flat arrays by slot, and added to the parent's slot
from the deepest level up. Slices only add up what they see; one aggregation by digest joins them, and it
verifies digests between slices. After a collision all starts again with another base.

Counts and smallest members come first. With them each node belongs to its smallest member, which alone
reports its leaf and its savings in a second pass over the same slices, so nothing is counted twice.

No conversation is ever in one task: its rows are dealt by range, and rows longer than `PIECE` turns are
cut there. What a task gets of other parts of the same conversation is one number each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, query, table
from themeloom.operators.joins import salted_join

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4_096  # turns of one conversation in one row
SLICE_TURNS = 1 << 18  # turns in one table of nodes
IDS = 1 << 16  # ids joined in one row before they are hashed
P = (1 << 127) - 1
ROOT = 1
RAW = 32  # bytes of a turn's hash

CUTS = "conv_id long, part int, seq int, n int, value binary, contents binary, counts binary, whole boolean"
STARTS = "conv_id long, part int, seq int, start long, before binary, last boolean, single boolean"
PATHS = "conv_id long, g long, start long, before binary, contents binary, counts binary, single boolean, last boolean, a long, b long"
PARTS = "a long, b long, pa long, pb long, ca long, cb long, depth long, words long, n long, conv_id long, clash boolean"
SUMS = "a long, b long, leaves long, saved long"


def slim_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, content, words, tie) with a hash in place of role and text; null role or text is empty.

    Rows without conv_id belong to no conversation and are left out. `tie` numbers the rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(both, 256)).alias("content"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("tie"),
    )


# ---- digests ----


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:16], "little") % P


def roll(before: int, contents: bytes, base: int) -> list[int]:
    """The digest after each turn."""
    out = []
    for at in range(0, len(contents), RAW):
        before = (before * base + int.from_bytes(contents[at : at + 16], "little")) % P
        out.append(before)
    return out


def _packed(digest: int) -> bytes:
    return digest.to_bytes(16, "little")


def _longs(digest: int) -> tuple[int, int]:
    a, b = np.frombuffer(_packed(digest), np.int64).tolist()
    return a, b


# ---- parts of conversations ----


def _cut(base: int, piece: int):
    """Sorted rows (part, conv_id, content, words) of one task as rows of up to `piece` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = part = None
        seq, first, contents, counts = 0, True, bytearray(), []

        def close(whole: bool) -> None:
            value = 0
            for at in range(0, len(contents), RAW):
                value = (value * base + int.from_bytes(contents[at : at + 16], "little")) % P
            words = np.array(counts, np.int64).tobytes()
            out.append((conv, part, seq, len(counts), _packed(value), bytes(contents), words, whole))
            contents.clear()
            counts.clear()

        for batch in batches:
            parts, ids, hashes, words = (c.to_pylist() for c in batch.columns)
            for p, i, h, w in zip(parts, ids, hashes, words, strict=True):
                if i != conv:
                    if counts:
                        close(whole=seq == 0 and not first)
                        first = False
                    conv, part, seq = i, p, 0
                elif len(counts) == piece:
                    close(whole=False)
                    seq += 1
                contents += h
                counts.append(w)
            yield from _batches(out, CUTS)
        if counts:  # may go on in the next task
            close(whole=False)
            yield from _batches(out, CUTS)

    return run


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """The rows as one batch; the list is emptied."""
    if rows:
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
        fields = [f.split() for f in schema.split(", ")]
        columns = [pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
        rows.clear()
        yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def _starts(base: int):
    """Where the rows of one conversation start; a row of the group stands for up to `piece` turns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        start, before, rows = 0, ROOT, []
        for conv, part, seq, n, value in group.itertuples(index=False):
            rows.append((conv, part, seq, start, _packed(before), False, len(group) == 1))
            before = (before * pow(base, int(n), P) + int.from_bytes(value, "little")) % P
            start += int(n)
        rows[-1] = (*rows[-1][:5], True, rows[-1][6])
        return pd.DataFrame(rows, columns=[f.split()[0] for f in STARTS.split(", ")])

    return run


def _place(base: int, piece: int):
    """Rows cut at multiples of `piece` turns, with the digest they start from and end at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, before, at, n = r["start"], int.from_bytes(r["before"], "little"), 0, r["n"]
                while at < n:
                    stop = min(n, at + piece - (start + at) % piece)
                    part = r["contents"][at * RAW : stop * RAW]
                    end = roll(before, part, base)[-1]
                    out.append(
                        (r["conv_id"], (start + at) // piece, start + at, _packed(before), part, r["counts"][at * 8 : stop * 8],
                         r["single"] and n <= piece, r["last"] and stop == n, *_longs(end))
                    )
                    before, at = end, stop
            yield from _batches(out, PATHS)

    return run


def conversation_paths(turns: DataFrame, order: Sequence[str | Column], base: int, piece: int, stages: Stages) -> DataFrame:
    """The turns of each conversation in order, as rows of up to `piece` of them, stored.

    Conversations are dealt by range, so a long one is spread over tasks; only the few that touch the end of
    a task or are longer than a row need the numbers of their other rows.
    """
    ranged = turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    cut = stages.keep(
        ranged.select(F.spark_partition_id().alias("part"), "conv_id", "content", "words").mapInArrow(_cut(base, piece), CUTS)
    )
    some = cut.where("NOT whole")
    starts = some.select("conv_id", "part", "seq", "n", "value").groupBy("conv_id").applyInPandas(_starts(base), STARTS)
    shape = ["conv_id", "n", "contents", "counts", "start", "before", "last", "single"]
    root = F.lit(bytearray(_packed(ROOT)))
    whole = cut.where("whole").withColumns(
        {"start": F.lit(0).cast("long"), "before": root, "last": F.lit(True), "single": F.lit(True)}
    )
    all_rows = whole.select(*shape).unionByName(some.join(starts, ["conv_id", "part", "seq"]).select(*shape))
    paths = stages.keep(all_rows.mapInArrow(_place(base, piece), PATHS))
    stages.drop(cut)
    return paths


# ---- tables of nodes ----


def _spread(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Slots:
    """A minimal perfect hash of distinct digests (a, b): each level keeps the keys that are alone in their cell."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, taken = np.arange(len(a)), 0
        while len(left):
            cells = 2 * len(left) + 1
            at = (_spread(a[left], b[left], len(self.levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((np.where(alone, np.cumsum(alone) - 1 + taken, -1), cells))
            taken += int(alone.sum())
            left = left[~alone[at]]
        slots = self.guess(a, b)
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    def guess(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that are not in the table some slot, or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (slots, cells) in enumerate(self.levels):
            out[left] = slots[(_spread(a[left], b[left], level) % np.uint64(cells)).astype(np.int64)]
            left = left[out[left] < 0]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1: the table's digest at the slot must be the key itself."""
        out = self.guess(a, b)
        if len(self.a):
            out[(self.a[out] != a) | (self.b[out] != b)] = -1
        return out


class Nodes:
    """The nodes that some rows of paths go through, in flat arrays by slot."""

    def __init__(self, rows: list[dict], base: int):
        befores = [r["before"] for r in rows]
        digests, parents = bytearray(), bytearray()
        for r, before in zip(rows, befores, strict=True):
            mine = b"".join(map(_packed, roll(int.from_bytes(before, "little"), r["contents"], base)))
            digests += mine
            parents += before + mine[:-16]
        self.lengths = np.array([len(r["contents"]) // RAW for r in rows])
        self.stops = np.cumsum(self.lengths)
        self.begins = self.stops - self.lengths
        starts = np.array([r["start"] for r in rows], np.int64)
        depth = np.repeat(starts - self.begins, self.lengths) + np.arange(self.stops[-1]) + 1
        keys = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        ups = np.frombuffer(parents, np.uint64).reshape(-1, 2)
        content = np.frombuffer(b"".join(r["contents"] for r in rows), np.uint64).reshape(-1, RAW // 8)
        words = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        ranked = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        distinct = ranked[new]
        self.slots = Slots(distinct[:, 0], distinct[:, 1])
        self.at = self.slots.find(keys[:, 0], keys[:, 1])  # slot of each turn of each row
        self.size = len(distinct)
        self.depth, self.words = np.empty(self.size, np.int64), np.empty(self.size, np.int64)
        self.up, self.content = np.empty((self.size, 2), np.uint64), np.empty((self.size, RAW // 8), np.uint64)
        for array, values in ((self.depth, depth), (self.words, words), (self.up, ups), (self.content, content)):
            array[self.at] = values
        # Each turn must agree with what its slot holds, or two sequences share a digest.
        bad = (self.depth[self.at] != depth) | (self.up[self.at] != ups).any(axis=1) | (self.content[self.at] != content).any(axis=1)
        self.clash = np.zeros(self.size, bool)
        self.clash[self.at[bad]] = True
        self.parent = self.slots.find(self.up[:, 0].copy(), self.up[:, 1].copy())
        self.order = np.argsort(self.depth, kind="stable")
        self.levels = np.flatnonzero(np.diff(self.depth[self.order], prepend=-1, append=-1))

    @property
    def ends(self) -> np.ndarray:
        """The slot at which each row ends."""
        return self.at[self.stops - 1]

    def accumulate(self, values: np.ndarray, combine: np.ufunc) -> None:
        """Bring each node's value into its parent's, the deepest level first."""
        for i in range(len(self.levels) - 2, -1, -1):
            nodes = self.order[self.levels[i] : self.levels[i + 1]]
            nodes = nodes[self.parent[nodes] >= 0]
            combine.at(values, self.parent[nodes], values[nodes])

    def signed(self, keys: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], slice_turns: int) -> Iterator[list[dict]]:
    """Rows of one start at a time, so that no table holds two rows of a conversation and counts it twice."""
    held, turns = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            if held and row["start"] != held[0]["start"]:
                yield held
                held, turns = [], 0
            held.append(row)
            turns += len(row["contents"]) // RAW
            if turns >= slice_turns:
                yield held
                held, turns = [], 0
    if held:
        yield held


def _count_nodes(base: int, slice_turns: int):
    """How many conversations go through each node of a slice, and the smallest of them."""

    def run(batches):
        for rows in _slices(batches, slice_turns):
            nodes = Nodes(rows, base)
            ids = np.array([r["conv_id"] for r in rows], np.int64)
            counts, least = np.zeros(nodes.size, np.int64), np.full(nodes.size, np.iinfo(np.int64).max)
            np.add.at(counts, nodes.ends, 1)
            np.minimum.at(least, nodes.ends, ids)
            nodes.accumulate(counts, np.add)
            nodes.accumulate(least, np.minimum)
            slots = nodes.slots
            columns = [slots.a, slots.b, nodes.up[:, 0], nodes.up[:, 1], nodes.content[:, 0] ^ nodes.content[:, 2], nodes.content[:, 1] ^ nodes.content[:, 3]]
            yield pa.RecordBatch.from_arrays(
                [*map(nodes.signed, columns), pa.array(nodes.depth), pa.array(nodes.words), pa.array(counts), pa.array(least), pa.array(nodes.clash)],
                [f.split()[0] for f in PARTS.split(", ")],
            )

    return run


def _sum_nodes(base: int, slice_turns: int):
    """Leaves and savings below each node, from what each row's conversation reports."""

    def run(batches):
        for rows in _slices(batches, slice_turns):
            nodes = Nodes(rows, base)
            leaves, saved = np.zeros(nodes.size, np.int64), np.zeros(nodes.size, np.int64)
            for row, begin, length, end in zip(rows, nodes.begins.tolist(), nodes.lengths.tolist(), nodes.ends.tolist(), strict=True):
                leaves[end] += row["more_leaves"]
                saved[end] += row["more_saved"]
                for own in row["own"] or ():
                    place = own["depth"] - row["start"]
                    if place > 0:  # what lies above is in another row
                        at = nodes.at[begin + place - 1] if place <= length else end
                        leaves[at] += own["leaf"]
                        saved[at] += own["saving"]
            nodes.accumulate(leaves, np.add)
            nodes.accumulate(saved, np.add)
            some = np.flatnonzero((leaves != 0) | (saved != 0))
            yield pa.RecordBatch.from_arrays(
                [nodes.signed(nodes.slots.a[some]), nodes.signed(nodes.slots.b[some]), pa.array(leaves[some]), pa.array(saved[some])],
                [f.split()[0] for f in SUMS.split(", ")],
            )

    return run


def _in_slices(paths: DataFrame) -> DataFrame:
    """Rows with the same beginning next to each other; equal rows are split between tasks as well."""
    key = ["start", "before", F.substring("contents", 1, 4 * RAW), "conv_id"]
    return paths.repartitionByRange(*key).sortWithinPartitions(*key)


# ---- hashes of lists of ids ----


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, id) as rows of at most IDS ids of one node."""
    key, ids, out = None, [], []

    def close() -> None:
        out.append((*key, ids[0], ",".join(map(str, ids))))
        ids.clear()

    for batch in batches:
        for a, b, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and ((a, b) != key or len(ids) == IDS):
                close()
            key = (a, b)
            ids.append(i)
        yield from _batches(out, "a long, b long, id long, ids string")
    if ids:
        close()
        yield from _batches(out, "a long, b long, id long, ids string")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, out = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) == key:
                digest.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = (a, b), hashlib.sha256(ids.encode())
        yield from _batches(out, "a long, b long, ends_sha256 string")
    if key:
        out.append((*key, digest.hexdigest()))
        yield from _batches(out, "a long, b long, ends_sha256 string")


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of rows (a, b, conv_id): the SHA-256 of each node's ids in order, joined by commas.

    SHA-256 runs from front to back, so one task has to hash all ids of a node; it streams them in rows
    of up to 65,536 ids that other tasks have sorted and joined.
    """
    ranged = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    runs = ranged.select("a", "b", "conv_id").mapInArrow(_join_ids, "a long, b long, id long, ids string")
    dealt = runs.repartition("a", "b").sortWithinPartitions("a", "b", "id").select("a", "b", "ids")
    return dealt.mapInArrow(_hash_ids, "a long, b long, ends_sha256 string")


# ---- the trie ----


def prefix_trie(
    turns: DataFrame,
    members: DataFrame,
    order: Sequence[str | Column],
    piece: int = PIECE,
    slice_turns: int = SLICE_TURNS,
    base: int | None = None,
) -> DataFrame:
    """One row for each node, the textless root included.

    turns: (conv_id, content, words) and the columns of `order`, which must tell rows apart; content is a
    hash of 32 bytes. members: the conv_ids, those without turns as well; their repeats count once. Columns of
    the result: a, b (digest), depth, conv_id (smallest member), parent_conv_id (null at the root), n_convs,
    n_children, n_leaves and saved_tokens (sums over the subtree with its top), ends_sha256 (of the ids of the
    conversations that end there). No members: no rows. The result is stored, the stages on the way are removed.
    """
    stages = Stages(turns.sparkSession)
    ra, rb = _longs(ROOT)
    attempt = 0
    while True:
        used = base_of(attempt) if base is None or attempt else base
        paths = conversation_paths(turns, order, used, piece, stages)
        parts = _in_slices(paths.select("conv_id", "start", "before", "contents", "counts")).mapInArrow(
            _count_nodes(used, slice_turns), PARTS
        )
        same = ["pa", "pb", "ca", "cb", "depth"]
        differs = [F.min(c) != F.max(c) for c in same]
        clash = F.bool_or("clash")
        for d in differs:
            clash = clash | d
        nodes = stages.keep(
            parts.groupBy("a", "b").agg(
                *[F.min(c).alias(c) for c in same], F.min("words").alias("words"), F.sum("n").alias("n_convs"),
                F.min("conv_id").alias("conv_id"), clash.alias("clash"),
            )
        )
        if nodes.where(F.col("clash") | ((F.col("a") == ra) & (F.col("b") == rb))).isEmpty():
            break
        stages.drop(nodes, paths)
        attempt += 1
    kids = stages.keep(nodes.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")))
    counted = nodes.join(kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), ["a", "b"], "left")
    full = stages.keep(
        counted.select(
            "a", "b", "pa", "pb", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saving"),
        )
    )

    # Each node is reported by its smallest member, in the row that holds the node.
    leaf = (F.col("n_children") == 0).cast("long")
    report = full.select("conv_id", F.floor((F.col("depth") - 1) / piece).alias("g"), "depth", leaf.alias("leaf"), "saving")
    own = stages.keep(
        report.where("leaf > 0 OR saving > 0")
        .groupBy("conv_id", "g")
        .agg(F.collect_list(F.struct("depth", "leaf", "saving")).alias("own"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    )
    zero = F.lit(0).cast("long")
    short = paths.where("single").join(own.select("conv_id", "g", "own"), ["conv_id", "g"])
    short = short.withColumns({"more_leaves": zero, "more_saved": zero})
    long = paths.where("NOT single")
    later = Window.partitionBy("conv_id").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    places = long.select("conv_id", "g").distinct().join(own, ["conv_id", "g"], "left")
    carried = places.select(
        "conv_id", "g", "own",
        F.coalesce(F.sum("leaves").over(later), zero).alias("more_leaves"),
        F.coalesce(F.sum("saved").over(later), zero).alias("more_saved"),
    )
    reporting = long.join(carried, ["conv_id", "g"]).where("own IS NOT NULL OR more_leaves > 0 OR more_saved > 0")
    shape = ["conv_id", "start", "before", "contents", "counts", "own", "more_leaves", "more_saved"]
    summed = (
        _in_slices(short.select(*shape).unionByName(reporting.select(*shape)))
        .mapInArrow(_sum_nodes(used, slice_turns), SUMS)
        .groupBy("a", "b")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )

    ids = members.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ended = paths.where("last").select("a", "b", "conv_id")
    turnless = ids.join(ended, "conv_id", "left_anti").select(F.lit(ra).alias("a"), F.lit(rb).alias("b"), "conv_id")
    ends = hashed_ids(stages.keep(ended.unionByName(turnless)))
    top = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    below = full.agg(F.sum(leaf).alias("n_leaves"), F.sum("saving").alias("saved_tokens"), F.count_if(F.col("depth") == 1).alias("n_children"))
    root = top.join(F.broadcast(below)).select(
        F.lit(ra).alias("a"), F.lit(rb).alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    every = full.drop("saving").join(summed, ["a", "b"], "left").unionByName(root).join(ends, ["a", "b"], "left")
    every = stages.keep(every.fillna(0, ["n_leaves", "saved_tokens"]).fillna(hashlib.sha256().hexdigest(), ["ends_sha256"]))
    above = every.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = stages.keep(
        salted_join(every, above, ["pa", "pb"], "left", key_counts=kids.withColumnRenamed("n_children", "_rows")).drop("pa", "pb")
    )
    stages.drop(*[df for df, _ in list(stages.paths.values()) if df is not out])
    return out


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """The trie of (conv_id, turn, role, text) as it is; turns in order, null first, equal ones by content."""
    slim = Stages(conversations.sparkSession).keep(slim_turns(conversations))
    order = [F.col("turn").asc_nulls_first(), "content", "tie"]
    return prefix_trie(slim, slim.select("conv_id"), order, **options)


# ---- the query ----

FIRST = 3  # turns a conversation may take from another one


def rebuilt_turns(slim: DataFrame, stages: Stages) -> tuple[DataFrame, list]:
    """Conversations that begin with up to three turns of conversation c - c % 20, and the columns of their order."""
    order = [F.col("turn").asc_nulls_first(), "content", "tie"]
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    # Spark keeps the first three rows of each conversation in each task before it shuffles.
    first = stages.keep(slim.withColumn("i", place).where(F.col("i") <= FIRST))
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    gone = first.where(F.col("i") <= wanted).select("tie")
    own = slim.join(gone, "tie", "left_anti").withColumns({"lead": F.lit(1), "i": F.lit(0)})
    ids = slim.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": wanted})
    heads = ids.join(first.withColumnRenamed("conv_id", "base"), "base").where("i <= h").withColumn("lead", F.lit(0))
    shape = ["conv_id", "lead", "i", "turn", "content", "tie", "words"]
    return stages.keep(own.select(*shape).unionByName(heads.select(*shape))), ["lead", "i", *order]


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda crc, code: list_reduce(list_prepend(xor(crc, code), range(8)),
              lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

_SQL = f"""WITH slim AS (
      SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS content,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS i FROM slim),
    convs AS (SELECT conv_id AS c, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM slim)),
    rebuilt AS (
      SELECT c, 0 AS lead, i, content, words FROM convs JOIN turns ON conv_id = c - c % 20 AND i <= h
      UNION ALL SELECT c, 1, i, content, words FROM convs JOIN turns ON conv_id = c AND i > h),
    paths AS (
      SELECT c, row_number() OVER w AS depth, string_agg(content, '') OVER w AS key, words
      FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY lead, i ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT c, 0, '', 0 FROM convs),
    ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS hash FROM (SELECT c, max_by(key, depth) AS key FROM paths GROUP BY c) GROUP BY key),
    nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saving FROM paths GROUP BY key, depth),
    kids AS (SELECT substr(key, 1, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
    subtree AS (
      SELECT substr(key, 1, 64 * d) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY ALL)
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
      coalesce(e.hash, sha256('')) AS ends_sha256
    FROM full_nodes f JOIN subtree s USING (key) LEFT JOIN ends e USING (key)
    LEFT JOIN nodes p ON f.depth > 0 AND p.key = substr(f.key, 1, 64 * (f.depth - 1))"""


@query("op12_conversation_trie", _SQL)
def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    stages = Stages(spark)
    slim = stages.keep(slim_turns(table(spark, sf, "conversations")))
    turns, order = rebuilt_turns(slim, stages)
    nodes = prefix_trie(turns, slim.select("conv_id"), order)
    stages.drop(*[df for df, _ in list(stages.paths.values())])
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
