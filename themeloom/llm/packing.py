"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Only lengths matter for packing, so the plan is made on the number of pieces of each length, at most
`capacity` numbers whatever the corpus. The reduction fixes sets that dominate every other set with
their longest piece (an exact pair, or the best companions where no more than two can join); what is
left goes best-fit, longest first, for many equal pieces at a time. The plan is a table of ranges: the
k-th piece of a length belongs into sequence base + k - start at an offset. Pieces are numbered within
their length without moving them: each task numbers its own, and the numbers of earlier tasks are added.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, free_name, query, table

CAPACITY = 2_048
END = 0
#: Up to here both libraries split words alike; texts with later characters go through tokenizers.
BEYOND = re.compile("[　-\U0010ffff]")

_encoders: dict[tuple, Callable] = {}


def id_encoder(tokenizer_path: str, ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text under a tokenizers file, special strings as its default takes them.

    With ranks_path, the same vocabulary as tiktoken ranks, texts without characters from U+3000 on are
    encoded by that faster library, which gives the same ids.
    """
    key = (tokenizer_path, ranks_path)
    if key not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        plain = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
        _encoders[key] = plain if ranks_path is None else _fast(tokenizer, ranks_path, plain)
    return _encoders[key]


def _fast(tokenizer, ranks_path: str, plain: Callable) -> Callable:
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        return plain(text) if BEYOND.search(text) else fast.encode_to_numpy(text, allowed_special=allowed).astype("<u4")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(tokenizer_path: str, ranks_path: str | None, capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_path, ranks_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names
            )

    return run


class Plan:
    """Ranges of equal pieces with their places, made from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.done = np.zeros(capacity + 1, dtype=np.int64)
        self.ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.sequences = 0
        self.reduce()
        self.best_fit()

    def place(self, length: int, n: int, base: int, offset: int) -> None:
        self.ranges[length].append((int(self.done[length]), base, offset))
        self.done[length] += n
        self.left[length] -= n

    def fix(self, group: tuple[int, ...], n: int) -> None:
        offset = 0
        for length in group:
            self.place(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def largest(self, most: int) -> int:
        """The largest length at most `most` of which pieces are left, or 0."""
        held = np.flatnonzero(self.left[: max(0, most) + 1])
        return int(held[-1]) if len(held) else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest pieces left."""
        out: list[int] = []
        for length in np.flatnonzero(self.left)[:n]:
            out += [int(length)] * int(min(self.left[length], n - len(out)))
        return out[:n]

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """A set with a piece j that dominates every other feasible set with it, if one of three is."""
        self.left[j] -= 1
        try:
            room = self.capacity - j
            small = self.smallest(3)
            companion = self.largest(room)
            if not companion:
                return (j,)
            if companion == room or sum(small[:2]) > room or len(small) < 2:
                return (j, companion)
            if sum(small) <= room and len(small) == 3:
                return None
            # At most two can join. A pair within the companion's length gives way to the companion.
            pairs = []
            for x in map(int, np.flatnonzero(self.left[: room + 1])):
                self.left[x] -= 1
                y = self.largest(min(x, room - x))
                self.left[x] += 1
                if y:
                    pairs.append((x, y))
            if all(x + y <= companion for x, y in pairs):
                return (j, companion)
            self.left[companion] -= 1
            second = self.largest(room - companion)
            self.left[companion] += 1
            if second and all(x + y <= companion or y <= second for x, y in pairs):
                return (j, companion, second)
            return None
        finally:
            self.left[j] += 1

    def reduce(self) -> None:
        for j in range(self.capacity, 0, -1):
            while self.left[j]:
                group = self.dominating(j)
                if group is None:
                    break
                # The set stays dominating while the pieces of its lengths last; the smallest pieces,
                # on which it may rest, only get larger.
                self.fix(group, int(min(self.left[x] // group.count(x) for x in group)))

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence that takes it; equal sequences are one entry."""
        open_: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        for length in range(self.capacity, 0, -1):
            room = length
            while self.left[length]:
                while room <= self.capacity and not open_[room]:
                    room += 1
                if room > self.capacity:
                    room = self.capacity
                    need = -(-int(self.left[length]) // (self.capacity // length))
                    open_[room].append((self.sequences, need))
                    self.sequences += need
                base, n = open_[room].pop()
                each = room // length
                full = min(n, int(self.left[length]) // each)
                fill = self.capacity - room
                if full:
                    for k in range(each):
                        self.place(length, full, base, fill + k * length)
                    open_[room - each * length].append((base, full))
                    base, n = base + full, n - full
                if n and (rest := min(each, int(self.left[length]))):
                    for k in range(rest):
                        self.place(length, 1, base, fill + k * length)
                    open_[room - rest * length].append((base, 1))
                    base, n = base + 1, n - 1
                if n:
                    open_[room].append((base, n))

    def table(self) -> dict[int, np.ndarray]:
        return {length: np.array(r, dtype=np.int64) for length, r in self.ranges.items()}


def _placed(ranges: dict[int, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("piece_length").to_numpy()
            ranks = batch.column("piece_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                at, plan = np.flatnonzero(lengths == length), ranges[int(length)]
                i = np.searchsorted(plan[:, 0], ranks[at], side="right") - 1
                sequence[at] = plan[i, 1] + ranks[at] - plan[i, 0]
                offset[at] = plan[i, 2]
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "piece_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    text: str = "text",
) -> DataFrame:
    """One row for each piece: the columns but the text, and piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and id 0. Only longer ones than the capacity are cut;
    the first piece may be shorter. Repeated rows are separate documents, null ids stay; new names that
    are taken get underscores before them; an empty table gives no rows. Texts do not move; the narrow
    piece rows move once, by length and task, so a length that a third of all pieces have is spread. The
    counts that reach the driver are at most `capacity` numbers, and the plan is bounded by them too.
    """
    stages = Stages(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    work = [f"piece_{n}" for n in ("no", "start", "length", "crc32", "task", "rank")]
    head = [f"in_{i}" for i in range(len(kept))]
    types = dict(zip(work, ("int", "long", "long", "long", "int", "long"), strict=True))
    flat = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(kept, head, strict=True)], F.col(f"`{text}`"))
    schema = flat.select(*head, *[F.lit(0).cast(t).alias(n) for n, t in types.items()]).schema
    pieces = stages.keep(flat.mapInArrow(_pieces(tokenizer_path, ranks_path, capacity, [*head, *work]), schema))
    keys = ["piece_length", "piece_task"]
    by_task = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["piece_length"]: r["n"] for r in by_task.groupBy("piece_length").agg(F.sum("n").alias("n")).collect()}
    ranges = Plan(counts, capacity).table()
    earlier = Window.partitionBy("piece_length").orderBy("piece_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, keys).select(
        *head, "piece_no", "piece_start", "piece_length", "piece_crc32", (F.col("before") + F.col("piece_rank")).alias("piece_rank")
    )
    names = [*head, "piece_no", "piece_start", "piece_length", "piece_crc32", "sequence", "place"]
    schema = ranked.drop("piece_rank").withColumns({n: F.lit(0).cast("long") for n in ("sequence", "place")}).schema
    placed = ranked.mapInArrow(_placed(ranges, names), schema)
    final = [*kept, *(free_name(kept, n) for n in new)]
    return placed.toDF(*final)


@query("op3_packing")
def op3(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
