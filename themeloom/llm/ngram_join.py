"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact verification for links.

Every text is a set of word n-grams. Texts with equal sets are one class from the start. A class has a
signature in each tree of the forest: MinHash values of which prefixes of several lengths count, the
levels of a prefix trie. Classes that share a node of the shortest prefix are kept, sorted into the nodes
of each level. All levels are verified, from the longest prefixes to the shortest: a link of similarity s
is found at depth d in one of L trees with probability 1 - (1 - s^d)^L, and the shortest prefix is short
enough that a pair just at the threshold is found with the target recall too. Links of one group say
nothing about pairs elsewhere, so no number of links found ends the search early.

A node is cut into blocks of bounded size, and a task compares two blocks by their exact sets. A pair is
compared at its longest shared prefix and first tree only. Tasks return, for each class, the number of
documents it is linked with and one edge of a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.common import Stages, query, table
from themeloom.llm.components import components

WORDS_IN_GRAM = 5
THRESHOLD = 0.8
TREES = 18
DEPTHS = (6, 4)
TARGET = 0.9999
BLOCK = 512
FILTER_BITS = 22
SEED = 3
CACHED_WORDS = 400_000
SEEN_COLUMNS = 8_192

WORD = re.compile(r"\w+")
_words: dict[str, int] = {}


def recall(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair shares a prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str, n: int = WORDS_IN_GRAM) -> np.ndarray:
    """The set of hashed n-grams of lower-case words, sorted; a shorter text is one gram, no word none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHED_WORDS:
        _words.clear()
    hashes = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    codes = np.array(hashes, np.uint64)
    n = min(n, len(codes))
    total = np.full(len(codes) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i])
    return np.unique(total)


def signature_functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, count, dtype=np.uint64)


def signature(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function over the set, 32 bits each."""
    out = np.full(len(a), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(members), 512):
            values = (a[:, None] * members[None, i : i + 512] + b[:, None]) >> np.uint64(32)
            np.minimum(out, values.min(1), out=out)
    return out


def prefixes(values: np.ndarray, trees: int, depths: tuple[int, ...]) -> list[np.ndarray]:
    """For each depth, the hash of each tree's prefix of that length, as signed numbers."""
    by_tree = values.reshape(trees, -1)
    state = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = {}
    with np.errstate(over="ignore"):
        for d in range(by_tree.shape[1]):
            state = _mixed(state * np.uint64(0x100000001B3) + by_tree[:, d])
            out[d + 1] = state.view(np.int64)
    return [out[d] for d in depths]


def _signed(docs_columns: int, n: int, trees: int, depths: tuple[int, ...], seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the values that the shortest prefixes need.
        a, b = (f.reshape(trees, -1)[:, : depths[-1]].ravel() for f in signature_functions(trees * max(depths), seed))
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                low, high, leaves = [], [], []
                for text in batch.column(docs_columns).to_pylist():
                    members = grams(text or "", n)
                    if not len(members):
                        low.append(None)
                        high.append(None)
                        leaves.append(None)
                        continue
                    whole_set = xxhash.xxh3_128_intdigest(members.tobytes())
                    low.append((whole_set & (2**64 - 1)) - 2**63)
                    high.append((whole_set >> 64) - 2**63)
                    leaves.append(prefixes(signature(members, a, b), trees, depths[-1:])[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:docs_columns],
                        pa.array(low, pa.int64()),
                        pa.array(high, pa.int64()),
                        pa.array(leaves, pa.list_(pa.int64())),
                    ],
                    names,
                )

    return run


def _sets(bitmap, n: int, trees: int, depths: tuple[int, ...], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = bitmap.value
        a, b = signature_functions(trees * max(depths), seed)
        for batch in batches:
            place = batch.column(0).to_numpy() & (size - 1)
            wanted = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
            some = batch.take(pa.array(wanted))
            members = [grams(t or "", n) for t in some.column(1).to_pylist()]
            levels = [[p.tolist() for p in prefixes(signature(m, a, b), trees, depths)] for m in members]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0),
                    pa.array([m.tobytes() for m in members], pa.binary()),
                    pa.array(levels, pa.list_(pa.list_(pa.int64()))),
                ],
                ["content", "members", "prefixes"],
            )

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1  # a member of one set is shared with none
    renumbered = np.cumsum(often) - 1
    keep = often[code]
    owner, code, columns = owner[keep], renumbered[code[keep]], int(often.sum())
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((m, m), np.float32)
    for start in range(0, columns, SEEN_COLUMNS):
        lo, hi = np.searchsorted(code, [start, start + SEEN_COLUMNS])
        block = np.zeros((m, min(SEEN_COLUMNS, columns - start)), np.float32)
        block[owner[lo:hi], code[lo:hi] - start] = 1
        total += block @ block.T
    return total


def compare_cell(rows: list[dict], tree: int, level: int, threshold: float, trees: int) -> list[tuple]:
    """(node, root, links) of the classes in a cell that have links in it."""
    m = len(rows)
    side = np.array([r["side"] for r in rows])
    upper = np.triu(np.ones((m, m), bool), 1)
    if rows[0]["crossed"]:
        upper &= side[:, None] != side[None, :]
    hashes = [np.array([r["prefixes"][k] for r in rows]) for k in range(level + 1)]
    for k in range(level):
        for t in range(trees):
            upper &= hashes[k][:, None, t] != hashes[k][None, :, t]
    for t in range(tree):
        upper &= hashes[level][:, None, t] != hashes[level][None, :, t]
    upper &= hashes[level][:, None, tree] == hashes[level][None, :, tree]
    if not upper.any():
        return []
    sets = [np.frombuffer(r["members"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], float)
    i, j = np.nonzero(upper)
    # Sets whose sizes alone are too different need no comparison.
    near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[near], j[near]
    if len(i) <= 16:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], float)
    else:
        shared = shared_counts(sets)[i, j].astype(float)
    similarity = shared / (sizes[i] + sizes[j] - shared) if len(i) else np.zeros(0)
    linked = similarity >= threshold
    i, j = i[linked], j[linked]
    if not len(i):
        return []
    copies = np.array([r["copies"] for r in rows], np.int64)
    links = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
    nodes = np.array([r["rep"] for r in rows], np.int64)
    label = np.arange(m)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(nodes[x]), int(nodes[label[x]]), int(links[x])) for x in np.flatnonzero(links)]


def _compared(level: int, threshold: float, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[dict] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

        for batch in batches:
            out = []
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for row in part.to_pylist():
                    if cell and cell[0]["cell"] != row["cell"]:
                        out += compare_cell(cell, cell[0]["tree"], level, threshold, trees)
                        cell = []
                    cell.append(row)
            yield packed()
        if cell:
            out = compare_cell(cell, cell[0]["tree"], level, threshold, trees)
            yield packed()

    return run


def cells_of(matches: DataFrame, levels: int, block: int) -> DataFrame:
    """(cell, level, tree, crossed, side, rep): the nodes of all levels in cells of at most two blocks.

    A node whose classes all share a longer prefix was compared there. Cells with the same classes, as
    near copies are together in most trees, become one, that of the longest prefix and first tree.
    """
    every = []
    for level in range(levels):
        deeper = F.col("prefixes")[level - 1] if level else F.monotonically_increasing_id()
        node = matches.select("tree", F.col("prefixes")[level].alias("hash"), deeper.alias("deeper"), "rep")
        counts = node.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("deeper").alias("x"), F.max("deeper").alias("y"))
        counts = counts.where("n > 1 AND x <> y").select("hash", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        placed = node.drop("deeper").join(counts, "hash")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        spread = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        side = F.struct("rep", F.when(F.col("own") == F.col("i"), 0).otherwise(1).alias("side"))
        cell = spread.groupBy("tree", "hash", "i", "j").agg(F.sort_array(F.collect_list(side)).alias("held"))
        at = F.struct(F.lit(level).alias("level"), "tree").alias("at")
        every.append(cell.where(F.size("held") > 1).select("held", (F.col("i") != F.col("j")).alias("crossed"), at))
    once = reduce(DataFrame.union, every).groupBy("held", "crossed").agg(F.min("at").alias("at"))
    numbered = once.withColumn("cell", F.monotonically_increasing_id())
    numbered = numbered.select("cell", "at.level", "at.tree", "crossed", F.explode("held").alias("h"))
    return numbered.select("cell", "level", "tree", "crossed", "h.side", "h.rep")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    n: int = WORDS_IN_GRAM,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depths: tuple[int, ...] = DEPTHS,
    target: float = TARGET,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row for each document: content, doc_id, class_id, n_links, n_copies, is_first.

    Documents whose sets of word n-grams have a Jaccard similarity of at least the threshold are linked.
    class_id is the smallest doc_id of the connected component, n_links the number of other documents the
    document is linked with, n_copies how many have exactly its set (it included), and is_first is true for
    one document of each class, that of the smallest doc_id (of rows that repeat it, one). `content` is a
    hash of the text, with which rows are found again. Words are runs of letters, digits and underscores
    in lower case; fewer than n are one gram. A text without words (null, empty) is a class of its own with
    0 links and 0 copies. Null ids stay, and stay out of class_id if the class has another. Other columns
    are left out; empty tables give no rows.

    Classes of equal sets never become pairs. Groups of any size are cut into blocks. The texts are read
    twice and do not move; of those that share a node, the sets move. `depths` go from long to short, all
    are verified, and the last must reach the target recall at the threshold.
    """
    if recall(threshold, depths[-1], trees) < target:
        raise ValueError("the shortest prefix does not reach the target recall at the threshold")
    spark = docs.sparkSession
    stages = Stages(spark)
    content = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), content.alias("content"), F.col(f"`{text}`").alias("text"))
    head = slim.drop("text")
    longs = T.ArrayType(T.LongType())
    hashes = [T.StructField(c, T.LongType()) for c in ("low", "high")]
    schema = T.StructType([*head.schema, *hashes, T.StructField("leaves", longs)])
    signed = slim.mapInArrow(_signed(2, n, trees, depths, seed, schema.fieldNames()), schema)
    forest = stages.keep(signed.withColumn("row", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")  # nulls last
    classes = forest.where("low IS NOT NULL").groupBy("low", "high").agg(
        F.min("row").alias("rep"),
        F.min_by("content", "row").alias("content"),
        F.count(F.lit(1)).alias("copies"),
        F.min_by(F.struct("doc_id", "row"), first).alias("least"),
        F.min_by("leaves", "row").alias("leaves"),
    )
    classes = stages.keep(classes)
    # Nodes of the shortest prefix with two classes or more; the others need no more work. A hash is of a
    # prefix in its tree.
    leaves = classes.select("rep", F.posexplode("leaves").alias("tree", "hash"))
    shared = leaves.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    in_nodes = stages.keep(leaves.join(shared, "hash").select("rep", "tree"))
    involved = classes.select("rep", "content", "copies").join(in_nodes.select("rep").distinct(), "rep")
    involved = stages.keep(involved)
    # A filter of fixed size passes the texts that may be among them, so that few sets move.
    size = 1 << FILTER_BITS
    places = involved.select(F.expr(f"content & {size - 1}").cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()
    bits = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    bitmap = spark.sparkContext.broadcast((bits, size))
    schema = "content long, members binary, prefixes array<array<long>>"
    found = slim.select("content", "text").mapInArrow(_sets(bitmap, n, trees, depths, seed), schema)
    once = found.groupBy("content").agg(F.first("members").alias("members"), F.first("prefixes").alias("prefixes"))
    sets = stages.keep(involved.join(once, "content").select("rep", "copies", "prefixes", "members"))
    of_tree = F.transform("prefixes", lambda p: F.element_at(p, F.col("tree") + 1))
    matches = in_nodes.join(sets.select("rep", "prefixes"), "rep").select("rep", "tree", of_tree.alias("prefixes"))
    matches = stages.keep(matches)
    cells = stages.keep(cells_of(matches, len(depths), block))
    stages.drop(in_nodes, involved, matches)
    done = []
    for level in range(len(depths)):
        filled = cells.where(F.col("level") == level).join(sets, "rep").repartition("cell").sortWithinPartitions("cell")
        done.append(stages.keep(filled.mapInArrow(_compared(level, threshold, trees), "a long, b long, links long")))
    found = reduce(DataFrame.union, done)
    stages.drop(cells, sets)
    roots = components(found.select("a", "b"), stages)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    rooted = classes.select("low", "high", "rep", "copies", "least").join(links, "rep", "left")
    rooted = rooted.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = stages.keep(rooted)
    order = F.struct(F.col("least.doc_id").isNull(), "least.doc_id", "least.row")
    heads = rooted.groupBy("root").agg(F.min_by("least", order).alias("head"))
    named = rooted.join(heads, "root").select("low", "high", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    rows = forest.select("doc_id", "content", "row", "low", "high").join(named, ["low", "high"], "left")
    alone = F.col("copies").isNull()
    return rows.select(
        "content",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(0)).cast("long").alias("n_copies"),
        (alone | (F.col("row") == F.col("head.row"))).alias("is_first"),
    )


def rows_of(docs: DataFrame, kept: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that (kept_content, kept_id, kept_n) name, kept_n of the rows that are alike in both."""
    content = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # A null id is a key like any other, and no id is like it.
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    sortable = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), content.alias("content"), key(F.col(f"`{doc_id}`")).alias("key"), F.xxhash64(*sortable).alias("order"))
    wanted = kept.select(F.col("kept_content").alias("content"), key(F.col("kept_id")).alias("key"), "kept_n")
    joined = rows.join(wanted, ["content", "key"])
    place = F.row_number().over(Window.partitionBy("content", "key").orderBy("order"))
    return joined.withColumn("place", place).where("place <= kept_n").select("whole.*")


@query(
    "op1_ngram_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
       s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_sort([array_to_string(w, ' ')])[1]]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
       c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS k FROM s GROUP BY doc_id),
       r AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n, count(*) AS copies FROM c GROUP BY k),
       rs AS (SELECT r.rep, s.g, r.n, r.copies FROM r JOIN s ON s.doc_id = r.rep),
       l AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep
         GROUP BY a.rep, b.rep HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
       reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
       root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a),
       n AS (SELECT a AS rep, sum(copies)::BIGINT AS links FROM l GROUP BY a)
       SELECT d.doc_id, coalesce(root.root, d.doc_id) AS class_id, coalesce(n.links + r.copies - 1, r.copies - 1, 0)::BIGINT AS n_links
       FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN r ON r.k = c.k
       LEFT JOIN root ON root.rep = r.rep LEFT JOIN n ON n.rep = r.rep""",
)
def op1(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links")
