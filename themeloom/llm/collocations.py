"""Phrases whose words occur together more often than their parts would by chance.

Only longest windows are counted: each word with its next four, in lead columns that are padded where a
phrase cannot go on. The counts of the distinct windows are then summed over successively shorter
prefixes by one ROLLUP, as every phrase is a prefix of the window at its first word.

A phrase of at least `min_count` has only words and pairs of at least that many, so windows are padded from
the first word or pair that is rarer. Words and pairs are counted exactly first, and those frequent
enough are marked in filters of hashed bits, whose size is bounded: a wrongly set bit costs a longer window and no
result. Within tasks words are 64-bit hashes; every hash that two words of a language share is found when
words are counted, and the hashing then starts again from another seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, query, table
from themeloom.operators.joins import attach

MIN_COUNT = 100
WORDS = 5
TOP = 2_000
NO_LANG = "und"
#: Bytes between words, and bytes that end a piece.
BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text a task counts at a time; numpy takes about forty times as much.
BLOCK_BYTES = 4 * 1024 * 1024
FILTER_BITS = (16, 28)  # 8 KB to 32 MB, by the number of frequent items
BITMAP = 32_768  # bits in one of Spark's bitmaps

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_BREAK = re.compile(b"[" + BREAKS + b"]")


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(data: bytes, seed: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, pieces) of the words of some texts; hashes are never 0.

    A word's hash adds up one number for each byte and its place, so it is made for all words at once;
    `bits` of it are used.
    """
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[raw]
    edges = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return raw, none, none, none.astype(np.uint64), none
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    letters = raw[kind == 0].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(8))
    hashes = mix(np.add.reduceat(mix(letters + mix(np.array([seed], np.uint64))), firsts))
    pieces = np.cumsum(kind == 2)[starts]
    return raw, starts, ends, np.maximum(hashes >> np.uint64(64 - bits), np.uint64(1)), pieces


def _cut(data: bytes, block_bytes: int) -> Iterator[bytes]:
    """A long text in parts of about block_bytes, cut after the end of a piece, which changes no count."""
    at = 0
    while at < len(data):
        end = _BREAK.search(data, at + block_bytes)
        stop = end.end() if end else len(data)
        yield data[at:stop]
        at = stop


def _texts_by_lang(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by line ends), about block_bytes at a time."""
    for lang, data in _joined_texts(batches, block_bytes):
        for part in _cut(data, block_bytes) if len(data) > 2 * block_bytes else (data,):
            yield lang, part


def _joined_texts(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, bytes]]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            key, data = lang.as_py(), text.as_buffer()
            if data is None or not data.size:
                continue
            held.setdefault(key, []).append(data.to_pybytes())
            sizes[key] = sizes.get(key, 0) + data.size
            if sizes[key] >= block_bytes:
                yield key, b"\n".join(held.pop(key))
                sizes.pop(key)
            elif sum(sizes.values()) >= 4 * block_bytes:
                key = max(sizes, key=sizes.get)
                yield key, b"\n".join(held.pop(key))
                sizes.pop(key)
    for key, parts in held.items():
        yield key, b"\n".join(parts)


def _count_words(hashing: tuple[int, int], block_bytes: int):
    def run(batches):
        for lang, data in _texts_by_lang(batches, block_bytes):
            raw, starts, ends, hashes, _ = split_words(data, *hashing)
            if not len(hashes):
                continue
            # The block's words, the first place of each hash and whether all its places hold the same word.
            codes, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            text = raw.tobytes()
            words = [text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            clash = _differ(raw, starts, ends, first[inverse])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(codes), pa.string()),
                    pa.array(codes.view(np.int64)),
                    pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(np.isin(np.arange(len(codes)), inverse[clash])),
                ],
                ["lang", "code", "word", "n", "clash"],
            )

    return run


def _differ(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Words that are not equal to their model, the first word of the same hash."""
    lengths = ends - starts
    bad = lengths != lengths[models]
    safe = np.where(bad, np.arange(len(starts)), models)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    other = raw[np.repeat(starts, lengths) + at] != raw[np.repeat(starts[safe], lengths) + at]
    bad[np.repeat(np.arange(len(starts)), lengths)[other]] = True
    return bad


def _lang_salt(lang: str) -> np.uint64:
    return mix(np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") ^ (len(lang) << 56)], np.uint64))[0]


def _word_key(lang: str, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _lang_salt(lang))


def _pair_key(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(_word_key(lang, left) * np.uint64(3) + right)


class Bits:
    """A filter of hashed bits: `has` may say yes for what was not put in, never no for what was."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def collect_bits(keys: DataFrame, key: str) -> Bits:
    """The filter of a column of 64-bit keys. Spark makes bitmaps of 4 KB; the bits grow with the number of
    keys between the bounds of FILTER_BITS, so at most 32 MB reach the driver."""
    low, high = FILTER_BITS
    count = keys.count()
    bits = min(max(low, (16 * count).bit_length()), high)
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    maps = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("block"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.agg(F.bitmap_construct_agg(F.pmod("p", F.lit(BITMAP))).alias("bits")).toLocalIterator():
        data[r.block * (BITMAP // 8) : (r.block + 1) * (BITMAP // 8)] = np.frombuffer(r.bits, np.uint8)
    return Bits(bits, data)


def _masked(lang: str, data: bytes, hashing: tuple[int, int], words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether a word and its right neighbour are both frequent and in one piece)."""
    _, _, _, hashes, pieces = split_words(data, *hashing)
    often = words.has(_word_key(lang, hashes))
    joined = np.zeros(len(hashes), bool)
    joined[:-1] = often[1:] & often[:-1] & (pieces[1:] == pieces[:-1])
    return hashes, joined


def _count_pairs(hashing: tuple[int, int], block_bytes: int, words):
    def run(batches):
        for lang, data in _texts_by_lang(batches, block_bytes):
            hashes, joined = _masked(lang, data, hashing, words.value)
            at = np.flatnonzero(joined)
            keys, counts = np.unique(_pair_key(lang, hashes[at], hashes[at + 1]), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])

    return run


def _count_windows(hashing: tuple[int, int], block_bytes: int, words, pairs, width: int):
    names = ["lang", *_columns(width), "n"]

    def run(batches):
        for lang, data in _texts_by_lang(batches, block_bytes):
            hashes, joined = _masked(lang, data, hashing, words.value)
            at = np.flatnonzero(joined)
            joined[at] = pairs.value.has(_pair_key(lang, hashes[at], hashes[at + 1]))
            often = words.value.has(_word_key(lang, hashes))
            at = np.flatnonzero(often)
            hashes = np.concatenate((hashes, np.zeros(width, np.uint64)))
            lead = [hashes[at]]
            goes_on = np.ones(len(at), bool)
            joined = np.concatenate((joined, np.zeros(width, bool)))
            for k in range(1, width):
                goes_on = goes_on & joined[at + k - 1]
                lead.append(np.where(goes_on, hashes[at + k], np.uint64(0)))
            if not len(at):
                continue
            order = np.lexsort(lead[::-1])
            lead = [c[order] for c in lead]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in lead])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(order)))
            columns = [pa.array(c[first].view(np.int64)) for c in lead]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *columns, pa.array(counts, pa.int64())], names)

    return run


def _columns(width: int) -> list[str]:
    return [f"w{i}" for i in range(1, width + 1)]


def phrase_counts(windows: DataFrame, width: int, min_count: int) -> DataFrame:
    """(lang, words, f) of every phrase of at least min_count, from windows (lang, w1.., n) padded with 0."""
    names = _columns(width)
    longest = windows.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    sums = longest.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # The prefix of k words has level 2^(width - k) - 1; a prefix that ends in padding is a shorter phrase again.
    cases = [
        F.when(F.col("level") == (1 << (width - k)) - 1, F.when(F.col(names[k - 1]) != 0, F.array(*names[:k])))
        for k in range(1, width + 1)
    ]
    return sums.where(F.col("f") >= min_count).select("lang", F.coalesce(*cases).alias("words"), "f").where("words IS NOT NULL")


def cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score): each phrase of two or more words with its lowest-scoring cut.

    Scores are quotients of whole numbers in 38 digits, rounded down.
    """
    several = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    part = lambda k, side, words: F.struct(k.alias("k"), F.lit(side).alias("side"), words.alias("part"))
    places = F.sequence(F.lit(1), size - 1)
    firsts = F.transform(places, lambda k: part(k, 0, F.slice("words", F.lit(1), k)))
    rests = F.transform(places, lambda k: part(k, 1, F.slice("words", k + 1, size - k)))
    parts = several.select("lang", "words", "a", F.inline(F.concat(firsts, rests)))
    known = phrases.withColumnsRenamed({"words": "part"})
    # Many phrases share a first word, so hot parts are split.
    counted = attach(parts, known, ["lang", "part"], "inner")
    both = counted.groupBy("lang", "words", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    return (
        attach(both, totals, ["lang"], "inner")
        .withColumn("over", (whole("a", 17) * whole("n", 17) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
        .withColumn("under", (whole("l", 19) * whole("r", 19)).cast("decimal(38,0)"))
        .withColumn("score", F.expr("over div under"))
        .groupBy("lang", "words", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        .select("lang", "words", "a", "low.l", "low.r", "n", "low.score")
    )


def not_inside(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases that do not lie inside a longer one of at least `percent` of 100 of their count."""
    size = F.size("words")
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("words", at, n)),
        )
    )
    inner = scored.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(pieces).alias("words"))
    most = inner.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    joined = scored.join(most, ["lang", "words"], "left")
    return joined.where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    width: int = WORDS,
    top: int = TOP,
    percent: int = 100,
    block_bytes: int = BLOCK_BYTES,
    hash_bits: Sequence[int] = (64,),
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language, as the query's contract says.

    a, l and r count the phrase and its parts at the lowest-scoring cut, n all words of the language. A
    null language is `und`, a null text empty; other columns are left out. Words never go over the end of
    a piece, texts of any length are read whole, and repeated rows count again. Equal scores come by falling
    count, then by phrase in byte order. No documents: no rows. The result is stored, the stages on the way
    are removed. Where two words share a hash, the next try takes another seed and the next of hash_bits,
    the last one from then on.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    attempt = 0
    while True:
        hashing = (attempt, hash_bits[min(attempt, len(hash_bits) - 1)])
        seen = source.mapInArrow(_count_words(hashing, block_bytes), "lang string, code long, word string, n long, clash boolean")
        words = stages.keep(
            seen.groupBy("lang", "code").agg(
                F.sum("n").alias("n"), F.min("word").alias("word"), (F.bool_or("clash") | (F.min("word") != F.max("word"))).alias("clash")
            )
        )
        if words.where("clash").isEmpty():
            break
        stages.drop(words)
        attempt += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= min_count)
    keyed = often.select("lang", "code").mapInArrow(_word_keys, "key long")
    word_bits = spark.sparkContext.broadcast(collect_bits(keyed, "key"))
    counted = source.mapInArrow(_count_pairs(hashing, block_bytes, word_bits), "key long, n long")
    pairs = stages.keep(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    pair_bits = spark.sparkContext.broadcast(collect_bits(pairs, "key"))
    shape = "lang string, " + ", ".join(f"{w} long" for w in _columns(width)) + ", n long"
    windows = source.mapInArrow(_count_windows(hashing, block_bytes, word_bits, pair_bits, width), shape)
    phrases = stages.keep(phrase_counts(windows, width, min_count))
    scored = stages.keep(cuts(phrases, totals))
    left = not_inside(scored, percent)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties for the last places stay until the phrases are spelled out.
    best = stages.keep(left.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"))
    spelled = attach(
        best.select("*", F.posexplode("words").alias("at", "code")), often.select("lang", "code", "word"), ["lang", "code"], "inner"
    )
    texts = (
        spelled.groupBy("lang", "words", "a", "l", "r", "n", "score")
        .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
        .withColumn("phrase", F.array_join(F.col("parts.word"), " "))
    )
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = texts.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top)
    out = stages.keep(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    stages.drop(words, pairs, phrases, scored, best)
    return out


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        keys = np.zeros(len(codes), np.uint64)
        for lang in set(langs.tolist()):
            mine = langs == lang
            keys[mine] = _word_key(lang, codes[mine])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _sql() -> str:
    """The same from plain n-gram counts."""
    grams = " UNION ALL ".join(
        f"SELECT lang, ws[i:i + {k - 1}] AS words FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces)"
        for k in range(1, WORDS + 1)
    )
    return f"""WITH pieces AS (
          SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
            SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents)),
        totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
        phrases AS (SELECT lang, words, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
        cut AS (SELECT p.lang, p.words, p.f AS a, l.f AS l, r.f AS r, t.n, k,
                  (1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f) AS score
                FROM (SELECT *, unnest(range(1, len(words))) AS k FROM phrases) p
                JOIN phrases l ON l.lang = p.lang AND l.words = p.words[1:k]
                JOIN phrases r ON r.lang = p.lang AND r.words = p.words[k + 1:]
                JOIN totals t ON t.lang = p.lang),
        lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
        inside AS (SELECT lang, words[i:j] AS words, max(a) AS longer
                   FROM (SELECT *, unnest(range(i + 1, len(words) + 1)) AS j FROM (SELECT *, unnest(range(1, len(words))) AS i FROM lowest))
                   WHERE j - i + 1 < len(words) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
          phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM lowest w LEFT JOIN inside i USING (lang, words)
              WHERE longer IS NULL OR 100 * longer < 100 * a)
        QUALIFY rank <= {TOP}"""


@query("op13_collocations", _sql())
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))
