"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts come in Arrow batches that Spark bounds in bytes. Within one, texts are cut at safe boundaries
into parts of at most about `part_chars` characters, the parts are dealt into batches of about
`batch_bytes`, and each batch is encoded in one call, so one long text neither holds up nor swells a
batch. Only the lengths leave the function.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import free_name, query, table

PART_CHARS = 16_384
BATCH_BYTES = 262_144
SPACE = "▁"

_encoders: dict[tuple, Callable] = {}  # by path, kept for the life of a Python worker


def piece_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths under a sentencepiece model. Texts are cut only if the model allows it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, trained = model.normalizer_spec, model.trainer_spec
    # A space cannot be inside a token after another character, and the text is not rewritten: then
    # nothing merges over the border before a space. Added prefixes make up for the space that is cut.
    safe = (
        not spec.precompiled_charsmap
        and not spec.remove_extra_whitespaces
        and spec.add_dummy_prefix
        and spec.escape_whitespaces
        and not trained.treat_whitespace_as_suffix
        and trained.model_type == trained.BPE
        and not any(p.type == p.USER_DEFINED for p in model.pieces)
        and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces)
    )
    processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(texts: list[str], part_chars: int, batch_bytes: int) -> list[int]:
        cut = (lambda t: cut_before_spaces(t, part_chars)) if safe else (lambda t: [t])
        encode = lambda batch: map(len, processor.encode(batch, num_threads=1))
        return in_batches(texts, cut, encode, batch_bytes)

    return lengths


def cut_before_spaces(text: str, part_chars: int) -> list[str]:
    """Parts of about part_chars that start after a space which a non-space precedes.

    The space itself is left out: the encoder puts one before each part. A part is longer where no such
    space comes, and the rest is never empty.
    """
    parts, start = [], 0
    border = re.compile(f"(?<=[^ {SPACE}]) (?=.)", re.DOTALL)
    while len(text) - start > part_chars:
        found = border.search(text, start + part_chars)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.end()
    parts.append(text[start:])
    return parts


def balanced(sizes: list[int], batch_bytes: int) -> list[list[int]]:
    """Indices in as many batches as batch_bytes asks for, the largest first into the lightest batch.

    No batch holds more than the mean and the largest item together.
    """
    loads = [(0, k) for k in range(-(-sum(sizes) // batch_bytes) or 1)]
    batches: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, k = heapq.heappop(loads)
        batches[k].append(i)
        heapq.heappush(loads, (load + sizes[i], k))
    return [b for b in batches if b]


def in_batches(texts: list[str], cut: Callable, encode: Callable, batch_bytes: int) -> list[int]:
    """Cuts the texts, encodes the parts in batches of about batch_bytes of UTF-8, and adds up by text."""
    totals = [0] * len(texts)
    parts = [(i, part) for i, text in enumerate(texts) for part in cut(text)]
    for batch in balanced([len(part.encode("utf-8", "surrogatepass")) for _, part in parts], batch_bytes):
        for j, n in zip(batch, encode([parts[j][1] for j in batch]), strict=True):
            totals[parts[j][0]] += n
    return totals


def json_encoder(path: str) -> Callable:
    """Lengths under a tokenizers file. Its rules are not known here, so texts stay whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(texts: list[str], part_chars: int, batch_bytes: int) -> list[int]:
        encode = lambda batch: [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
        return in_batches(texts, lambda t: [t], encode, batch_bytes)

    return lengths


def encoder(path: str) -> Callable:
    """The encoder of a file, loaded once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = piece_encoder(path) if path.endswith(".model") else json_encoder(path)
    return _encoders[path]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    out: str = "n_tokens",
    part_chars: int = PART_CHARS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """All columns but the text, with the number of tokens of each whole text; no shuffle.

    model_path: a sentencepiece `.model` or tokenizers `.json` file that every executor has. No begin,
    end or special tokens are added; special strings in texts are taken as the library takes them by
    default. A null or empty text counts what the library gives for an empty one. Repeated rows stay,
    null ids stay; a column called like `out` stays too, and the new one gets underscores before it.
    """
    kept = [c for c in docs.columns if c != text]
    out = free_name(kept, out)
    schema = docs.drop(text).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = pa.array(lengths(texts, part_chars, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


@query("op5_token_counts")
def op5(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
