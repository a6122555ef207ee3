"""Words as a block of features of fixed width, so that they can stand beside topics in one row.

Each word goes to a cell that a digest of the word chooses, with a sign from the same digest, and a cell's value is the
signed sum of the weights of its words. The width does not grow with the vocabulary, no vocabulary is
held anywhere, and words that share a cell cancel out on average.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import digest_number
from themeloom.operators.text import tf_idf
from themeloom.sources.scan import cut_lineage, save_vectors

CELLS = 1 << 16
#: Spark's forests turn every row into one number for each feature, so theirs is a narrower block.
FOREST_CELLS = 1 << 10
SEED = 4021


def signed_cell(word: Column | str, cells: int = CELLS) -> tuple[Column, Column]:
    """(cell in [0, cells), 1 or -1), from one digest of the word."""
    number = digest_number(word, seed=SEED, modulus=2 * cells)
    return F.floor(number / 2).cast("int"), F.when(number % 2 == 0, 1).otherwise(-1)


def word_cells(weighted: DataFrame, id: str = "id", value: str = "tf_idf", cells: int = CELLS) -> DataFrame:
    """(id, cell, value) from rows (id, word, weight): the sum of the signed weights in each cell.

    Sums that are zero stay, so a cell is there for each of its words. Rows without word or weight are left out.
    """
    return _cell_sums(weighted, id, value, *signed_cell("word", cells))


def _cell_sums(weighted: DataFrame, id: str, value: str, cell: Column, sign: Column) -> DataFrame:
    rows = weighted.where(F.col("word").isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(id, cell.alias("cell")).agg(F.sum(sign * F.col(value)).alias("value"))


def cell_vectors(values: DataFrame, id: str = "id", cells: int = CELLS, out: str = "ord") -> DataFrame:
    """(id, vector fields) from (id, cell, value): the parts of a sparse vector, see `save_vectors`.

    A group is the cells of one text, at most `cells`.
    """
    entries = F.sort_array(F.collect_list(F.struct("cell", "value")))
    packed = values.groupBy(id).agg(entries.alias("_entries"))
    return packed.select(id, sparse_parts(F.col("_entries.cell"), F.col("_entries.value"), cells).alias(out))


def sparse_parts(indices: Column, values: Column, size: int) -> Column:
    """The fields that Spark stores of a sparse vector."""
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def assemble(
    features: DataFrame,
    dtm: DataFrame,
    numbers: Sequence[str],
    id: str = "id",
    cells: int = CELLS,
    out: str = "x",
    total: str | None = "total",
    own: DataFrame | None = None,
) -> DataFrame:
    """The rows of `features` with one sparse vector `out`, stored: the numbers, then the tf-idf of the words in cells.

    dtm: (id, word, n) of all documents, whose frequencies count. own: its rows for the ids of `features`, if they can
    be made without the others; they are picked from dtm otherwise. An id without words has numbers alone, a row
    whose id repeats stays. Numbers must not be missing; a column named like `out` is an error. The vector carries
    no names of its features: Spark would put 65,536 of them into every plan.
    """
    if out.lower() in {c.lower() for c in features.columns}:
        raise ValueError(f"the table has a column {out} already")
    # Stored first: a join makes Spark derive filters from every condition on a wide table, in ever longer plans.
    features = cut_lineage(features)
    # Only the words of these rows travel; the digest is taken once for each word.
    cell, sign = signed_cell("word", cells)
    own = dtm.join(features.select(id), id, "left_semi") if own is None else own
    weighted = tf_idf(dtm, id, total, own, {"_cell": cell, "_sign": sign})
    sums = _cell_sums(weighted, id, "tf_idf", F.col("_cell"), F.col("_sign"))
    vectors = cell_vectors(sums, id, cells, "_words")
    first = len(numbers)
    indices = F.concat(
        F.array(*[F.lit(i) for i in range(first)]),
        F.transform(F.coalesce("_words.indices", F.array().cast("array<int>")), lambda i: i + first),
    )
    values = F.concat(
        F.array(*[F.col(n).cast("double") for n in numbers]), F.coalesce("_words.values", F.array().cast("array<double>"))
    )
    joined = features.join(vectors, id, "left").withColumn(out, sparse_parts(indices, values, first + cells)).drop("_words")
    return save_vectors(joined, {out: VectorUDT()})
