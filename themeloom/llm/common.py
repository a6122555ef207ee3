"""What the operators share: tables, stored stages, registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.sources.scan import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Stages:
    """Stages written to the shared folder, and their removal once nothing reads them any more.

    A written stage fixes its rows and cuts the lineage: a lost executor repeats tasks of the current
    job only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = (stored, path)
        return stored

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame))
            jvm = self.spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(taken: list[str], name: str) -> str:
    """The name, or with underscores before it until no column has it (names differ in case only: taken)."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def finite_vector(column: str) -> F.Column:
    """True for a vector without null or non-finite components; null and empty vectors are not."""
    values = F.col(column)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return values.isNotNull() & (F.size(values) > 0) & ~F.exists(values, bad)


def main_dimension(vectors: DataFrame, column: str) -> int:
    """The dimension that most vectors have, the larger one on a tie; 0 if there are no vectors.

    One small row for each dimension that occurs is all that is compared.
    """
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0
