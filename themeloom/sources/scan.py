"""Readers with explicit schemas, and storage of intermediate stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = (
    "Budsjettkommentar",
    "Finansiering",
    "nyhetsverdi1",
    "problemoglosning1",
    "problemoglosning2",
    "problemoglosning4",
)

APPLICATION_SCHEMA = T.StructType(
    [T.StructField("...1", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "SiebelID",
            "Organisasjonsnummer",
            "ApplicationTypeName",
            "Saknummer",
            "Utfall",
            *TEXT_FIELDS,
            "Innovasjontype",
            "Prosjektorientering",
            "Vekstpotensiale",
            "Kjennetegn",
            "Virkemiddelbetegnelse",
            "Prosjektnavn",
            "innovasjonsniva",
        )
    ]
    + [T.StructField("omsoktbelop", T.DoubleType()), T.StructField("innvilgetbelop", T.DoubleType())]
)

LOADING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("tema", T.StringType()),
        T.StructField("ladning", T.DoubleType()),
    ]
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "org_nr",
            "navn",
            "fnr_dat",
            "nace1_sn07",
            "syss",
            "org_form",
            "fylke",
            "kommune",
        )
    ]
    + [T.StructField("oms", T.DoubleType()), T.StructField("aar", T.StringType())]
)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"')
    return reader.format(fmt).load(path)


def read_applications(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Raw applications without the spreadsheet index column.

    With multi_line, CSV texts may hold line breaks, but each CSV file is read by one task: use many
    files, or Parquet, for large exports.
    """
    return (
        _read(spark, path, fmt, APPLICATION_SCHEMA, multi_line)
        .drop("...1")
        .withColumnsRenamed({"Organisasjonsnummer": "org_nr", "SiebelID": "id"})
    )


def read_loadings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved topic loadings, one row per application and topic."""
    return _read(spark, path, fmt, LOADING_SCHEMA)


def read_registry(
    spark: SparkSession, path: str, years: Sequence[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Registry folder partitioned by `aar`; asking for years reads only their folders."""
    frame = _read(spark, path, fmt, REGISTRY_SCHEMA)
    return frame if years is None else frame.where(F.col("aar").isin(list(years)))


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> DataFrame:
    """Write a stage to the given folder and go on from the written files."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored stages: the one the cluster names in `spark.checkpoint.dir`.

    Where that is unset, a local session gets a folder of its own that goes when Python ends, and a
    cluster stops: its executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="themeloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the files.

    The rows are then fixed: every later use reads the same ones, also after a lost executor, and the
    optimizer knows their size. Like checkpoints, the files stay until the folder is cleaned.
    """
    return save_stage(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def save_vectors(df: DataFrame, vectors: Mapping[str, T.UserDefinedType]) -> DataFrame:
    """Like cut_lineage, for columns that hold the fields of ML vectors: they are vectors when read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fields = [T.StructField(f.name, vectors.get(f.name, f.dataType)) for f in df.schema.fields]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
