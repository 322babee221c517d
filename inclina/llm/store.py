"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inclina.session import checkpoint_folder

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Identity of rows without an id: they count as one document that comes after all others.
NO_ID = (1 << 63) - 1


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark)}/inclina-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` computed once, written as Parquet and read again: its lineage ends there and a lost
    executor costs nothing. ``parts`` are partition columns."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`scratch`, wherever the shared folder lives."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def identity(df: DataFrame, key: str = "doc_id") -> Column:
    """The id as a long, :data:`NO_ID` where it is null."""
    return F.coalesce(df[key].cast("long"), F.lit(NO_ID))
