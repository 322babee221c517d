"""Delimited text and columnar tables in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inclina.functions.columns import apply_types, nullify


#: How a null is written in quoted text, where an empty field is an empty text.
_NULL = "\\N"


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    types: Mapping[str, str] | None = None,
    sep: str = "~",
    header: bool = True,
    mark: str = ".",
    tokens: Sequence[str] = ("NULL", "NA", ""),
    quoted: bool = False,
) -> DataFrame:
    """Delimited text, null tokens nulled, then typed.

    Fields are trimmed and quotes are ordinary characters; ``quoted`` reads what :func:`write_table` writes:
    quoted fields as they are, with separators, quotes and line breaks inside, and null where nothing stands.

    Every field is read as text under the declared column names (which also name a headerless file,
    or rename one by position) and converted with ``try_cast``: a bad number becomes null instead of
    failing the job, and no inference pass reads the data twice.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(
        path if isinstance(path, str) else list(path),
        schema=schema,
        sep=sep,
        header=header,
        quote='"' if quoted else "",
        escape='"' if quoted else "\\",
        multiLine=quoted,
        ignoreLeadingWhiteSpace=not quoted,
        ignoreTrailingWhiteSpace=not quoted,
        lineSep="\n" if quoted else None,
        nullValue=_NULL if quoted else None,
        enforceSchema=True,
        mode="PERMISSIVE",
    )
    clean = raw if quoted else raw.select(*[nullify(c, tokens).alias(c) for c in columns])
    return apply_types(clean, types or {}, mark)


def _unquotable(name: str, sep: str):
    """The column, failing the job on a value that cannot stand without quotes."""
    c = F.col(name)
    bad = c.contains(sep) | c.rlike("[\\r\\n\\x00]")
    return F.when(bad, F.raise_error(F.lit(f"{name} holds a separator or line break: write it quoted"))).otherwise(c)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, or a column subset of it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_lookup(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Column subset of a lookup table kept as Parquet or as headed CSV."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, header=True)
    return df.select(*columns)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), sep: str = ",", header: bool = True, mark: str = ".",
    quoted: bool = True,
) -> None:
    """Replace a table on disk. No row-number column is added; CSV can use a decimal comma.

    CSV fields are quoted and a quote inside is doubled, so any text reads back as it was. Unquoted output
    (``quoted=False``, for files in the bank's own format) fails on a field that holds the separator or a line break,
    which could not be told apart when read."""
    writer_input = df
    options: dict = {}
    if fmt == "csv":
        if mark != ".":
            doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
            writer_input = df.withColumns({c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(mark)) for c in doubles})
        plain = {"sep": sep, "header": header, "quote": "", "emptyValue": "", "nullValue": ""}
        texts = [f.name for f in writer_input.schema if isinstance(f.dataType, T.StringType)]
        if not quoted:
            writer_input = writer_input.withColumns({c: _unquotable(c, sep) for c in texts})
        options = plain if not quoted else {
            "sep": sep, "header": header, "quote": '"', "escape": '"', "quoteAll": True, "emptyValue": "", "nullValue": _NULL, "lineSep": "\n",
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        }
    writer = writer_input.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
