"""Lines that an earlier document already holds, found with levelled sorted runs of line hashes.

State is a log of *runs*: bucketed, sorted tables of distinct line hashes with the id that brought
them. A batch combines its own lines to distinct hashes (map-side), merge-anti-joins every run (runs
are bucketed alike, so neither side is shuffled again), and what is left becomes a new run of level 0.
A level that holds ``fanout`` runs is merged into one run of the next level; keys of different runs
are disjoint, so merging never has to combine.

A line stays if its (hash, document) is what a run recorded. That lookup joins on hash *and*
document, so a line that a third of all documents share is spread over as many keys.

Defined results: null or empty text is one empty line. Rows without an id count as one document after
all others. Repeated rows of one document never make a line repeated. Keys under ``least`` code points
always stay. An empty table gives an empty table. Columns besides id and text are neither read nor
renamed, whatever they are called; only ``n_lines`` and ``n_dropped`` (in any case) give way to the answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from inclina.llm.store import SPACE, delete, identity, lower_ascii, scratch, stored

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def hashed_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """One row per line with a key of ``least`` code points: document, text hash, place, 128-bit hash."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = docs.select(
        identity(docs).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line")
    )
    keyed = lines.select("doc", "body", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("doc", "body", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levelled runs of seen lines in ``folder``; feed batches in the order in which documents count."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = keys.select(*HASH, "first").write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        writer.option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.folder}/{name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of :func:`hashed_lines`; returns its lines that came first elsewhere.

        The frame must be read before the next batch is added, which may compact what it reads."""
        self.compact()
        fresh = lines.groupBy(*HASH).agg(F.min("doc").alias("first"))
        for run in [name for level in self.levels for name in level]:
            fresh = fresh.join(self.spark.table(run), HASH, "left_anti")
        name = self._write(fresh, 0)
        kept = self.spark.read.schema("h1 long, h2 long, first long").parquet(f"{self.folder}/{name}")
        return lines.join(kept.withColumnRenamed("first", "doc"), [*HASH, "doc"], "left_anti")

    def compact(self) -> None:
        """Merge every level that holds ``fanout`` runs into one run of the next level."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = self.spark.table(runs[0])
                for run in runs[1:]:
                    merged = merged.unionByName(self.spark.table(run))
                self.levels[level] = []
                self._write(merged.repartition(self.buckets, *HASH), level + 1)
                for run in runs:
                    self._forget(run)
            level += 1

    def close(self) -> None:
        for run in [name for level in self.levels for name in level]:
            self._forget(run)
        self.levels = []


@pandas_udf(StringType())
def without_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text less the lines at the given places; null where there are none to take out."""
    for texts, gone in batches:
        out = []
        for text, places in zip(texts, gone):
            if places is None:
                out.append(None)
            else:
                drop = set(places)
                out.append("\n".join(line for i, line in enumerate((text or "").split("\n")) if i not in drop))
        yield pd.Series(out, dtype=object)


def drop_repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, least: int = 10) -> DataFrame:
    """``docs`` with ``text`` less the lines that a document with a smaller id holds, and
    ``n_lines`` (before) and ``n_dropped``. Batches are ascending ranges of the id."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    cuts = docs.select(F.percentile_approx(identity(docs), [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = stored(hashed_lines(docs, least).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, scratch(spark, "runs"), fanout)
    gone_path = scratch(spark, "repeats")
    for i in range(len(cuts) + 1):
        gone = runs.add(lines.where(F.col("batch") == i).drop("batch"))
        gone.select("doc", "body", "place").write.mode("append").parquet(gone_path)
    runs.close()
    gone = spark.read.schema("doc long, body long, place int").parquet(gone_path)
    doc, body, places, kept = (f"_{name}_{uuid.uuid4().hex}" for name in ("doc", "body", "places", "kept"))
    found = gone.groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(F.collect_set("place").alias(places))
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.withColumns({doc: identity(docs), body: F.xxhash64(text)}).join(found, [doc, body], "left")
    cut = joined.withColumns({
        "n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"),
        "n_dropped": F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long"),
        kept: without_lines(F.when(F.col(places).isNotNull(), F.col("text")), F.col(places)),
    })
    return cut.withColumn("text", F.coalesce(kept, "text")).drop(doc, body, places, kept).select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in [*docs.columns, "n_lines", "n_dropped"]]
    )
