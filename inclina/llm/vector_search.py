"""Approximate nearest neighbours by inner product: one robust-pruned graph per shard, beam search in all.

Equal vectors are one *class*, indexed once, so a vector that a third of all rows share is one point
of a graph; a class keeps its ``k + 1`` smallest ids, which is all that a query can be given of it.
Classes are dealt to shards by hash, each of about ``shard_size`` points. Inner product becomes
distance by one more coordinate (what a vector lacks of the largest norm). A shard's graph is one row
of a stored table; queries travel in blocks of bounded size, and every (shard, block) pair is searched
in one task. Hits are scored again on the original vectors in double precision.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows
without an id, take no part. Vectors of different lengths are not compared. Equal scores go to the
smaller id. Repeated rows are one row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inclina.llm.store import stored
from inclina.llm.vector_graph import Graph
from inclina.operators.joins import left_join_ns

INDEX = "dim int, shard int, ids binary, vectors binary, reach double, edges binary, start int, degree int"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows that take part, components as doubles."""
    v = F.transform(F.col("_v"), lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("_v")).where("vec_id IS NOT NULL AND _v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select("vec_id", v.alias("v")).where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """Members of each class of equal vectors: (cls, vec_id, place, v), its ``keep`` smallest ids; ``cls`` is the smallest."""
    by = Window.partitionBy("v").orderBy("vec_id")
    placed = rows.withColumns({"place": F.dense_rank().over(by), "cls": F.first("vec_id").over(by)}).where(F.col("place") <= keep)
    return placed.dropDuplicates(["cls", "place"])


def _sum_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added from the first component on."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        out += a[..., j] * b[..., j]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build_index(points: DataFrame, shard_size: int = 8192, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row per shard of ``points`` (cls, v): its vectors, ids and graph, stored."""
    n, reach = points.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    shards = max(1, -(-n // shard_size))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        x = _matrix(table.column("v").combine_chunks())
        spare = np.sqrt(np.maximum((reach or 0.0) - (x * x).sum(axis=1), 0))
        graph = Graph(np.column_stack([x, spare]), degree).build(beam, alpha)
        row = {
            "dim": x.shape[1], "shard": table.column("shard")[0].as_py(), "ids": table.column("cls").combine_chunks().to_numpy().astype("<i8").tobytes(),
            "vectors": x.astype("<f8").tobytes(), "reach": reach, "edges": graph.edges.astype("<i4").tobytes(), "start": graph.start, "degree": degree,
        }
        kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        return pa.Table.from_pylist([row], schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INDEX.split(", ")]))

    dealt = points.select("cls", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"))
    return stored(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, INDEX), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 100, block: int = 8192) -> DataFrame:
    """Per query (cls, v): its ``k`` best points found in each shard of its length, as (query, cls, score)."""
    blocks = max(1, -(-queries.count() // block))

    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks())
        return pa.table({
            "dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "asked": pa.array([table.column("cls").combine_chunks().to_numpy().astype("<i8").tobytes()]), "questions": pa.array([x.astype("<f8").tobytes()]),
        })

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                x = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
                spare = np.sqrt(np.maximum(r["reach"] - (x * x).sum(axis=1), 0))
                edges = np.frombuffer(r["edges"], "<i4").reshape(len(x), -1)
                graph = Graph(np.column_stack([x, spare]), r["degree"], edges, r["start"])
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["asked"], "<i8")
                q = np.frombuffer(r["questions"], "<f8").reshape(-1, r["dim"])
                for at in range(0, len(q), 512):
                    part = q[at : at + 512]
                    found, _, _ = graph.search(np.column_stack([part, np.zeros(len(part))]), beam)
                    score = np.where(found >= 0, _sum_products(x[found], part[:, None, :]), -np.inf)
                    key = np.where(found >= 0, ids[found], np.iinfo(np.int64).max)
                    order = np.lexsort((key, -score), axis=1)[:, :k]
                    ok = np.take_along_axis(found, order, 1) >= 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asked[at : at + 512], ok.sum(axis=1))), pa.array(np.take_along_axis(key, order, 1)[ok]), pa.array(np.take_along_axis(score, order, 1)[ok])],
                        names=["query", "cls", "score"],
                    )

    dealt = queries.select("cls", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"))
    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, asked binary, questions binary")
    shards = index.select("dim", "shard").distinct()
    by_block = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by_shard = packed.join(shards, "dim")
    pairs = by_block.join(by_shard, ["dim", "shard", "block"])
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.drop("block", "shard").repartition(tasks).mapInArrow(look, "query long, cls long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20, shard_size: int = 8192, beam: int = 100) -> DataFrame:
    """The ``k`` rows nearest to each row for which ``is_query`` (a column over vec_id) holds, itself left out:
    (query_id, rank, vec_id, score)."""
    rows = usable(vectors)
    members = stored(classes(rows, k + 1), "vector-classes")
    points = members.where(F.col("place") == 1).select("cls", "v")
    asked = rows.where(is_query).select("vec_id", "v").distinct()
    asked = asked.join(points, "v").select("vec_id", "cls")
    asked = stored(asked, "vector-queries")
    questions = points.join(asked.select("cls").distinct(), "cls")
    hits = search(build_index(points, shard_size), questions, k + 1, beam)
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    hits = hits.withColumn("at", F.row_number().over(by_class)).where(F.col("at") <= k + 1)
    found = hits.join(members.select("cls", "vec_id"), "cls")
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(by_row)).where(F.col("at") <= k + 1).select("query", "vec_id", "score")
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))).alias("list"))
    own = left_join_ns(asked.withColumnRenamed("vec_id", "query_id"), lists, [("cls", "query")], "inner")
    rest = own.select("query_id", F.slice(F.filter("list", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return rest.select("query_id", F.posexplode("list").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
