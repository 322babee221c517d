"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a word target (weights, with a cap on how often it may be repeated). Its documents
are dealt by hash into blocks of about ``block_words`` words and its blocks are permuted by a keyed
hash. Whole repetitions of the source take every block once; the last, partial one takes the first
blocks of the permutation and, in the block where the target falls, the first documents. That fixes an
exact quota of blocks per source.

A tree then deals the quotas to the output shards: a node with ``m`` shards gives its left child a
multivariate hypergeometric draw of half its blocks and the right child the rest, down to single
shards. Each shard so holds what one uniform shuffle of all blocks would have put there, sources in
exact total, and no shard ever sees another's list. A shard draws its blocks as the next free places of
each source's permutation (disjoint by construction) and shuffles its documents locally.

Only per-source and per-shard counts pass through one row; blocks and documents stay distributed, and
the join that gives documents their blocks is on (source, block), so a hot source is no hot key. All draws are
hashes of content and seed: reruns and recomputed partitions agree.

Defined results: null text has size 0; a source with size 0 has target 0. A null source is a source,
listed last. Repeated rows are taken alike. Rows without an id are told apart by their text. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inclina.llm.store import identity, stored
from inclina.operators.joins import attach_checked, left_join_ns
from inclina.operators.ordering import prefix_sums

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, boost: float, weights: Sequence[float], most: float) -> DataFrame:
    """``sizes`` (source, size) with ``place`` (0.. by code point, null last) and ``target``.

    Water filling: with sources in the order of ``most * size / weight``, those the level still
    covers are full, and the level of the rest is what is left over their weights. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_w": weight, "_full": F.lit(float(most)) * F.col("size")})
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), "place")
    earlier, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(boost)) * F.sum("size").over(everything) - F.coalesce(F.sum("_full").over(earlier), F.lit(0.0))) / F.sum("_w").over(rest)
    levelled = ranked.withColumn("_level", level).withColumn("_is_full", F.col("_level") > F.col("_full") / F.col("_w"))
    last = F.max(F.when(~F.col("_is_full"), F.struct(-F.col("_full") / F.col("_w"), -F.col("place"), F.col("_level")))).over(everything)["_level"]
    return levelled.select("source", "size", "place", F.when(F.col("_is_full"), F.col("_full")).otherwise(last * F.col("_w")).alias("target"))


#: Levels of the tree that one task draws from the root; the subtrees below are dealt to tasks.
TOP_LEVELS = 8


def _draws(levels: int, seed: int):
    """Nodes ``levels`` below each given node; a task holds one path of the tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, quotas in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes, parts, open_nodes = [], [], [(root, np.array(quotas, dtype=np.int64), levels)]
                while open_nodes:
                    node, have, left = open_nodes.pop()
                    if left:
                        draw = np.random.Generator(np.random.PCG64([seed, node])).multivariate_hypergeometric(have, int(have.sum()) // 2, method="marginals")
                        open_nodes += [(2 * node + 1, have - draw, left - 1), (2 * node, draw, left - 1)]
                        continue
                    nodes.append(node)
                    parts.append(have.tolist())
                    if len(nodes) == 1024 or not open_nodes:
                        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["node", "quotas"])
                        nodes, parts = [], []

    return run


def split_quotas(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """Leaves of the tree: ``shard`` and ``quotas``. ``root`` holds node 1 with the quotas of all sources."""
    schema, top = "node long, quotas array<bigint>", min(levels, TOP_LEVELS)
    tree = root.mapInArrow(_draws(top, seed), schema)
    if levels > top:
        tree = tree.repartition(1 << top, "node").mapInArrow(_draws(levels - top, seed), schema)
    return tree.select((F.col("node") - (1 << levels)).alias("shard"), "quotas")


def plan_mix(
    docs: DataFrame, boost: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, block_words: int = 50_000, shard_words: int = 4_000_000, seed: int = 7
) -> DataFrame:
    """Per row of ``docs``: its id as stored, ``doc`` and ``body`` (identity), source, size, source_size, target,
    and ``shards``: the shard of each copy the mix takes. There are enough shards (a power of two) for about
    ``shard_words`` words each."""
    text = F.coalesce(docs["text"], F.lit(""))
    items = stored(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), identity(docs).alias("doc"), F.xxhash64(text).alias("body"),
            docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "doc", "body")),
        "mix-items",
    )
    targets = source_targets(items.groupBy("source").agg(F.sum("size").alias("size")), boost, weights, most)
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    sources = stored(
        targets.withColumnRenamed("size", "source_size")
        .withColumn("whole", whole)
        .withColumn("part", target - F.col("whole") * size)
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(size / F.lit(float(block_words)))).cast("long")),
        "mix-sources",
    )
    placed = attach_checked(items, sources, ["source"]).withColumn("block", F.pmod("draw", "n_blocks"))
    sums = placed.groupBy("place", "block").agg(F.sum("size").alias("words"))
    keyed = sums.withColumn("turn", F.xxhash64(F.lit(seed + 1), "place", "block"))
    ordered = prefix_sums(keyed, ["place"], ["turn", "block"], {"words": F.col("words"), "n": F.lit(1)})
    quota = sources.select("place", "whole", "part", "n_blocks")
    blocks = attach_checked(ordered, quota, ["place"])
    before, after = F.col("words_before"), F.col("words_before") + F.col("words")
    blocks = stored(
        blocks.select(
            "place", "block", F.col("n_before").alias("turn"), "whole", "n_blocks",
            (after <= F.col("part")).alias("in_part"),
            F.when((before < F.col("part")) & (after > F.col("part")), F.col("part") - before).alias("need"),
        ),
        "mix-blocks",
    )
    rows = placed.join(blocks.select("place", "block", "turn", "in_part", "need"), ["place", "block"])
    # In the block where the target falls, documents come in hash order while their middle is below it.
    edge = rows.where(F.col("need").isNotNull() & (F.col("size") > 0))
    reach = prefix_sums(edge.select("place", "need", "draw", "size"), ["place"], ["draw"], {"size": F.col("size"), "n": F.lit(1)})
    taken = edge.select("place", "need").distinct().join(reach, "place").where(F.col("size_before") + F.col("size") / 2 <= F.col("need"))
    edge_docs = stored(taken.select("place", F.col("draw").alias("edge_draw")), "mix-edge")
    rows = left_join_ns(rows, edge_docs.withColumn("at_edge", F.lit(True)), ["place", ("draw", "edge_draw")])
    partial = F.coalesce(F.col("in_part"), F.lit(False)) | F.coalesce(F.col("at_edge"), F.lit(False))

    # Places of the permutation in use: whole turns first, then the blocks of the partial turn.
    used = blocks.groupBy("place").agg(
        F.first("whole").alias("whole"), F.first("n_blocks").alias("n_blocks"), F.max(F.when(F.col("in_part") | F.col("need").isNotNull(), F.col("turn") + 1)).alias("last")
    )
    listed = blocks.groupBy("place").agg(F.count(F.lit(1)).alias("n_listed"))
    quotas = used.join(listed, "place").select("place", "n_listed", (F.col("whole") * F.col("n_listed") + F.coalesce("last", F.lit(0))).alias("quota"))
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("q")).select(
        F.lit(1).cast("long").alias("node"), F.transform("q", lambda s: s["quota"].cast("long")).alias("quotas"), F.transform("q", lambda s: s["place"]).alias("places")
    ).where(F.size("quotas") > 0)
    total = sources.agg(F.sum("target")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1.0, total / shard_words))))
    leaves = stored(split_quotas(root.select("node", "quotas"), levels, seed), "mix-leaves")
    order = root.select(F.posexplode("places").alias("at", "place"))
    shares = leaves.select("shard", F.posexplode("quotas").alias("at", "count")).join(F.broadcast(order), "at")
    by_shard = Window.partitionBy("place").orderBy("shard")
    ranges = shares.withColumn("to", F.sum("count").over(by_shard)).where(F.col("count") > 0)
    seats = ranges.select("place", "shard", F.explode(F.sequence(F.col("to") - F.col("count"), F.col("to") - 1)).alias("seat"))
    turns = blocks.join(listed, "place").select(
        "place", "block", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda e: e * F.col("n_listed") + F.col("turn"))).alias("copy", "seat")
    )
    dealt = turns.join(seats, ["place", "seat"]).groupBy("place", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("shard_of")
    )
    copies = F.col("whole") + F.when(partial, 1).otherwise(0)
    out = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.col("whole")).cast("int")).join(dealt, ["place", "block"], "left")
    shards = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: F.col("shard_of")[c])).otherwise(
        F.array().cast("array<bigint>")
    )
    return out.select("doc_id", "doc", "body", "source", "size", "source_size", "target", shards.alias("shards"))


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The rows of the mix, with repeats: the columns of ``docs``, then ``shard`` unless it is one of them. Each
    shard is one partition, in its own shuffled order."""
    plan = plan_mix(docs, seed=seed, **options)
    decided = stored(
        plan.groupBy(F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("source").alias("_source")).agg(F.first("shards").alias("_shards")).where(F.size("_shards") > 0),
        "mix-decided",
    )
    shards = (decided.select(F.max(F.array_max("_shards"))).first()[0] or 0) + 1
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(
        *[docs[c].alias(n) for c, n in zip(docs.columns, columns)], identity(docs).alias("_doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_body"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("_name"), docs["source"].isNull().alias("_none"),
    )
    decided = decided.select("_doc", "_body", F.coalesce("_source", F.lit("")).alias("_name"), F.col("_source").isNull().alias("_none"), "_shards")
    rows = keyed.join(decided, ["_doc", "_body", "_name", "_none"]).select(*columns, "_doc", "_body", F.posexplode("_shards").alias("_copy", "_shard"))
    placed = rows.withColumn("_turn", F.xxhash64(F.lit(seed + 2), "_shard", "_doc", "_body", "_copy"))
    dealt = placed.repartitionById(shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", "_turn")
    return dealt.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, columns)], *([] if "shard" in docs.columns else [F.col("_shard").alias("shard")]))
