"""Item-based collaborative filtering on a long (user, item, rating) table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.operators.aggregates import long_to_wide
from inclina.operators.joins import BROADCAST_ROWS, attach_checked
from inclina.operators.ordering import exact_quantiles, number_rows, top_per_group
from inclina.session import materialize

#: Items per block of the co-rating products; a task holds four block x block matrices.
BLOCK_ITEMS = 512

#: Users per tile of such a product.
TILE_USERS = 1024


def unique_ratings(df: DataFrame, user: str, item: str, rating: str, combine=None) -> DataFrame:
    """Rated cells, one row each. Repeated cells fail unless an aggregate is given (try ``F.avg``)."""
    value: Column
    if combine is None:
        value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated rating"))).otherwise(F.max(rating))
    else:
        value = combine(rating)
    return df.where(F.col(rating).isNotNull()).groupBy(user, item).agg(value.cast("double").alias(rating))


def rating_counts(df: DataFrame, side: str, rating: str) -> DataFrame:
    """Ratings per item (or user)."""
    return df.where(F.col(rating).isNotNull()).groupBy(side).agg(F.count(F.lit(1)).alias("n"))


def count_quantile(df: DataFrame, side: str, rating: str, p: float = 0.95) -> DataFrame:
    """Quantile of the number of ratings per item (or user)."""
    return exact_quantiles(rating_counts(df, side, rating), [], "n", [p], repeats=True).select(F.col("q0").alias("q"))


def user_means(df: DataFrame, user: str, rating: str) -> DataFrame:
    return df.groupBy(user).agg(F.avg(rating).alias("user_mean"))


def center(df: DataFrame, user: str, rating: str, out: str = "centered") -> DataFrame:
    """Rating minus the user's mean. The means are combined map-side and joined back, so a user with
    very many ratings is split by adaptive execution instead of filling one window task."""
    return df.join(user_means(df, user, rating), user).withColumn(out, F.col(rating) - F.col("user_mean"))


def binarize(df: DataFrame, rating: str, at_least: float = 3, out: str = "good") -> DataFrame:
    return df.withColumn(out, (F.col(rating) >= F.lit(at_least)).cast("int"))


def _block_products(block: int):
    """Sums over co-rating users for one pair of item blocks, as dense products of user x item tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums, rest = None, None, None

        def emit():
            if sums is None:
                return None
            dot, left, right, both = sums
            i, j = np.nonzero(both)
            return pd.DataFrame(
                {
                    "i": current[0] * block + i,
                    "j": current[1] * block + j,
                    "dot": dot[i, j],
                    "sq_i": left[i, j],
                    "sq_j": right[i, j],
                    "n": both[i, j].astype("int64"),
                }
            )

        def add(rows: pd.DataFrame) -> None:
            codes = pd.factorize(rows["user"])[0]
            item_no, values = rows["item_no"].to_numpy(), rows["value"].to_numpy()
            for start in range(0, codes.max() + 1, TILE_USERS):
                tiles, users = [], min(TILE_USERS, codes.max() + 1 - start)  # a batch often holds few users
                for side in sorted({*current}):
                    own = (item_no // block == side) & (codes >= start) & (codes < start + TILE_USERS)
                    value = np.zeros((users, block))
                    seen = np.zeros((users, block))
                    at = (codes[own] - start, item_no[own] % block)
                    value[at] = values[own]
                    seen[at] = 1.0
                    tiles.append((value, seen))
                if current[0] == current[1]:  # one block with itself: the second tile is the first
                    tiles *= 2
                (x, a), (y, b) = tiles
                sums[0] += x.T @ y
                sums[1] += (x * x).T @ b
                sums[2] += a.T @ (y * y)
                sums[3] += a.T @ b

        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
                rest = None
            if batch.empty:
                continue
            pair_no = batch[["block_i", "block_j", "user"]].ne(batch[["block_i", "block_j", "user"]].shift()).any(axis=1).cumsum()
            # the last user of a batch may go on in the next one
            open_rows = pair_no == pair_no.iloc[-1]
            rest, ready = batch[open_rows], batch[~open_rows]
            for pair, rows in ready.groupby(["block_i", "block_j"], sort=False):
                if pair != current:
                    done = emit()
                    if done is not None:
                        yield done
                    current, sums = pair, [np.zeros((block, block)) for _ in range(4)]
                add(rows)
        if rest is not None and not rest.empty:
            pair = (rest["block_i"].iloc[0], rest["block_j"].iloc[0])
            if pair != current:
                done = emit()
                if done is not None:
                    yield done
                current, sums = pair, [np.zeros((block, block)) for _ in range(4)]
            add(rest)
        done = emit()
        if done is not None:
            yield done

    return run


def copies_to_block_pairs(rows: DataFrame, block: int, n_blocks: int) -> DataFrame:
    """Rows (user, item_no, value) once per pair of blocks in which they meet another rating of their user, or themselves."""
    own = (F.col("item_no") / block).cast("int")
    if n_blocks == 1:
        return rows.withColumns({"block_i": F.lit(0), "block_j": F.lit(0)})
    rows = materialize(rows)
    # at most n_blocks numbers a user, combined before the shuffle
    blocks = rows.groupBy("user").agg(F.collect_set(own).alias("_blocks"))
    pairs = F.transform("_blocks", lambda b: F.struct(F.least(own, b).alias("block_i"), F.greatest(own, b).alias("block_j")))
    return rows.join(blocks, "user").select("user", "item_no", "value", F.inline(pairs))


def co_rated_sums(df: DataFrame, user: str, item: str, value: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """For every two items rated by a common user: sum of products, both sums of squares, users.

    No pair of ratings is ever a row. Items get consecutive numbers and fall into blocks; a rating goes
    to the pairs of its own block with the blocks its user rated in (a user of b blocks sends each rating b times,
    however many blocks there are), users spread over the tasks, and each task multiplies
    user x item tiles. One (user, block pair) holds at most two blocks of ratings however active the
    user, and a task emits sums, not pairs. Up to ``block`` items there is exactly one block pair.
    """
    # Stored, because items and tiles read it: centring alone is two shuffles.
    rated = materialize(df.select(F.col(user).cast("string").alias("user"), F.col(item).alias("_item"), F.col(value).cast("double").alias("value")))
    items = materialize(number_rows(rated.select("_item").distinct(), [], ["_item"], "item_no"))
    n_items = items.count()
    block = max(1, min(block, n_items))
    n_blocks = max(1, -(-n_items // block))
    items = items.withColumn("item_no", (F.col("item_no") - 1).cast("int"))
    lookup = F.broadcast(items) if n_items <= BROADCAST_ROWS else items
    rows = copies_to_block_pairs(
        rated.join(lookup, "_item").select("user", "item_no", "value"), block, n_blocks,
    )
    tiles = rows.repartition("block_i", "block_j", "user").sortWithinPartitions("block_i", "block_j", "user")
    partial = tiles.mapInPandas(
        _block_products(block), "i long, j long, dot double, sq_i double, sq_j double, n long"
    )
    total = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("dot", "sq_i", "sq_j", "n")])
    one_way = total.where(F.col("i") != F.col("j"))
    if n_blocks > 1:  # block pairs are held once; within the diagonal blocks both orders are present
        off = (F.col("i") / block).cast("int") != (F.col("j") / block).cast("int")
        turned = one_way.where(off).select(
            F.col("j").alias("i"), F.col("i").alias("j"), "dot", F.col("sq_j").alias("sq_i"), F.col("sq_i").alias("sq_j"), "n"
        )
        one_way = one_way.unionByName(turned)
    names = lambda a, b: items.select(F.col("item_no").alias(a), F.col("_item").alias(b))
    hint = F.broadcast if n_items <= BROADCAST_ROWS else (lambda d: d)
    return (
        one_way.join(hint(names("i", "item_i")), "i")
        .join(hint(names("j", "item_j")), "j")
        .select("item_i", "item_j", "dot", "sq_i", "sq_j", "n")
    )


def item_similarity(
    df: DataFrame, user: str, item: str, rating: str, k: int | None = 30, block: int = BLOCK_ITEMS
) -> DataFrame:
    """Cosine of user-centred ratings over co-rating users; the ``k`` nearest items of each item.

    A zero denominator gives no pair, an item is not its own neighbour, ties go to the smaller item.
    """
    return similarity_of_sums(co_rated_sums(center(df, user, rating), user, item, "centered", block), k)


def similarity_of_sums(sums: DataFrame, k: int | None = 30) -> DataFrame:
    """The similarities that co-rating sums (fresh or updated) stand for."""
    sim = F.try_divide(F.col("dot"), F.sqrt("sq_i") * F.sqrt("sq_j"))
    pairs = sums.withColumn("sim", sim).where(F.col("sim").isNotNull()).select("item_i", "item_j", "sim", "n")
    if k is None:
        return pairs
    return top_per_group(pairs, ["item_i"], [F.desc("sim"), F.asc("item_j")], k).drop("rank")


def with_changes(ratings: DataFrame, changes: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """Ratings after changes: a changed cell takes its new rating, null withdraws it. One row per cell on both sides."""
    new = changes.select(user, item, F.col(rating).cast("double").alias("_new"), F.lit(True).alias("_told"))
    both = ratings.select(user, item, F.col(rating).cast("double").alias("_old")).join(new, [user, item], "full")
    now = F.when(F.col("_told"), F.col("_new")).otherwise(F.col("_old"))
    return both.select(user, item, now.alias(rating)).where(F.col(rating).isNotNull())


def kept_sums(ratings: DataFrame, user: str, item: str, rating: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """Co-rating sums of user-centred ratings in the form to be stored and updated: ``top_i`` and ``top_j`` are the largest
    values the sums of squares have had since they were summed afresh."""
    sums = co_rated_sums(center(ratings, user, rating), user, item, "centered", block)
    return sums.withColumns({"top_i": F.col("sq_i"), "top_j": F.col("sq_j")})


def update_sums(
    sums: DataFrame, ratings: DataFrame, changes: DataFrame, user: str, item: str, rating: str, block: int = BLOCK_ITEMS,
    cancelled: float = 2.0**-20,
) -> DataFrame:
    """Stored :func:`kept_sums` of ``ratings``, brought to what they are after ``changes`` (as in :func:`with_changes`).

    The sums are additive over users, and a change moves its user's mean and with it all products of that user. So the
    users named in the changes are taken out with their old ratings and put in with their new ones; all other users' products
    stay in the stored sums, and the work grows with the touched users' ratings plus one merge of the table.

    Taking out loses digits where little is left: pairs whose sum of squares fell under ``cancelled`` of its largest value are
    summed afresh, over the ratings of their items alone. Pairs without a common user are gone. ``ratings`` is read three times
    (the last time only if a pair was cancelled) and should be a stored table; the result should be stored before the next update.
    """
    touched = materialize(changes.select(user).distinct().withColumn("_touched", F.lit(True)))
    mine = lambda d: attach_checked(d, touched, [user]).where("_touched").drop("_touched")
    before = materialize(mine(ratings.select(user, item, rating)))
    parts = [(1.0, with_changes(before, changes, user, item, rating)), (-1.0, before)]
    names = ["dot", "sq_i", "sq_j"]
    out = sums.select("item_i", "item_j", *names, "n", "top_i", "top_j")
    for sign, rows in parts:
        part = kept_sums(rows, user, item, rating, block)
        signed = {c: F.col(c) * sign for c in names} | {"n": (F.col("n") * int(sign)).cast("bigint")}
        tops = {c: F.lit(0.0) if sign < 0 else F.col(c) for c in ("top_i", "top_j")}
        out = out.unionByName(part.withColumns(signed | tops))
    merged = materialize(
        out.groupBy("item_i", "item_j").agg(*[F.sum(c).alias(c) for c in (*names, "n")], F.sum("top_i").alias("top_i"), F.sum("top_j").alias("top_j")).where("n > 0")
    )
    weak = [(F.col(f"top_{s}") > 0) & (F.col(f"sq_{s}") <= F.col(f"top_{s}") * cancelled) for s in "ij"]
    lost = materialize(merged.where(weak[0] | weak[1]).select("item_i", "item_j", F.lit(True).alias("_lost")))
    if not lost.limit(1).count():
        return merged
    items = materialize(lost.select(F.explode(F.array("item_i", "item_j")).alias(item)).distinct().withColumn("_asked", F.lit(True)))
    centred = center(with_changes(ratings, changes, user, item, rating), user, rating)
    rows = attach_checked(centred, items, [item]).where("_asked")
    fresh = co_rated_sums(rows, user, item, "centered", block).join(lost.drop("_lost"), ["item_i", "item_j"])
    fresh = fresh.withColumns({"top_i": F.col("sq_i"), "top_j": F.col("sq_j")})
    return attach_checked(merged, lost, ["item_i", "item_j"]).where(F.col("_lost").isNull()).select(*merged.columns).unionByName(fresh)


def user_similarity(df: DataFrame, user: str, item: str, rating: str, k: int | None = None) -> DataFrame:
    """The same with the roles of users and items exchanged; for a chosen set of users."""
    return item_similarity(df, item, user, rating, k)


def neighbour_counts(similarity: DataFrame) -> DataFrame:
    """How many items have n positive neighbours."""
    per_item = similarity.groupBy("item_i").agg(F.count_if(F.col("sim") > 0).alias("neighbours"))
    return per_item.groupBy("neighbours").agg(F.count(F.lit(1)).alias("items"))


def predict_ratings(
    df: DataFrame, similarity: DataFrame, user: str, item: str, rating: str, known: str = "predict"
) -> DataFrame:
    """Predicted rating per (user, item) with at least one rated neighbour; absent rows are null cells.

    Each rating meets the items that count it among their k neighbours, and the sums are combined
    before the shuffle. ``known='keep'`` returns given ratings in place of their predictions.
    """
    if known not in ("predict", "keep"):
        raise ValueError(f"unknown mode {known!r}")
    near = materialize(similarity.select(F.col("item_i").alias("_target"), F.col("item_j").alias(item), "sim"))
    if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = F.broadcast(near)
    centred = center(df, user, rating)
    scored = (
        centred.join(near, item)
        .groupBy(user, F.col("_target").alias(item))
        .agg(
            F.sum(F.col("sim") * F.col("centered")).alias("_up"),
            F.sum(F.abs("sim")).alias("_down"),
            F.first("user_mean").alias("_mean"),
        )
        .withColumn("prediction", F.col("_mean") + F.try_divide(F.col("_up"), F.col("_down")))
        .where(F.col("prediction").isNotNull())
        .select(user, item, "prediction")
    )
    if known == "predict":
        return scored
    both = scored.join(df.select(user, item, F.col(rating).alias("_given")), [user, item], "full")
    return both.select(user, item, F.coalesce("_given", "prediction").alias("prediction"))


def pick_items(predictions: DataFrame, users: DataFrame, user: str, item: str, wanted: Sequence[str]) -> DataFrame:
    """One row per user with a column per wanted item, null where nothing can be predicted."""
    few = predictions.where(F.col(item).isin(list(wanted)))
    return users.select(user).distinct().join(long_to_wide(few, [user], item, "prediction", wanted), user, "left")
