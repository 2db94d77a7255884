"""Implicit-feedback recommendations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.ordering import with_position
from vertexloom.functions.rounds import checkpointed, ensure_checkpoint_dir, measure, row_count, union_all

# The training constants of a recommendation job.
RANK = 10
ITERATIONS = 20
REGULARIZATION = 8.0
ALPHA = 0.01
TOP_ITEMS = 10

ITEM_BLOCK = 65_536  # items that users meet in a round, by falling length of their factors
LEAF = 256  # items of a block that lie close together and have one box of factors
USERS = 256  # users that meet a leaf at once

RATINGS_PER_BLOCK = 4_000_000  # a task of the training builds and sorts blocks of so many
BLOCKS = 10, 64  # fewest and most blocks of users and of items: each task deals ratings into the square of that many


def train_implicit(
    ratings: DataFrame,
    rank: int = RANK,
    iterations: int = ITERATIONS,
    reg: float = REGULARIZATION,
    alpha: float = ALPHA,
    seed: int = 0,
) -> ALSModel:
    """Alternating least squares on ``(user, item, rating)``, the rating being a weight of confidence.

    The default regularisation is strong: on small data all scores come out as 0.0 and only ties remain. Pass a
    smaller ``reg`` (such as 0.1) for a ranking that means something there.

    Blocks of users and items grow in number with the ratings, so that a task's share does not. More blocks send more
    factors around: their files are then cut off every second iteration.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    blocks = training_blocks(row_count(ratings))
    als = ALS(
        userCol="user", itemCol="item", ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=iterations,
        regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks,
        checkpointInterval=10 if blocks == BLOCKS[0] else 2,
    )
    return als.fit(ratings)


def training_blocks(ratings: int) -> int:
    fewest, most = BLOCKS
    return max(fewest, min(most, -(-ratings // RATINGS_PER_BLOCK)))


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """``(user, item, prediction)`` for the given pairs; pairs with a user or item unknown to the model are absent."""
    return model.transform(pairs.select("user", "item"))


def rating_mse(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row ``mse``: mean squared difference of rating and prediction over the pairs in both frames."""
    both = ratings.join(predictions.select("user", "item", "prediction"), ["user", "item"])
    error = F.col("rating") - F.col("prediction").cast("double")
    return both.agg(F.avg(error * error).alias("mse"))


def distinct_users(ratings: DataFrame) -> DataFrame:
    return ratings.select("user").distinct()


def distinct_items(ratings: DataFrame) -> DataFrame:
    return ratings.select("item").distinct()


def unseen(ratings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those rows of ``candidates`` whose (user, item) is not rated."""
    fresh = candidates.join(ratings.select("user", "item"), ["user", "item"], "left_anti")
    return fresh.select(*candidates.columns)


def unseen_counts(ratings: DataFrame) -> DataFrame:
    """``(user, unseen)``: how many of all items each user has not rated, without listing users x items."""
    seen = ratings.select("user", "item").distinct().groupBy("user").agg(F.count(F.lit(1)).alias("_seen"))
    total = measure(ratings, items=F.countDistinct("item"))["items"]
    return seen.select("user", (F.lit(total) - F.col("_seen")).alias("unseen"))


def rank_candidates(scored: DataFrame, n: int = TOP_ITEMS) -> DataFrame:
    """``(user, item, rank)``: the ``n`` best of each user's ``(user, item, score)`` rows, ties by item id.

    Top-n lists are merged per salt first, so a user with most of the rows is not sorted in one task.
    """
    order = [F.col("score").desc(), F.col("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(64))
    within = Window.partitionBy("user", "_part").orderBy(*order)
    short = scored.withColumn("_part", part).withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= n)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).select("user", "item", "rank")


def best_unseen(
    users: DataFrame, items: DataFrame, seen: DataFrame, n: int = TOP_ITEMS, block: int = ITEM_BLOCK
) -> DataFrame:
    """``(user, item, rank, score double)``: the exact ``n`` best unseen items of each user by the product of factors.

    ``users`` holds ``(user, features)``, ``items`` ``(item, features)``, each id once, ``seen`` the pairs ``(user, item)``
    that don't count. Equal scores go by item id. Users or items without factors are not ranked. Products are summed in
    double precision, and rounded to floats where both factors are floats, as a model's predictions are.

    Items come in blocks of ``block``, by falling length of their factors. In a round every open user meets the next
    block, which goes to all tasks and is of bounded size, and keeps the best n met so far. A score is at most the product of the
    lengths, so a user is done when that of its own and the longest of the next block is below its n-th score. Inside a
    block, items that lie close together form leaves, each with a box around its factors; a user skips those whose box
    allows no score as good as its n-th. What a user has seen is brought along per block: a row never holds more of it
    than the block has items.
    """
    floats = all(frame.schema["features"].dataType.simpleString() == "array<float>" for frame in (users, items))
    plain = items.filter(F.col("features").isNotNull()).select("item", F.col("features").cast("array<double>").alias("features"))
    plain = plain.withColumn("length", F.sqrt(F.aggregate("features", F.lit(0.0), lambda total, x: total + x * x)))
    placed = with_position(plain.withColumn("falling", -F.col("length")), ["falling", "item"], "place")
    placed = checkpointed(placed.withColumn("block", F.floor(F.col("place") / block)))
    hidden = seen.select("user", "item").distinct().join(placed.select("item", "block"), "item")
    hidden = checkpointed(hidden.groupBy("user", "block").agg(F.collect_list("item").alias("hidden")))
    lengths = placed.groupBy("block").agg(F.max("length").alias("length"))
    following = lengths.select((F.col("block") - 1).alias("block"), F.col("length").alias("next_length"))
    packed = placed.groupBy("block").agg(F.collect_list("item").alias("items"), F.flatten(F.collect_list("features")).alias("factors"))
    packed = checkpointed(packed.join(following, "block", "left"))

    kind = users.schema["user"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"user {kind[0]}, features array<double>, met array<{kind[1]}>, scores array<double>, open boolean"
    state = users.filter(F.col("features").isNotNull()).select(
        "user", F.col("features").cast("array<double>").alias("features"),
        F.expr(f"CAST(array() AS array<{kind[1]}>)").alias("met"), F.expr("CAST(array() AS array<double>)").alias("scores"))
    blocks = measure(packed, blocks=F.max("block"))["blocks"]
    number, finished = 0, []
    while blocks is not None and number <= blocks:
        own = hidden.filter(F.col("block") == number).select("user", "hidden")
        row = packed.filter(F.col("block") == number).first()  # at most ``block`` items, sent to the tasks with the function
        ids = np.array(row["items"])
        meet = partial(_meet, n, floats, ids, np.array(row["factors"], float).reshape(len(ids), -1), row["next_length"])
        scored = checkpointed(state.join(own, "user", "left").mapInPandas(meet, schema))
        finished.append(scored.filter(~F.col("open")).select("user", "met", "scores"))
        state = scored.filter(F.col("open")).drop("open")
        number += 1
        if not row_count(state):
            break
    finished.append(state.select("user", "met", "scores"))
    listed = union_all(finished).select("user", F.posexplode(F.arrays_zip("met", "scores")).alias("place", "best"))
    return listed.select("user", F.col("best.met").alias("item"), (F.col("place") + 1).alias("rank"), F.col("best.scores").alias("score"))


def _leaves(factors: np.ndarray) -> list[np.ndarray]:
    """Places of items, halved along the widest factor until no part has more than ``LEAF``."""
    parts, leaves = [np.arange(len(factors))], []
    while parts:
        part = parts.pop()
        if len(part) <= LEAF:
            leaves.append(part)
            continue
        own = factors[part]
        widest = own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))]
        half = np.argpartition(widest, len(part) // 2)
        parts += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
    return leaves


def _meet(
    n: int, floats: bool, ids: np.ndarray, other: np.ndarray, limit: float | None, frames: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """Users meet one block of items: the best n so far, and whether the next block may hold a better one."""
    leaves = _leaves(other)
    low, high = (np.stack([end(other[leaf], axis=0) for leaf in leaves]) for end in (np.min, np.max))
    reach = np.maximum(np.abs(low), np.abs(high))
    by_id, leaf_of, place_in = np.argsort(ids), np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for number, leaf in enumerate(leaves):
        leaf_of[leaf], place_in[leaf] = number, np.arange(len(leaf))
    for frame in frames:
        features = np.stack(frame["features"].to_numpy()) if len(frame) else np.zeros((0, other.shape[1]))
        alike = np.lexsort(features.T)
        for at in range(0, len(frame), USERS):
            part, mine = frame.iloc[alike[at : at + USERS]], features[alike[at : at + USERS]]
            names = np.zeros((len(part), n), ids.dtype)
            scores = np.full((len(part), n), -np.inf)  # as long as there is none
            known = np.zeros((len(part), n), bool)
            for row, (old, old_scores) in enumerate(zip(part["met"], part["scores"])):
                names[row, : len(old)], scores[row, : len(old)], known[row, : len(old)] = old, old_scores, True
            seen = [np.asarray([] if hidden is None else hidden, ids.dtype) for hidden in part["hidden"]]
            seen_by = np.repeat(np.arange(len(part)), [len(hidden) for hidden in seen])
            seen = by_id[np.searchsorted(ids, np.concatenate(seen), sorter=by_id)]
            # The best that a box allows, and a little more for what rounding may add.
            bounds = np.maximum(mine, 0) @ high.T + np.minimum(mine, 0) @ low.T
            bounds += 1e-6 * (np.abs(mine) @ reach.T) + 1e-37
            for number in np.argsort(-bounds.max(axis=0)):
                least = np.where(known[:, -1], scores[:, -1], -np.inf)
                users = np.flatnonzero(bounds[:, number] >= least)
                if not len(users):
                    continue
                leaf = leaves[number]
                products = np.zeros((len(users), len(leaf)))
                for k in range(mine.shape[1]):  # the same order of summation in leaves of any size
                    products += mine[users, k : k + 1] * other[leaf, k]
                if floats:
                    products = products.astype(np.float32).astype(float)
                fresh = np.ones((len(part), len(leaf)), bool)
                here = np.flatnonzero(leaf_of[seen] == number)
                fresh[seen_by[here], place_in[seen[here]]] = False
                fresh = fresh[users] & (products >= least[users, None])
                better = np.flatnonzero(fresh.any(axis=1))
                if not len(better):
                    continue
                users, fresh = users[better], fresh[better]
                all_names = np.concatenate([names[users], np.broadcast_to(ids[leaf], fresh.shape)], axis=1)
                all_scores = np.concatenate([scores[users], products[better]], axis=1)
                all_known = np.concatenate([known[users], fresh], axis=1)
                best = np.lexsort((all_names, -all_scores, ~all_known), axis=-1)[:, :n]
                names[users], scores[users], known[users] = (
                    np.take_along_axis(values, best, axis=1) for values in (all_names, all_scores, all_known))
            many = known.sum(axis=1)
            still = np.zeros(len(part), bool)
            if limit is not None:
                # The bound is rounded: only one that is clearly lower ends the search.
                bound = limit * np.sqrt((mine**2).sum(axis=1)) * (1 + 1e-6) + 1e-37
                still = (many < n) | (bound >= scores[:, -1])
            yield pd.DataFrame({
                "user": part["user"], "features": list(mine), "met": [row[:k] for row, k in zip(names, many)],
                "scores": [row[:k] for row, k in zip(scores, many)], "open": still})


def recommend(
    ratings: DataFrame,
    n: int = TOP_ITEMS,
    rank: int = RANK,
    iterations: int = ITERATIONS,
    reg: float = REGULARIZATION,
    alpha: float = ALPHA,
    seed: int = 0,
) -> DataFrame:
    """``(user, item, rank)``: for each user the ``n`` unrated items of highest score, ranks 1..n without gaps; equal scores
    by item id. Scores are exact for the model's factors (see ``best_unseen``)."""
    return recommend_with_error(ratings, n, rank, iterations, reg, alpha, seed)[0]


def recommend_with_error(
    ratings: DataFrame,
    n: int = TOP_ITEMS,
    rank: int = RANK,
    iterations: int = ITERATIONS,
    reg: float = REGULARIZATION,
    alpha: float = ALPHA,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """What ``recommend`` gives, and one row ``mse``: the error of the model on the ratings it was trained on (null
    without ratings)."""
    ratings = checkpointed(ratings)
    if not row_count(ratings.limit(1)):
        nothing = ratings.select("user", "item", F.lit(0.0).alias("prediction"))
        return ratings.select("user", "item", F.lit(1).alias("rank")), rating_mse(ratings, nothing)
    model = train_implicit(ratings, rank, iterations, reg, alpha, seed)
    users, items = model.userFactors.withColumnRenamed("id", "user"), model.itemFactors.withColumnRenamed("id", "item")
    best = checkpointed(best_unseen(users, items, ratings, n).select("user", "item", "rank"))
    return best, rating_mse(ratings, predict(model, ratings))
