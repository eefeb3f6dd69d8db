"""Accuracy of results against truth, and training of the linear confidence by a genetic search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(results: DataFrame, truth: DataFrame, keys: list[str], key: str = "identity_key") -> DataFrame:
    """identical, total: result rows (not distinct) whose key is among the truth's of the same file, and the truth's rows."""
    hits = results.join(truth.select(*keys, key).distinct(), [*keys, key], "left_semi").agg(F.count("*").alias("identical"))
    return hits.crossJoin(truth.agg(F.count("*").alias("total")))


def ideal_recall(results: DataFrame, truth: DataFrame, keys: list[str], key: str = "identity_key") -> DataFrame:
    """recall: distinct truth keys of a file that are among its results, over all distinct truth keys."""
    t, r = truth.select(*keys, key).distinct(), results.select(*keys, key).distinct()
    return t.join(r, [*keys, key], "left_semi").agg(F.count("*").alias("hits")).crossJoin(t.agg(F.count("*").alias("total"))).select(F.try_divide("hits", "total").alias("recall"))


def model_recall(scored: DataFrame, total: int, doc: str = "file_id", res: str = "res_iter", score: str = "score", target: str = "target", key: str = "identity_key", places: int = 9, by: list[str] = ()) -> DataFrame:
    """by, recall: distinct right keys at each document's best resolution, over `total`.

    The best mean score starts from 0, not from minus infinity: where no mean is positive resolution 0 is taken. On a tie
    resolution 2 or 3 wins, then the first.
    """
    by = list(by)
    mean = scored.groupBy(*by, doc, res).agg(F.round(F.avg(score), places).alias("m"))
    top = F.max(F.when(F.col("m") > 0, F.struct("m", F.col(res).isin(2, 3).alias("usual"), (-F.col(res)).alias("early")))).alias("top")
    # a mean of exactly 0 at resolution 2 or 3 ties with the start where nothing is positive
    zero = F.min(F.when((F.col("m") == 0) & F.col(res).isin(2, 3), F.col(res))).alias("zero")
    best = mean.groupBy(*by, doc).agg(top, zero).select(*by, doc, F.coalesce(-F.col("top.early"), "zero", F.lit(0)).alias(res))
    right = scored.where(F.col(target) == 1).join(best, [*by, doc, res], "left_semi").select(*by, doc, key).distinct()
    if by:
        return scored.select(*by).distinct().join(right.groupBy(*by).count(), by, "left").select(*by, (F.coalesce("count", F.lit(0)) / F.lit(float(total))).alias("recall"))
    return right.agg((F.count("*") / F.lit(float(total))).alias("recall"))


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


def dot(features: str, weights: str) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def feature_means(results: DataFrame) -> DataFrame:
    """file_id, rows of (res, means, right) of `results` (file_id, res_iter, identity_key, target, features): for each resolution of a file the mean of
    each feature and the number of distinct right keys. All that the choice of resolutions and recall need; a file has few resolutions.
    """
    each = results.select("file_id", "res_iter", F.posexplode("features").alias("k", "v")).groupBy("file_id", "res_iter", "k").agg(F.avg("v").alias("m"))
    means = each.groupBy("file_id", "res_iter").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("means"))
    right = results.where("target = 1").groupBy("file_id", "res_iter").agg(F.count_distinct("identity_key").alias("right"))
    whole = means.join(right, ["file_id", "res_iter"], "left").select("file_id", F.struct(F.col("res_iter").alias("res"), "means", F.coalesce("right", F.lit(0)).alias("right")).alias("r"))
    return whole.groupBy("file_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))


def hits(means: DataFrame, crowd: np.ndarray, places: int = 9) -> np.ndarray:
    """Right keys that each candidate's weights (a column of crowd) find in all files, choosing resolutions as `model_recall` does; means is of `feature_means`."""
    import pandas as pd

    def run(batches):
        total = np.zeros(crowd.shape[1], np.int64)
        for pdf in batches:
            for rows in pdf["rows"]:
                res, right = np.array([r["res"] for r in rows]), np.array([r["right"] for r in rows])
                score = np.round(np.array([r["means"] for r in rows], float) @ crowd, places)
                usual = np.isin(res, (2, 3))[:, None]
                # the first of the best in this order: score, resolution 2 or 3, smaller resolution; a score must be over 0, or 0 at 2 or 3
                able = (score > 0) | ((score == 0) & usual)
                order = np.lexsort((np.broadcast_to(res[:, None], score.shape), ~np.broadcast_to(usual, score.shape), -score), axis=0)[0]
                at = np.where(np.take_along_axis(able, order[None, :], 0)[0], order, -1)
                start = np.flatnonzero(res == 0)
                total += np.where(at >= 0, right[at], right[start[0]] if len(start) else 0)
        yield pd.DataFrame({"candidate": np.arange(len(total)), "n": total})

    out = np.zeros(crowd.shape[1], np.int64)
    for r in means.mapInPandas(run, "candidate long, n long").groupBy("candidate").agg(F.sum("n").alias("n")).collect():  # a number a candidate
        out[r["candidate"]] = r["n"]
    return out


def train_weights(results: DataFrame, total: int, ideal: float, size: int, population: int = 100, elite: int = 10, rounds: int = 1000, tolerance: float = 0.001, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights for the feature array of `results` (file_id, res_iter, identity_key, target, features) and their recall.

    Unit vectors; each round keeps the best, adds as many random ones, and fills up with one-point crossovers of any two. Records are read once, for
    their means; a round reads those, a row a file, and scores the whole population by one product of matrices.
    """
    from ..sources.storage import cut

    rng = np.random.default_rng(seed)
    means = cut(feature_means(results))
    crowd = [unit(rng.uniform(-1, 1, size)) for _ in range(population)]
    best, recall = crowd[0], -1.0
    for _ in range(rounds):
        got = hits(means, np.stack(crowd, axis=1)) / total
        order = sorted(range(len(crowd)), key=lambda i: (-got[i], i))
        if got[order[0]] > recall:
            best, recall = crowd[order[0]], float(got[order[0]])
        if recall >= ideal - tolerance:
            break
        nxt = [crowd[i] for i in order[:elite]] + [unit(rng.uniform(-1, 1, size)) for _ in range(elite)]
        while len(nxt) < population:
            a, b, at = rng.integers(population), rng.integers(population), rng.integers(size)
            nxt.append(unit(np.concatenate([crowd[a][:at], crowd[b][at:]])))
        crowd = nxt
    return best, recall
