"""Isolation scoring of the short-term features, one forest per sensor type.

Every tree draws its own sample from all rows of its type by row hashes; each tree is built
by one task from its own sample. The finished forest has a fixed size (types x trees x 2 x samples nodes), so it
is sent to the executors, which score all rows in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.rounding import round_even
from ..params import Params
from ..session import materialize
from .detectors import with_short_features

FEATURES = ("z", "delta_z", "mean_short", "std_short", "mean_long")
NODES = "sensor_type string, tree bigint, sample bigint, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def path_length(n: float) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def build_tree(rows: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """Node arrays of one isolation tree; a leaf has feature -1 and its expected path length in ``depth``."""
    limit = math.ceil(math.log2(max(len(rows), 2)))
    feature, cut, left, right, depth = [], [], [], [], []

    def grow(points: np.ndarray, level: int) -> int:
        node = len(feature)
        for column in (feature, left, right):
            column.append(-1)
        cut.append(0.0)
        depth.append(level + path_length(len(points)))
        low, high = points.min(axis=0), points.max(axis=0)
        varying = np.flatnonzero(high > low)
        if level < limit and len(points) > 1 and len(varying):
            f = int(varying[int(rng.random() * len(varying))])
            at = float(low[f] + rng.random() * (high[f] - low[f]))
            below = points[:, f] <= at
            if below.any() and not below.all():
                feature[node], cut[node] = f, at
                left[node] = grow(points[below], level + 1)
                right[node] = grow(points[~below], level + 1)
        return node

    grow(rows, 0)
    return feature, cut, left, right, depth


def training_rows(features: DataFrame, params: Params) -> DataFrame:
    """(sensor_type, tree, features): every tree's sample without replacement, drawn from all rows of its type.

    A tree takes the smallest of its own hashes of the rows. A threshold per type, from the row count, leaves about three
    times the sample to be ranked; a row is dealt only to the trees whose threshold it passes.
    """
    sizes = features.groupBy("sensor_type").agg(F.count("*").alias("_n"))
    limit = F.least(F.lit(1.0), (3.0 * params.forest_samples + 100) / F.col("_n")) * float(1 << 40)
    trees = F.sequence(F.lit(0), F.lit(params.forest_trees - 1))
    row = F.xxhash64("sensor_id", "cell", F.lit(params.forest_seed))
    draw = lambda t: F.pmod(F.xxhash64("_h", t), F.lit(1 << 40))
    dealt = (
        features.withColumn("_h", row)
        .join(F.broadcast(sizes.select("sensor_type", limit.alias("_limit"))), "sensor_type")  # one row per sensor type
        .withColumn("tree", F.explode(F.filter(trees, lambda t: draw(t) <= F.col("_limit"))))
        .withColumn("_t", draw(F.col("tree")))
    )
    pick = F.row_number().over(W.partitionBy("sensor_type", "tree").orderBy("_t", "sensor_id", "cell"))
    return dealt.withColumn("_k", pick).where(F.col("_k") <= params.forest_samples)


def cores_of(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


def grow_forest(features: DataFrame, params: Params) -> DataFrame:
    """One row per (sensor type, tree) holding the tree's node arrays."""
    seed = params.forest_seed

    def one_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        f, c, l, r, d = build_tree(pdf[list(FEATURES)].to_numpy(), rng)
        return pd.DataFrame(
            {
                "sensor_type": [pdf["sensor_type"].iloc[0]],
                "tree": [tree],
                "sample": [len(pdf)],
                "feature": [f],
                "cut": [c],
                "left": [l],
                "right": [r],
                "depth": [d],
            }
        )

    chosen = training_rows(features, params).select("sensor_type", "tree", "_k", *FEATURES)
    # small data, costly groups: a fixed number of partitions keeps the trees from being packed into a few tasks
    tasks = min(params.forest_trees, cores_of(features))
    return chosen.repartition(tasks, "sensor_type", "tree").groupBy("sensor_type", "tree").applyInPandas(one_tree, NODES)


def average_depth(rows: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Mean path length of every row over the trees, all rows of a batch walking a tree level by level."""
    total = np.zeros(len(rows))
    at = np.arange(len(rows))
    for feature, cut, left, right, depth in trees:
        node = np.zeros(len(rows), dtype=np.int64)
        moving = feature[node] >= 0
        while moving.any():
            rows_at = at[moving]
            n = node[moving]
            below = rows[rows_at, feature[n]] <= cut[n]
            node[moving] = np.where(below, left[n], right[n])
            moving = feature[node] >= 0
        total += depth[node]
    return total / max(len(trees), 1)


def with_forest_scores(scores: DataFrame, params: Params) -> DataFrame:
    """Adds ``forest_score`` in (0, 1], rounded to four decimals; about 0.5 for ordinary readings."""
    features = materialize(with_short_features(scores, params), "forest-features")  # counted, sampled and scored
    models: dict[str, tuple[int, list[tuple]]] = {}
    # Bounded by (sensor types in the threshold table) x trees x nodes per tree; see the module text.
    for row in grow_forest(features, params).collect():
        arrays = tuple(
            np.array(values, dtype=kind)
            for values, kind in (
                (row.feature, np.int64), (row.cut, float), (row.left, np.int64), (row.right, np.int64), (row.depth, float)
            )
        )
        models.setdefault(row.sensor_type, (row.sample, []))[1].append(arrays)
    shared = scores.sparkSession.sparkContext.broadcast(models)
    schema = features.select(*scores.columns).schema.add("forest_score", "double")
    keep = scores.columns

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            kinds = pdf["sensor_type"].to_numpy()
            for kind in pd.unique(kinds):
                sample, trees = shared.value.get(kind, (0, []))
                if sample > 1:
                    here = kinds == kind
                    depth = average_depth(pdf.loc[here, list(FEATURES)].to_numpy(), trees)
                    out[here] = np.power(2.0, -depth / path_length(sample))
            yield pdf[keep].assign(forest_score=out)

    return features.mapInPandas(score, schema).withColumn(
        "forest_score", round_even(F.nanvl("forest_score", F.lit(None).cast("double")), 4)
    )
