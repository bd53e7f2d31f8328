"""Clusters of kit colours: density clusters, and two kits with guards against splitting one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import hsv_distance
from touchline.tables import Stage

# fixed values, in units of (2h, s, v) and of the colour distance
EPS, LEAST_NEAR, LEAST_SIZE = 18.0, 3, 4
KITS_APART, HUES_APART, PALE, RICH = 45.0, 12.0, 60.0, 100.0
_BLOCK = 512
BROADCAST_ROWS = 100_000  # one row a match; more are joined by shuffle


def density_labels(x: np.ndarray, weight: np.ndarray, eps: float = EPS, least: int = LEAST_NEAR) -> np.ndarray:
    """Cluster numbers by first core point (-1: noise) of distinct points that stand for ``weight`` equal ones.

    A point is core if at least ``least`` points lie within ``eps`` of it; others join the cluster of the first core one near them.
    Distances are looked at block by block."""
    n = len(x)
    near: list[np.ndarray] = []
    for lo in range(0, n, _BLOCK):
        d = ((x[lo : lo + _BLOCK, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
        near += [np.flatnonzero(row) for row in d]
    core = np.array([weight[k].sum() >= least for k in near])
    label, n_clusters = np.full(n, -1), 0
    for first in range(n):
        if label[first] >= 0 or not core[first]:
            continue
        todo = [first]
        label[first] = n_clusters
        while todo:
            for k in near[todo.pop()]:
                if label[k] < 0:
                    label[k] = n_clusters
                    if core[k]:
                        todo.append(int(k))
        n_clusters += 1
    return label


def classify_crops(crops: DataFrame) -> DataFrame:
    """``match_id, item, team``: 0 and 1 for the two largest density clusters of crops (match_id, item, h, s, v), -1 for the rest.

    Equal colours are one point that counts as often as it occurs, so a match is clustered over its distinct 8-bit colours."""
    colours = crops.groupBy("match_id", "h", "s", "v").agg(F.count("*").alias("n"), F.min("item").alias("first"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        n = pdf["n"].to_numpy()
        label = density_labels(pdf[["h", "s", "v"]].to_numpy(float) * [2, 1, 1], n) if n.sum() >= LEAST_NEAR else np.full(len(pdf), -1)
        size = np.bincount(label[label >= 0], n[label >= 0])
        team = {int(c): t for t, c in enumerate(np.argsort(-size, kind="stable")[:2]) if size[c] >= LEAST_SIZE}
        return pdf[["match_id", "h", "s", "v"]].assign(team=[team.get(int(c), -1) for c in label])

    teams = colours.groupBy("match_id").applyInPandas(fold, "match_id long, h double, s double, v double, team int")
    return crops.join(teams, ["match_id", "h", "s", "v"]).select("match_id", "item", "team")


def two_kits(items: DataFrame, rounds: int = 4) -> DataFrame:
    """``match_id, item, side, split``: two groups of kits (match_id, item, h, s, v) grown from a far pair, and whether they are two kits at all.

    The pair is the kit farthest from the mean and the one farthest from that, found by two passes; the rounds are aggregates, which
    are broadcast while their matches are few, so that a large match stays in its parts. Kits
    are two only if they are far apart, and differ in hue or one of them is pale and the other is not."""
    kit = ("h", "s", "v")
    cols = lambda p="": tuple(F.col(f"{p}{c}") for c in kit)
    rows = items.filter("h is not null and s is not null and v is not null").select("match_id", "item", *kit)

    def farthest(centres: DataFrame, name: str) -> DataFrame:
        d = hsv_distance(cols(), cols("m"))
        best = F.max_by(F.struct(*kit), F.struct(d.alias("d"), (-F.col("item")).alias("i")))
        return rows.join(beside(centres), "match_id").groupBy("match_id").agg(best.alias(name))

    mean = Stage(items.sparkSession).write(rows.groupBy("match_id").agg(*[F.avg(c).alias(f"m{c}") for c in kit]))
    few = mean.count() <= BROADCAST_ROWS
    beside = lambda ends: F.broadcast(ends) if few else ends
    a = farthest(mean, "a")
    b = farthest(a.select("match_id", *[F.col(f"a.{c}").alias(f"m{c}") for c in kit]), "b")
    ends = a.join(b, "match_id").select("match_id", *[F.col(f"{k}.{c}").alias(f"{k}{c}") for k in "ab" for c in kit])
    for _ in range(rounds):
        sided = rows.join(beside(ends), "match_id").withColumn("side", F.when(hsv_distance(cols(), cols("a")) <= hsv_distance(cols(), cols("b")), 0).otherwise(1))
        means = sided.groupBy("match_id").agg(*[F.coalesce(F.avg(F.when(F.col("side") == k, F.col(c))), F.first(f"{p}{c}")).alias(f"{p}{c}") for k, p in enumerate("ab") for c in kit], F.count("*").alias("n"))
        ends = means
    raw = F.abs(F.col("ah") - F.col("bh"))
    hues, pale = F.least(raw, 180 - raw) >= HUES_APART, (F.least("as", "bs") < PALE) & (F.greatest("as", "bs") >= RICH)
    real = (hsv_distance(cols("a"), cols("b")) >= KITS_APART) & (hues | pale)
    return sided.select("match_id", "item", "side").join(beside(ends.select("match_id", (real & (F.col("n") >= 3)).alias("split"))), "match_id")
