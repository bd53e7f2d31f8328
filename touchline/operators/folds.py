"""Clusters and suppression that depend on an order of their items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import iou
from touchline.tables import Stage

BROADCAST_ROWS = 10_000  # of means, a vector a match; more are joined by shuffle


def greedy_clusters(points: DataFrame, radius: float) -> DataFrame:
    """``match_id, item, cluster``: each item in order joins the nearest running mean within the radius or opens a new one."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, out = [], []
        means = np.zeros((16, len(pdf.vector.iloc[0])))
        pdf = pdf.sort_values("item")
        for v in pdf.vector:
            v = np.asarray(v, float)
            d = np.sqrt(((means[: len(sizes)] - v) ** 2).sum(axis=1))
            best = int(np.argmin(d)) if sizes else -1
            if best < 0 or d[best] > radius:
                best = len(sizes)
                if best == len(means):
                    means = np.concatenate([means, np.zeros_like(means)])
                means[best] = v
                sizes.append(1)
            else:
                sizes[best] += 1
                means[best] += (v - means[best]) / sizes[best]
            out.append(best)
        return pd.DataFrame({"match_id": key[0], "item": pdf["item"].to_numpy(), "cluster": out})

    return points.groupBy("match_id").applyInPandas(fold, "match_id long, item long, cluster int")


def suppress_overlaps(boxes: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """``frame_index, det_id`` that survive: in order of confidence, a box goes if it overlaps a kept one of its class.

    A frame has few boxes, so this is a fold inside the JVM."""
    sides = ("x1", "y1", "x2", "y2")
    row = F.struct(F.negate("conf").alias("order"), "det_id", "class_id", *sides)
    ordered = boxes.groupBy("frame_index").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.filter("rows", lambda r: F.lit(False))

    def take(kept, r):
        box = tuple(r[c] for c in sides)
        hit = F.exists(kept, lambda k: (k["class_id"] == r["class_id"]) & (iou(tuple(k[c] for c in sides), box) > least_iou))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(r)))

    return ordered.select("frame_index", F.explode(F.aggregate("rows", none, take)).alias("r")).select("frame_index", F.col("r.det_id").alias("det_id"))


def _apart(a: str, b: str):
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def two_means(points: DataFrame, rounds: int = 4) -> DataFrame:
    """``match_id, item, side``: two groups grown from a far pair, after a fixed number of rounds.

    The pair is the vector farthest from the mean and the one farthest from that. Means and farthest vectors are aggregates, which
    are broadcast while their matches are few: a match of any size is spread over tasks, and no vector is sent to its match."""
    rows = points.select("match_id", "item", F.col("vector").cast("array<double>").alias("vector"))
    mean_of = lambda c: vector_to_array(Summarizer.mean(array_to_vector(c)))

    def farthest(frm: DataFrame, name: str) -> DataFrame:
        far = rows.join(beside(frm), "match_id").withColumn("d", _apart("vector", "m"))
        return far.groupBy("match_id").agg(F.max_by("vector", F.struct("d", -F.col("item"))).alias(name))

    mean = Stage(points.sparkSession).write(rows.groupBy("match_id").agg(mean_of(F.col("vector")).alias("m")))
    few = mean.count() <= BROADCAST_ROWS
    beside = lambda ends: F.broadcast(ends) if few else ends
    a = farthest(mean, "a")
    ends = a.join(farthest(a.withColumnRenamed("a", "m"), "b"), "match_id")
    for _ in range(rounds):
        sided = rows.join(beside(ends), "match_id").withColumn("side", (_apart("vector", "b") < _apart("vector", "a")).cast("int"))
        means = sided.groupBy("match_id", "side").agg(mean_of(F.col("vector")).alias("m")).groupBy("match_id").agg(*[F.max(F.when(F.col("side") == k, F.col("m"))).alias(n) for k, n in enumerate(("na", "nb"))])
        ends = ends.join(means, "match_id").select("match_id", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
    return sided.select("match_id", "item", "side")


def most_confident(boxes: DataFrame, most: int = 300) -> DataFrame:
    """At most so many boxes of each frame, the most confident first."""
    return boxes.withColumn("__k", F.row_number().over(Window.partitionBy("frame_index").orderBy(F.desc("conf"), "det_id"))).filter(F.col("__k") <= most).drop("__k")
