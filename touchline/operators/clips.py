"""Shots, camera track and clip selection: as-of joins by union and windows, segmentation and even samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import both_ways
from touchline.operators.grouped import fold_groups
from touchline.operators.pitch import inverse, multiply


def cut_shots(stats: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Adds ``cut``: the number of the shot, a new one wherever the histogram distance exceeds the threshold."""
    w = Window.partitionBy("match_id").orderBy("frame_index")
    return stats.withColumn("cut", F.sum(F.when(F.col("hist_d") > threshold, 1).otherwise(0)).over(w))


def label_shots(cut: DataFrame, least_green: float = 0.3, most_graphic: float = 0.5, least_sec: float = 60.0, least_motion: float = 1.2) -> DataFrame:
    """Mean statistics of each shot and its label: discarded, dead time, or main camera."""
    g = cut.groupBy("match_id", "cut").agg(F.avg("green").alias("green"), F.avg("graphic").alias("graphic"), F.coalesce(F.avg("motion"), F.lit(0.0)).alias("motion"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("dur"))
    label = F.when((F.col("green") < least_green) | (F.col("graphic") > most_graphic), "discard").when((F.col("dur") >= least_sec) & (F.col("motion") < least_motion), "deadtime").otherwise("main_camera")
    return g.withColumn("label", label)


def as_of_nearest(points: DataFrame, track: DataFrame, values: list[str]) -> DataFrame:
    """Points (match_id, point_id, t_ms) with the values of the nearest track row in time, the earlier of two as near.

    Both sides are sorted together once per match; nothing is multiplied."""
    held = F.struct(F.col("t_ms").alias("at"), *values)
    both = points.select("match_id", "point_id", "t_ms", F.lit(None).cast(track.select(held.alias("s")).schema["s"].dataType).alias("s"), F.lit(1).alias("kind")).unionByName(
        track.select("match_id", F.lit(None).cast("long").alias("point_id"), "t_ms", held.alias("s"), F.lit(0).alias("kind"))
    )
    back, ahead = both_ways(("match_id",), ("t_ms", "kind"))
    found = both.withColumns({"b": F.last("s", True).over(back), "a": F.last("s", True).over(ahead)}).filter("kind = 1")
    near = F.when(F.col("a").isNull() | (F.col("t_ms") - F.col("b.at") <= F.col("a.at") - F.col("t_ms")), F.col("b")).otherwise(F.col("a"))
    return found.withColumn("n", near).select("match_id", "point_id", "t_ms", F.col("n.at").alias("at_ms"), *[F.col(f"n.{v}").alias(v) for v in values])


def interpolate(points: DataFrame, track: DataFrame, value: str) -> DataFrame:
    """Points with a track value on the line between the rows around them, held at either end."""
    both = points.select("match_id", "point_id", "t_ms", F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")).unionByName(
        track.select("match_id", F.lit(None).cast("long").alias("point_id"), "t_ms", F.col("t_ms").alias("at"), F.col(value).cast("double").alias("v"), F.lit(0).alias("kind"))
    )
    back, ahead = both_ways(("match_id",), ("t_ms", "kind"))
    s = both.withColumns({"t0": F.last("at", True).over(back), "v0": F.last("v", True).over(back), "t1": F.last("at", True).over(ahead), "v1": F.last("v", True).over(ahead)}).filter("kind = 1")
    share = (F.col("t_ms") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    out = F.when(F.col("t1").isNull(), F.col("v0")).when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + share * (F.col("v1") - F.col("v0")))
    return s.select("match_id", "point_id", out.alias(value))


def accumulate(track: DataFrame) -> DataFrame:
    """Cumulated camera offset; an unmeasured step counts as none."""
    w = Window.partitionBy("match_id").orderBy("frame_index")
    return track.withColumns({"cum_dx": F.sum(F.coalesce("dx", F.lit(0.0))).over(w), "cum_dy": F.sum(F.coalesce("dy", F.lit(0.0))).over(w)})


def compose_steps(steps: DataFrame) -> DataFrame:
    """``match_id, shot_id, frame_index, matrix``: the product of the 3x3 steps (``step``, nine numbers) since the shot began; an unmeasured step is none."""

    def fold(key: tuple, c: dict[str, np.ndarray]) -> tuple:
        now, out = np.eye(3), []
        for s in c["step"]:
            now = now if s is None else np.asarray(s, float).reshape(3, 3) @ now
            out.append(now.ravel().tolist())
        return *([k] * len(out) for k in key), c["frame_index"], out

    return fold_groups(steps.select("match_id", "shot_id", "frame_index", "step"), ("match_id", "shot_id"), ("frame_index",), fold, "match_id long, shot_id long, frame_index long, matrix array<double>")


def relative_maps(pairs: DataFrame, track: DataFrame) -> DataFrame:
    """``match_id, pair_id, map`` from the pixels of one frame to those of another (match_id, pair_id, from_frame, to_frame).

    Each frame stands for the nearest one of the track (the earlier of equals); frames of different shots have no map."""
    ends = pairs.select("match_id", (F.col("pair_id") * 2).alias("point_id"), F.col("from_frame").alias("t_ms")).unionByName(pairs.select("match_id", (F.col("pair_id") * 2 + 1).alias("point_id"), F.col("to_frame").alias("t_ms")))
    near = as_of_nearest(ends, track.filter("frame_index >= 0").select("match_id", F.col("frame_index").alias("t_ms"), "shot_id", "matrix"), ["shot_id", "matrix"])
    side = lambda k: F.max(F.when(F.col("point_id") % 2 == k, F.struct("shot_id", "matrix")))
    both = near.groupBy("match_id", F.floor(F.col("point_id") / 2).alias("pair_id")).agg(side(0).alias("a"), side(1).alias("b"))
    same = both.filter("a.shot_id = b.shot_id")
    return same.select("match_id", "pair_id", multiply(F.col("b.matrix"), inverse(F.col("a.matrix"))).alias("map"))


def latest_before(points: DataFrame, track: DataFrame, horizon_ms: int) -> DataFrame:
    """``match_id, point_id, at_ms``: the latest track row at or before each point, if it is recent enough; sorted together, no range join."""
    seen = track.select("match_id", F.lit(None).cast("long").alias("point_id"), "t_ms", F.col("t_ms").alias("at_ms"), F.lit(0).alias("kind"))
    asked = points.select("match_id", "point_id", "t_ms", F.lit(None).cast("long").alias("at_ms"), F.lit(1).alias("kind"))
    w = Window.partitionBy("match_id").orderBy("t_ms", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = seen.unionByName(asked).withColumn("at_ms", F.last("at_ms", True).over(w)).filter((F.col("kind") == 1) & (F.col("at_ms") >= F.col("t_ms") - horizon_ms))
    return out.select("match_id", "point_id", "at_ms")


def dead_time(cut: DataFrame, least_sec: float = 60.0, least_motion: float = 1.2) -> DataFrame:
    """``match_id, cut, dead``: long shots in which next to nothing moves; motion that wasn't measured is none."""
    g = cut.groupBy("match_id", "cut").agg(F.coalesce(F.avg("motion"), F.lit(0.0)).alias("motion"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("dur"))
    return g.select("match_id", "cut", "dur", ((F.col("dur") >= least_sec) & (F.col("motion") < least_motion)).alias("dead"))


def evenly(rows: DataFrame, k: int, order: str) -> DataFrame:
    """At most ``k`` rows of each match, evenly spread from the first to the last (half-even rounding of places)."""
    own = Window.partitionBy("match_id")
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy(order)) - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / F.lit(float(k - 1))).cast("int"))
    return rows.withColumns({"n": n, "i": i}).filter((F.col("n") <= k) | F.array_contains(places, F.col("i"))).drop("n", "i")


def window_frames(points: DataFrame, radius: int, step: int, last: int) -> DataFrame:
    """The frames around each point, clamped to the video."""
    lo, hi = F.greatest(F.lit(0), F.col("frame_index") - radius), F.least(F.lit(last), F.col("frame_index") + radius)
    return points.select("point_id", F.explode(F.sequence(lo, hi, F.lit(step))).alias("frame_index"))


def lcg(seed: Column, n: int) -> Column:
    """The first ``n`` states of a fixed linear congruential generator (fixed values: 9301, 49297, 233280)."""
    start = F.array(seed.cast("long"))
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda a, _: F.concat(a, F.array((F.element_at(a, -1) * 9301 + 49297) % 233280))), 2, n)
