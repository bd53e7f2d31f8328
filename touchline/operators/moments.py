"""Moments for seed clips: where to look, how good a scene is, and which moment to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import both_ways

# fixed values
SLOTS, GOLDEN, BAND = (0.10, 0.35, 0.60, 0.85), 0.6180339887498949, (0.03, 0.95)
ZOOM_HEIGHT, LEAST_GRASS, STILL_PX, CUT, LEAST_PLAYERS = 0.35, 0.12, 6.0, 0.4, 6
PENALTIES = {"is_zoom": 6.0, "no_kit": 3.0, "is_crowd": 8.0, "is_static": 5.0, "is_cut": 5.0}
SEPARATION_SEC, COLLISION, EMPTY = 8.0, 1e6, -1e9


def slot_fraction(slot: Column, reroll: Column) -> Column:
    """The share of the playing time at which a slot looks: fixed places first, then golden-ratio hops into the usable band."""
    place = F.element_at(F.array(*map(F.lit, SLOTS)), F.greatest(F.lit(0), F.least(F.lit(len(SLOTS) - 1), slot)) + 1)
    hop = F.pmod(place + reroll * GOLDEN, F.lit(1.0))
    return F.when(reroll <= 0, F.least(F.lit(BAND[1]), F.greatest(F.lit(BAND[0]), place))).otherwise(BAND[0] + hop * (BAND[1] - BAND[0]))


def slot_moments(videos: DataFrame, n: int = len(SLOTS)) -> DataFrame:
    """``match_id, slot, t_sec`` of videos (match_id, duration_sec, reroll)."""
    slots = videos.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return slots.select("match_id", "slot", F.when(F.col("duration_sec") > 0, F.floor(slot_fraction(F.col("slot"), F.col("reroll")) * F.col("duration_sec") * 100 + 0.5) / 100).otherwise(0.0).alias("t_sec"))


def offsets_outward(radius: Column, step: float = 5.0) -> Column:
    """0, +step, -step, +2 step, ... up to the radius, as an array."""
    n = F.floor((radius + 1e-6) / step).cast("int")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(k * step, -k * step)))
    return F.when(n >= 1, F.concat(F.array(F.lit(0.0)), sides)).otherwise(F.array(F.lit(0.0)))


def scene_flags(moments: DataFrame) -> DataFrame:
    """Adds the flags and the score of moments (n_players, median_height_share, kit_visible, grass, moved, cut_distance).

    Without players a moment is empty; with fewer than a clip needs only zoom and kit are looked at."""
    n = F.col("n_players")
    looked = n >= LEAST_PLAYERS
    flags = {
        "is_zoom": (n == 0) | (F.col("median_height_share") > ZOOM_HEIGHT),
        "no_kit": (n == 0) | ~F.coalesce("kit_visible", F.lit(True)),
        "is_crowd": (n == 0) | (looked & (F.col("grass") < LEAST_GRASS)),
        "is_static": (n == 0) | (looked & F.coalesce(F.col("moved") < STILL_PX, F.lit(False))),
        "is_cut": looked & F.coalesce(F.col("cut_distance") > CUT, F.lit(False)),
    }
    flagged = moments.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    lost = sum((F.when(F.col(k), p).otherwise(0.0) for k, p in PENALTIES.items()), F.lit(0.0))
    return flagged.withColumn("score", F.when(n == 0, EMPTY).otherwise(n - lost))


def qualifies(least_players: int = LEAST_PLAYERS) -> Column:
    return (F.col("n_players") >= least_players) & ~F.col("is_zoom") & ~F.col("is_crowd") & ~F.col("is_static") & ~F.col("is_cut")


def pick_moments(candidates: DataFrame) -> DataFrame:
    """``match_id, slot, t_sec`` for each slot: the first qualifying moment outward that is far from those to avoid, else the best one.

    ``candidates`` are flagged moments (match_id, slot, place: order outward, t_sec, near_others)."""
    good = qualifies() & ~F.col("near_others")
    value = F.col("score") - F.when(F.col("near_others"), COLLISION).otherwise(0.0)
    g = candidates.groupBy("match_id", "slot").agg(F.min_by(F.when(good, F.col("t_sec")), F.when(good, F.col("place"))).alias("first"), F.max_by("t_sec", F.struct(value.alias("v"), (-F.col("place")).alias("p"))).alias("best"))
    return g.select("match_id", "slot", (F.floor(F.coalesce("first", "best") * 100 + 0.5) / 100).alias("t_sec"))


def shuffle_history(shown: DataFrame, within: float = SEPARATION_SEC, most: int = 20) -> DataFrame:
    """``match_id, slot, history`` after moments (match_id, slot, seq, t_sec): one near to those shown starts anew, others are added.

    A slot is shuffled some dozen times, so this is a fold inside the JVM."""
    g = shown.groupBy("match_id", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t_sec"))), lambda s: s["t_sec"]).alias("ts"))

    def add(h: Column, t: Column) -> Column:
        more = F.concat(h, F.array(t))
        return F.when(F.exists(h, lambda x: F.abs(x - t) < within), F.array(t)).otherwise(F.slice(more, F.greatest(F.lit(1), F.size(more) - most + 1), F.lit(most)))

    return g.select("match_id", "slot", F.aggregate("ts", F.array().cast("array<double>"), add).alias("history"))


def spread(clips: DataFrame, n: int) -> DataFrame:
    """``clip_id, t_sec``: n times spread over the middle of clips (clip_id, start_sec, end_sec)."""
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * (k + 0.5) / n)
    return clips.select("clip_id", F.explode(times).alias("t_sec"))


def nearby(candidates: DataFrame, avoid: DataFrame, within: float = SEPARATION_SEC) -> DataFrame:
    """Adds ``near_others``: whether a moment to avoid (match_id, t_sec) lies within some seconds; one sorted union per match."""
    both = candidates.withColumn("__c", F.lit(1)).unionByName(avoid.select("match_id", "t_sec", F.col("t_sec").alias("__a"), F.lit(0).alias("__c")), allowMissingColumns=True)
    back, ahead = (F.last("__a", True).over(w) for w in both_ways(("match_id",), ("t_sec", "__c")))
    near = F.coalesce(F.col("t_sec") - back < within, F.lit(False)) | F.coalesce(ahead - F.col("t_sec") < within, F.lit(False))
    return both.withColumn("near_others", near).filter("__c = 1").drop("__c", "__a")
