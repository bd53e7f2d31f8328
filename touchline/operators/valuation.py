"""Action log to threat points: suppression, exclusion, coefficient lookup, sums and the running chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config
from touchline.functions.columns import minutes
from touchline.operators.intervals import outside

# The class of each action decides which total it adds to.
OFFENSIVE = ("Shot Taken", "Key Pass", "Carry into Box", "Pass into Box", "Cross into Box", "Progression (Pass)", "Goal", "Dispossessed")
DEFENSIVE = ("High Press Win", "Midfield Tackle", "Deep Tackle", "Interception", "Block", "Ball Recovery", "Aerial Duel Won", "Defensive Error", "Foul Committed")
DEFAULT_POSITION = "MF"


def suppressed_shots(actions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Shots that a goal within the window after them consumes.

    Goals consume in log order, each the latest free shot before it. The fold runs inside the JVM over one match's goals and
    shots, which are few; its state is the array of shots consumed so far."""
    log = actions.filter(F.col("action").isin("Shot Taken", "Goal"))
    one = log.groupBy("match_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("action") == "Goal", F.struct("seq", "seconds")))).alias("goals"), F.array_sort(F.collect_list(F.when(F.col("action") == "Shot Taken", F.struct("seconds", (-F.col("seq")).alias("k"))))).alias("shots")
    )
    none = F.array().cast("array<bigint>")

    def take(used, goal):
        free = F.filter("shots", lambda s: (s["seconds"] <= goal["seconds"]) & (goal["seconds"] - s["seconds"] <= cfg.goal_shot_window_sec) & ~F.array_contains(used, -s["k"]))
        best = F.element_at(free, -1)  # the latest, and of equal times the first in the log
        return F.when(F.size(free) > 0, F.concat(used, F.array(-best["k"]))).otherwise(used)

    return one.select("match_id", F.explode(F.aggregate("goals", none, take)).alias("seq"))


def counted(actions: DataFrame, benched: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Actions that count: not suppressed, and not in a bench range (both ends included)."""
    left = actions.join(suppressed_shots(actions, cfg), ["match_id", "seq"], "left_anti")
    return left if benched is None else outside(left, benched, "seconds")


def bench_ranges(blocks: DataFrame, durations: DataFrame) -> DataFrame:
    """Bench blocks given in percent of the match, in seconds."""
    return blocks.join(durations, "match_id").select("match_id", (F.col("start_pct") / 100 * F.col("duration_sec")).alias("start_sec"), (F.col("end_pct") / 100 * F.col("duration_sec")).alias("end_sec"))


def valued(actions: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Adds m, r, h: the coefficients of the position (the default position's if it has none), 0 for an unknown action."""
    known = coeffs.select("position").distinct().withColumn("known", F.lit(True))
    own = actions.join(known, "position", "left").withColumn("position", F.when(F.col("known"), F.col("position")).otherwise(DEFAULT_POSITION)).drop("known")
    wide = coeffs.groupBy("position", "action").agg(*[F.sum(F.when(F.col("model") == m.upper(), F.col("tp")).otherwise(0)).alias(m) for m in "mrh"])
    return own.join(wide, ["position", "action"], "left").fillna(0, ["m", "r", "h"])


def performance(rows: DataFrame) -> DataFrame:
    side = lambda names, c: F.sum(F.when(F.col("action").isin(*names), F.col(c)).otherwise(0))
    tenth = lambda c: (c / 10.0)  # noqa: E731  coefficients are whole tenths of a point, so sums are exact
    return rows.groupBy("match_id").agg(
        tenth(F.sum("h")).alias("net"), tenth(side(OFFENSIVE, "m")).alias("off_m"), tenth(side(OFFENSIVE, "r")).alias("off_r"), tenth(side(DEFENSIVE, "m")).alias("def_m"), tenth(side(DEFENSIVE, "r")).alias("def_r")
    )


def chart(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Running total in log order, with an origin, and an end point at the length of the match (match_id, duration_sec), if that is known."""
    w = Window.partitionBy("match_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.select("match_id", "seq", F.col("seconds").alias("x"), (F.sum("h").over(w) / 10.0).alias("y"))
    ends = rows.groupBy("match_id").agg((F.sum("h") / 10.0).alias("total"))
    origin = ends.select("match_id", F.lit(-1).cast("long").alias("seq"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    last = ends.join(durations, "match_id").filter("duration_sec > 0").select("match_id", F.lit(1 << 62).alias("seq"), F.col("duration_sec").alias("x"), F.col("total").alias("y"))
    return line.unionByName(origin).unionByName(last)


def timeline(actions: DataFrame) -> DataFrame:
    """``match_id, timeline``: the log in order as ``[clock] action`` texts."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "seconds", "action")))
    text = F.transform(ordered, lambda s: F.concat(F.lit("["), minutes(s["seconds"]), F.lit("] "), s["action"]))
    return actions.groupBy("match_id").agg(F.array_join(text, ", ").alias("timeline"))


def relative_labels(coeffs: DataFrame) -> DataFrame:
    """Sign and size class of each coefficient, by the nearest-rank thirds of the absolute values of its model and position."""
    sizes = coeffs.groupBy("model", "position").agg(F.array_sort(F.collect_list(F.abs("tp"))).alias("a"))
    q = lambda p: F.element_at("a", (F.floor(p * (F.size("a") - 1)) + 1).cast("int"))
    size = F.when(F.abs("tp") >= q(0.66), "high").when(F.abs("tp") >= q(0.33), "medium").otherwise("low")
    return coeffs.join(sizes, ["model", "position"]).select("model", "position", "action", F.concat(F.when(F.col("tp") < 0, "-").otherwise("+"), size).alias("label"))
