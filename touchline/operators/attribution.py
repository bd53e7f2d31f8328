"""Which player touched the ball: eligible boxes joined to ball points by frame, ranked by their feet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config
from touchline.functions import columns as X
from touchline.functions.columns import distance, point_box_distance

MY_TEAM, OPPONENT, OFFICIAL, SIDELINE, UNKNOWN = "my_team", "opponent", "official", "sideline", "unknown"
BALL, GOALKEEPER, PLAYER, REFEREE = 0, 1, 2, 3
TOUCHING = (GOALKEEPER, PLAYER)
SIDES = ("x1", "y1", "x2", "y2")


def _sides(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in SIDES)


def best_ball(boxes: DataFrame, ball_class: int = BALL, least: float = 0.0) -> DataFrame:
    """The most confident ball box of each frame, the first of equals."""
    balls = boxes.filter((F.col("class_id") == ball_class) & (F.col("conf") >= least))
    best = F.max_by(F.struct("det_id", "x1", "y1", "x2", "y2", "conf"), F.struct("conf", -F.col("det_id")))
    return balls.groupBy("frame_index").agg(best.alias("b")).select("frame_index", "b.*")


def confident(boxes: DataFrame, least: float, ball_share: float = 0.35) -> DataFrame:
    """Boxes that reach the confidence asked of their class; a ball needs a share of it only."""
    return boxes.filter(F.col("conf") >= F.when(F.col("class_id") == BALL, ball_share * least).otherwise(least))


def looks_like_person(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return boxes.withColumn("is_person", person_shaped(*_sides(), cfg))


def person_shaped(x1: Column, y1: Column, x2: Column, y2: Column, cfg: Config = DEFAULT) -> Column:
    h, w = y2 - y1, F.greatest(x2 - x1, F.lit(1e-6))
    return (h >= cfg.player_min_height_px) & (h / w >= cfg.player_human_min_aspect) & (h / w <= cfg.player_human_max_aspect)


def ball_shaped(x1: Column, y1: Column, x2: Column, y2: Column, soft: Column | bool = False, cfg: Config = DEFAULT) -> Column:
    """Short and not upright; if ``soft``, either is enough."""
    short, flat = y2 - y1 < cfg.player_min_height_px, (y2 - y1) / F.greatest(x2 - x1, F.lit(1e-6)) < cfg.player_min_aspect
    return F.when(soft if isinstance(soft, Column) else F.lit(soft), short | flat).otherwise(short & flat)


def plausible_balls(boxes: DataFrame, ball_class: int = BALL, share: float = 0.45) -> DataFrame:
    """Ball boxes at most ``share`` as wide as the tallest other box of the frame is high; all, where there is no other box."""
    tallest = F.max(F.when(F.col("class_id") != ball_class, F.col("y2") - F.col("y1"))).over(Window.partitionBy("frame_index"))
    return boxes.withColumn("tallest", tallest).filter((F.col("class_id") == ball_class) & (F.col("tallest").isNull() | (F.col("x2") - F.col("x1") <= share * F.col("tallest")))).drop("tallest")


def metric_gate(dist_px: Column, dist_m: Column, cfg: Config = DEFAULT) -> Column:
    """Near in the picture, or near on the pitch, or not measured on the pitch."""
    return (dist_px <= cfg.contact_metric_override_px) | dist_m.isNull() | (dist_m <= cfg.contact_max_player_dist_m)


def off_pitch(scene_grass: Column, feet_grass: Column, cfg: Config = DEFAULT) -> Column:
    """Feet that are surely not on the grass of a scene that shows grass; what isn't measured stays."""
    return F.coalesce((scene_grass >= cfg.scene_min_grass) & (feet_grass < cfg.sideline_min_feet_grass), F.lit(False))


def eligible(points: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Boxes of each ball point's frame that may belong to whoever touched it: of a touching class, shaped like a person and
    not like the ball (softly so, where the box overlaps it), and on the pitch where ``feet_grass`` tells; with distances."""
    kept = ["frame_index", F.col("det_id").alias("player"), *SIDES, "class_id", F.col("conf").alias("p_conf"), *[c for c in ("feet_grass", "dist_m") if c in boxes.columns]]
    near = points.join(boxes.filter(F.col("class_id").isin(*TOUCHING)).select(*kept), "frame_index")
    ball = X.around(F.col("x"), F.col("y"), cfg.contact_ball_proxy_half_px)
    soft = X.iou(_sides(), ball) >= cfg.contact_ball_iou_soft
    fx, fy = X.feet_point(*_sides())
    near = near.filter(~ball_shaped(*_sides(), soft, cfg) & person_shaped(*_sides(), cfg))
    if "feet_grass" in boxes.columns:
        near = near.filter(~off_pitch(F.col("scene_grass") if "scene_grass" in near.columns else F.lit(1.0), F.col("feet_grass"), cfg))
    return near.withColumns({"d_box": point_box_distance(F.col("x"), F.col("y"), *_sides()), "d_feet": distance(F.col("x"), F.col("y"), fx, fy), "area": F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), "height": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))})


def contesting(points: DataFrame, boxes: DataFrame, reach: float, cfg: Config = DEFAULT) -> DataFrame:
    """Eligible players within reach of the ball of their frame, ranked by distance of the feet, then area, then confidence.

    Where ``boxes`` have ``dist_m``, the distance on the pitch decides within the reach."""
    near = eligible(points, boxes, cfg).filter(F.col("d_box") <= reach)
    if "dist_m" in near.columns:
        near = near.filter(metric_gate(F.col("d_box"), F.col("dist_m"), cfg))
    order = Window.partitionBy("frame_index").orderBy("d_feet", "area", F.desc("p_conf"), "player")
    return near.withColumn("place", F.row_number().over(order))


def ambiguity(points: DataFrame, ranked: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per ball point the winner, and whether the runner-up is too near to be sure of it; a point without candidates is not sure."""
    at = lambda k, c: F.max(F.when(F.col("place") == k, c))
    g = ranked.filter("place <= 2").groupBy("frame_index").agg(at(1, F.struct("player", "d_box", "height")).alias("a"), at(2, F.col("d_box")).alias("second"))
    near = F.coalesce(F.col("second") - F.col("a.d_box") < cfg.ambiguous_gap_heights * F.col("a.height"), F.lit(False))
    return points.select("frame_index").join(g, "frame_index", "left").select("frame_index", F.col("a.player").alias("player"), (F.col("a").isNull() | near).alias("ambiguous"))


def crowd(points: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``frame_index, n_near``: eligible players around the ball of each frame, 0 where there is none.

    Where ``boxes`` have ``dist_m``, the distance on the pitch decides within the radius: far from the camera it spans half the pitch."""
    near = eligible(points, boxes, cfg).filter(F.col("d_box") <= cfg.crowd_radius_px)
    if "dist_m" in near.columns:
        near = near.filter(metric_gate(F.col("d_box"), F.col("dist_m"), cfg))
    n = near.groupBy("frame_index").agg(F.count("*").alias("n"))
    return points.select("frame_index").join(n, "frame_index", "left").select("frame_index", F.coalesce("n", F.lit(0)).alias("n_near"))


def crowded_contacts(contacts: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``contact_id, n_near, ambiguous, crowded`` over the sampled frames (contact_id, frame_index) of each contact.

    ``contacts`` are the frames' crowd and ambiguity: the most players on any of them, and doubt on any of them."""
    seen = frames.join(contacts, "frame_index").groupBy("contact_id").agg(F.max("n_near").alias("n_near"), F.bool_or("ambiguous").alias("ambiguous"))
    return seen.withColumn("crowded", (F.col("n_near") >= cfg.crowd_min_players) & F.col("ambiguous"))


def official_kit(kit: tuple[Column, Column, Column], mine: list, other: list, cfg: Config = DEFAULT) -> Column:
    """Dark or neon, and not the colour of either team."""
    h, s, v = kit
    dark, neon = (s < 55) & (v < 100), (s > 110) & (v > 130) & h.between(20, 55)
    near = [X.nearest_colour(kit, refs) <= cfg.team_max_dist for refs in (mine, other) if refs]
    own = near[0] if len(near) == 1 else near[0] | near[1] if near else F.lit(False)
    return F.coalesce((dark | neon) & ~own, F.lit(False))


def classify_team(kits: DataFrame, mine: list[tuple[float, float, float]], other: list[tuple[float, float, float]] = (), cfg: Config = DEFAULT) -> DataFrame:
    """``color_dist``, ``team`` and ``is_mine`` of HSV kits (h, s, v, and class_id if known); an unreadable kit is unknown and never rejected."""
    kit = F.col("h"), F.col("s"), F.col("v")
    d, e = X.nearest_colour(kit, list(mine)), X.nearest_colour(kit, list(other))
    apart, m = F.lit(X.separable(list(mine), list(other), cfg.team_max_dist)), cfg.opponent_margin
    referee = F.coalesce(F.col("class_id") == REFEREE, F.lit(False)) if "class_id" in kits.columns else F.lit(False)
    team = (
        F.when(referee, OFFICIAL)
        .when(d.isNull(), UNKNOWN)
        .when(official_kit(kit, list(mine), list(other), cfg), OFFICIAL)
        .when(apart & (e + m < d), OPPONENT)
        .when(apart & (d + m < e), MY_TEAM)
        .when(d > cfg.other_team_dist, OPPONENT)
        .when(d <= cfg.team_max_dist, MY_TEAM)
        .otherwise(UNKNOWN)
    )
    return kits.withColumns({"color_dist": F.when(~referee, d), "team": team}).withColumn("is_mine", F.when(F.col("team") != UNKNOWN, F.col("team") == MY_TEAM))


def passes_gate(keep_undecided: bool = True, keep_crowded: bool = True) -> Column:
    """Contacts (is_mine, crowded, team) of the own team, undecided ones, and crowded ones of anybody but officials and bystanders."""
    mine = F.coalesce("is_mine", F.lit(keep_undecided))
    if not keep_crowded:
        return mine
    return mine | F.coalesce(F.col("crowded") & ~F.coalesce(F.col("team").isin(OFFICIAL, SIDELINE), F.lit(False)), F.lit(False))


def filter_my_team(contacts: DataFrame, keep_undecided: bool = True, keep_crowded: bool = True, enabled: bool = True) -> DataFrame:
    """The contacts that pass the gate; all, where colours can't tell the teams apart (``enabled`` is false)."""
    return contacts.filter(passes_gate(keep_undecided, keep_crowded)) if enabled else contacts
