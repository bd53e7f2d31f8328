"""Player tracks: association of detections, summaries, lookups by place and time, and repair of broken tracks.

The association depends on order and is folded per match and shot (a track never crosses a cut); everything else is joins and
windows over track points (match_id, track_id, frame_index, t_ms, x, y, height)."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import both_ways, colour_gap, distance, hsv_distance, upper_median
from touchline.operators import clips, colour
from touchline.operators.grouped import fold_groups
from touchline.tables import Stage

# fixed values: metres, metres a second, and milliseconds
HEIGHT_M, SLACK_M, SPEED_M_S, SILENCE_MS = 1.75, 1.2, 11.0, 2000

PART_ROWS = 512  # a group of fewer rows costs more to hand over than to fold


def reach_px(height: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """How far a player of this height in the picture can have come."""
    return (SLACK_M + SPEED_M_S * np.maximum(seconds, 0.0)) * np.maximum(height, 1.0) / HEIGHT_M


def nearest_first(gaps: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of allowed gaps, the smallest first, each row and column once."""
    rows, cols = np.nonzero(allowed)
    out, used_r, used_c = [], set(), set()
    for k in np.lexsort((cols, rows, gaps[rows, cols])):
        r, c = int(rows[k]), int(cols[k])
        if r not in used_r and c not in used_c:
            used_r.add(r)
            used_c.add(c)
            out.append((r, c))
    return out


class Middle:
    """The median colour of those added so far; each channel is kept in order, so one more costs a search and a shift."""

    def __init__(self) -> None:
        self.n, self.channels = 0, ([], [], [])

    def add(self, kit: tuple[float, float, float]) -> None:
        self.n += 1
        for own, value in zip(self.channels, kit):
            insort(own, value)

    def middle(self) -> tuple[float, ...]:
        return tuple((own[(self.n - 1) // 2] + own[self.n // 2]) / 2 for own in self.channels)


def _under_camera(detections: DataFrame, camera: DataFrame) -> DataFrame:
    """Detections with the ``scene`` (shot of the camera) and ``lens`` (map from that scene to this picture) of the camera row nearest to their frame.

    Frames, not detections, look for their row. A match without camera rows has no lens."""
    frames = detections.select("match_id", F.col("frame_index").alias("point_id")).distinct().withColumn("t_ms", F.col("point_id"))
    track = camera.select("match_id", F.col("frame_index").alias("t_ms"), F.col("shot_id").alias("scene"), F.col("matrix").alias("lens"))
    near = clips.as_of_nearest(frames, track, ["scene", "lens"])
    return detections.join(near.select("match_id", F.col("point_id").alias("frame_index"), "scene", "lens"), ["match_id", "frame_index"])


def _carried(anchors: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Where places of the scene (homogeneous) lie in a picture; not a number at or beyond its horizon."""
    q = anchors @ lens.T
    depth = np.where(np.abs(q[:, 2:]) < 1e-9, np.nan, q[:, 2:])
    return q[:, :2] / depth


def _lens(given: object) -> tuple[np.ndarray, np.ndarray]:
    """A map and its inverse; both are not numbers where the picture can't be related to others."""
    m = np.full((3, 3), np.nan) if given is None else np.array(given, float).reshape(3, 3)
    return (m, np.linalg.inv(m)) if np.isfinite(m).all() and abs(np.linalg.det(m)) > 1e-12 else (np.full((3, 3), np.nan),) * 2


def track_players(detections: DataFrame, camera: DataFrame | None = None) -> DataFrame:
    """``match_id, shot_id, frame_index, det_id, track_id`` of boxes (match_id, shot_id, frame_index, det_id, t_ms, x1, y1, x2, y2).

    Live tracks take the detections of each frame, nearest first and within reach; a track that saw nothing for two seconds ends.
    With ``camera`` (match_id, frame_index, shot_id, matrix: from the start of its shot to the picture, as ``clips.compose_steps``
    gives it) a track keeps its place in the scene and is looked for where the camera now shows that place, so a pan moves nobody.
    Nothing links across shots of the camera, nor in frames whose map is missing or has no inverse. Each shot and scene is a group."""
    moving = camera is not None

    def fold(key: tuple, c: dict[str, np.ndarray]) -> tuple:
        size, frames = len(c["frame_index"]), c["frame_index"]
        boxes = np.column_stack([c[k] for k in ("x1", "y1", "x2", "y2")]).astype(float)
        centres = np.column_stack([boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3], np.full(size, 2.0)]) / 2
        heights, at = np.maximum(boxes[:, 3] - boxes[:, 1], 1.0), c["t_ms"].astype(float)
        taken, opens = np.full(size, -1), np.zeros(size, int)
        ids, anchors, times, n = np.zeros(0, int), np.zeros((0, 3)), np.zeros(0), 0
        starts = np.flatnonzero(np.diff(frames, prepend=-1 - abs(frames[0])))
        for a, b in zip(starts, [*starts[1:], size]):
            t, here, own = at[a], centres[a:b], taken[a:b]
            live = t - times <= SILENCE_MS
            ids, anchors, times = ids[live], anchors[live], times[live]
            lens, back = _lens(c["lens"][a]) if moving else (np.eye(3),) * 2
            gaps = np.sqrt(((_carried(anchors, lens)[:, None] - here[None, :, :2]) ** 2).sum(axis=2))
            here = here @ back.T
            for r, k in nearest_first(gaps, gaps <= reach_px(heights[None, a:b], (t - times[:, None]) / 1000)):
                own[k], anchors[r], times[r] = ids[r], here[k], t
            fresh = np.flatnonzero(own < 0)
            own[fresh] = n + np.arange(len(fresh))
            opens[a + fresh] = 1
            n += len(fresh)
            ids, anchors, times = np.concatenate([ids, own[fresh]]), np.concatenate([anchors, here[fresh]]), np.concatenate([times, np.full(len(fresh), t)])
        return *([k] * size for k in key), frames, c["det_id"], taken, opens

    own_key = ("match_id", "shot_id", "scene")
    own = detections.select("match_id", "shot_id", "frame_index", "det_id", "t_ms", "x1", "y1", "x2", "y2")
    own = _under_camera(own, camera).withColumn("scene", F.coalesce("scene", F.lit(-1))) if moving else own.withColumn("scene", F.lit(0).cast("long"))
    own = fold_groups(own, own_key, ("frame_index", "det_id"), fold, "match_id long, shot_id long, scene long, frame_index long, det_id long, track_id long, opens long")
    return _numbered_through(own, "track_id", "shot_id", "scene").drop("scene")


def _numbered_through(rows: DataFrame, number: str, *part: str) -> DataFrame:
    """Numbers that begin at 0 in each part of a match, raised by what the parts before have; ``opens`` is 1 where a number is first used."""
    to_here = F.sum("opens").over(Window.partitionBy("match_id").orderBy(*part))  # with all rows of the same part
    here = F.sum("opens").over(Window.partitionBy("match_id", *part))
    return rows.withColumn(number, F.col(number) + to_here - here).drop("opens")


def summaries(points: DataFrame) -> DataFrame:
    g = points.groupBy("match_id", "track_id").agg(F.count("*").alias("n_points"), F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    return g.select("match_id", "track_id", "n_points", (F.col("a") / 1000.0).alias("start_sec"), (F.col("b") / 1000.0).alias("end_sec"), ((F.col("b") - F.col("a")) / 1000.0).alias("duration_sec"))


def lasting(points: DataFrame, least_points: int = 4, least_sec: float = 0.5) -> DataFrame:
    """Summaries of the tracks that are long enough, numbered anew from 0 in order of their ids."""
    kept = summaries(points).filter((F.col("n_points") >= least_points) & (F.col("duration_sec") >= least_sec))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("match_id").orderBy("track_id")) - 1)


def _near_in_time(asked: DataFrame, points: DataFrame, at: str, within_ms: int) -> DataFrame:
    """For each asked row and track the point nearest to ``at`` within some time (the earlier of equals); met in bins of time."""
    p = points.select("match_id", "track_id", F.col("t_ms").alias("p_ms"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("height").alias("ph"), F.floor(F.col("t_ms") / within_ms).alias("bin"))
    bins = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / within_ms) + d))
    met = asked.withColumn("bin", bins).join(p, ["match_id", "bin"]).filter(F.abs(F.col("p_ms") - F.col(at)) <= within_ms)
    best = F.min_by(F.struct("p_ms", "px", "py", "ph"), F.struct(F.abs(F.col("p_ms") - F.col(at)), F.col("p_ms")))
    return met.groupBy("match_id", "point_id", "track_id").agg(best.alias("p"), *[F.first(c).alias(c) for c in asked.columns if c not in ("match_id", "point_id", "track_id")])


def locate(asked: DataFrame, points: DataFrame, within_m: float = 1.5, within_ms: int = 500) -> DataFrame:
    """``match_id, point_id, track_id`` of asked places (match_id, point_id, t_ms, x, y) that exactly one track passes; doubt gives no row."""
    near = _near_in_time(asked.select("match_id", "point_id", F.col("t_ms").alias("q_ms"), F.col("x").alias("qx"), F.col("y").alias("qy")), points, "q_ms", within_ms)
    hit = near.filter(distance(F.col("qx"), F.col("qy"), F.col("p.px"), F.col("p.py")) <= within_m * F.greatest(F.col("p.ph"), F.lit(1.0)) / HEIGHT_M)
    return hit.groupBy("match_id", "point_id").agg(F.count("*").alias("n"), F.min("track_id").alias("track_id")).filter("n = 1").drop("n")


def carry(asked: DataFrame, points: DataFrame, within_ms: int = 500) -> DataFrame:
    """``match_id, point_id, x, y, t_ms``: where the body that was at an asked place (with ``to_ms``) is at that later time."""
    found = locate(asked, points, within_ms=within_ms).join(asked.select("match_id", "point_id", "to_ms"), ["match_id", "point_id"])
    later = _near_in_time(found.withColumnRenamed("track_id", "own"), points, "to_ms", within_ms).filter("track_id = own")
    return later.select("match_id", "point_id", F.col("p.px").alias("x"), F.col("p.py").alias("y"), F.col("p.p_ms").alias("t_ms"))


def position_at(asked: DataFrame, points: DataFrame, edge_ms: int = 400, most_gap_ms: int | None = None) -> DataFrame:
    """Places of tracks at asked times (match_id, track_id, point_id, t_ms), on the line between the points around them.

    Beyond either end the end holds for less than ``edge_ms``; between points further apart than ``most_gap_ms`` there is no place."""
    q = asked.select("match_id", "track_id", "t_ms", "point_id", F.lit(1).alias("kind"))
    here = F.struct(F.col("t_ms").alias("t"), "x", "y")
    both = q.unionByName(points.select("match_id", "track_id", "t_ms", here.alias("p"), F.lit(0).alias("kind")), allowMissingColumns=True)
    back, ahead = both_ways(("match_id", "track_id"), ("t_ms", "kind"))
    seen = both.withColumns({"a": F.last("p", True).over(back), "b": F.last("p", True).over(ahead)}).filter("kind = 1")
    a, b, t = F.col("a"), F.col("b"), F.col("t_ms")
    share = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    open_ = F.lit(True) if most_gap_ms is None else b["t"] - a["t"] <= most_gap_ms
    at = lambda c: F.when(a["t"] == t, a[c]).when(a.isNull() & (b["t"] - t < edge_ms), b[c]).when(b.isNull() & (t - a["t"] < edge_ms), a[c]).when(a.isNotNull() & b.isNotNull() & open_, a[c] + share * (b[c] - a[c]))
    return seen.select("match_id", "track_id", "point_id", at("x").alias("x"), at("y").alias("y"))


def tap_window(taps: DataFrame, points: DataFrame, window_ms: int = 750, least: int = 3, few: int = 6, most: int = 8) -> DataFrame:
    """``match_id, track_id, point_id, t_ms`` of the points around each tap (match_id, track_id, point_id, tap_ms).

    Those within the window; if fewer than ``least``, the ``few`` nearest; if more than ``most``, that many spread evenly."""
    met = taps.join(points.select("match_id", "track_id", "t_ms"), ["match_id", "track_id"]).withColumn("gap", F.abs(F.col("t_ms") - F.col("tap_ms")))
    own = Window.partitionBy("match_id", "track_id", "point_id")
    met = met.withColumns({"inside": F.count_if(F.col("gap") <= window_ms).over(own), "near": F.row_number().over(own.orderBy("gap", "t_ms"))})
    kept = met.filter(F.when(F.col("inside") < least, F.col("near") <= few).otherwise(F.col("gap") <= window_ms))
    kept = kept.withColumns({"n": F.count("*").over(own), "i": F.row_number().over(own.orderBy("t_ms")) - 1})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * F.col("n") / float(most)).cast("int"))
    return kept.filter((F.col("n") <= most) | F.array_contains(places, F.col("i"))).select("match_id", "track_id", "point_id", "t_ms")


def colour_flips(points: DataFrame, share: float = 0.4, apart: float = 55.0) -> DataFrame:
    """``switched``: whether the upper-median colours (h, s, v) of the first and the last part of a track's points differ clearly."""
    seen = points.filter("h is not null")
    w = Window.partitionBy("match_id", "track_id")
    seen = seen.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("t_ms", "frame_index"))})
    part = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    ends = {"e": F.col("i") <= part, "l": F.col("i") > F.col("n") - part}
    g = seen.groupBy("match_id", "track_id").agg(F.max("n").alias("n"), *[upper_median(F.collect_list(F.when(c, F.col(k)))).alias(f"{e}{k}") for e, c in ends.items() for k in "hsv"])
    d = hsv_distance(tuple(F.col(f"e{k}") for k in "hsv"), tuple(F.col(f"l{k}") for k in "hsv"))
    return g.select("match_id", "track_id", ((F.col("n") >= 4) & (d > apart)).alias("switched"))


def same_player(points: DataFrame, width: float, least_shared: int = 3, share: float = 0.035, apart: float = 60.0) -> DataFrame:
    """``match_id, track_id, other`` of tracks that run side by side: near on the upper median of their shared times, and of like colours.

    Tracks meet at equal times only, so a frame of twenty boxes gives at most 190 pairs."""
    kit = points.groupBy("match_id", "track_id").agg(*[F.median(c).alias(f"k{c}") for c in "hsv"])
    p = points.select("match_id", "t_ms", "track_id", "x", "y")
    q = p.select("match_id", "t_ms", F.col("track_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = p.join(q, ["match_id", "t_ms"]).filter("track_id < other").withColumn("d", distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    g = met.groupBy("match_id", "track_id", "other").agg(F.count("*").alias("n"), upper_median(F.collect_list("d")).alias("d")).filter((F.col("n") >= least_shared) & (F.col("d") <= share * width))
    both = g.join(kit, ["match_id", "track_id"]).join(kit.select("match_id", F.col("track_id").alias("other"), *[F.col(f"k{c}").alias(f"o{c}") for c in "hsv"]), ["match_id", "other"])
    gap = hsv_distance(tuple(F.col(f"k{c}") for c in "hsv"), tuple(F.col(f"o{c}") for c in "hsv"))
    return both.filter(F.coalesce(gap <= apart, F.lit(True))).select("match_id", "track_id", "other")


def merge_parallel(points: DataFrame, width: float, least_shared: int = 3, share: float = 0.035, apart: float = 60.0, stage: Stage | None = None) -> DataFrame:
    """``match_id, track_id, player, t_ms, x, y, kept``: tracks that run side by side as one player, merged until no pair is left.

    ``points`` are (match_id, track_id, t_ms, x, y, h, s, v), one a track and time; h is null where the colour can't be read. A pair
    is judged as in ``same_player``, by the circular median of all its colours. The longer track takes in the other (the first of equal
    ones) with the times that it lacks itself, so its length, places and colour change and pairs are judged again. Each round merges the
    first pair of every match that has one; matches without one are done. Every round is a written table, so a match takes as many
    rounds as it has tracks to merge, some dozen, whatever the number of matches."""
    stage = stage or Stage(points.sparkSession)
    active = stage.write(points.select("match_id", "track_id", F.col("track_id").alias("player"), "t_ms", "x", "y", "h", "s", "v", F.lit(True).alias("kept")))
    done = []
    while True:
        pick = stage.write(_first_pairs(active, share * width, least_shared, apart))
        if pick.isEmpty():
            break
        whole = active
        done.append(stage.write(whole.join(pick.select("match_id"), "match_id", "left_anti")))
        active = stage.write(_absorbed(whole.join(pick, "match_id")))
        stage.free(whole, pick)
    out = active
    for part in done:
        out = out.unionByName(part)
    return out.select("match_id", "track_id", "player", "t_ms", "x", "y", "kept")


def _first_pairs(rows: DataFrame, reach: float, least_shared: int, apart: float) -> DataFrame:
    """``match_id, taker, taken`` of the first pair of each match that is one player."""
    own = ["match_id", "player"]
    kit = colour.representative(rows.filter("h is not null and s is not null and v is not null"), *own)
    p = rows.filter("kept").select(*own, "t_ms", "x", "y")
    size = p.groupBy(*own).agg(F.count("*").alias("n"))
    q = p.select("match_id", "t_ms", F.col("player").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = p.join(q, ["match_id", "t_ms"]).filter("player < other").withColumn("d", distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    pair = Window.partitionBy("match_id", "player", "other")
    middle = met.withColumns({"shared": F.count("*").over(pair), "place": F.row_number().over(pair.orderBy("d")) - 1}).filter(F.col("place") == F.floor(F.col("shared") / 2))  # the upper median, by a sort that can spill
    near = middle.filter((F.col("shared") >= least_shared) & (F.col("d") <= reach)).select(*own, "other")
    as_other = lambda df, **names: df.select("match_id", F.col("player").alias("other"), *[F.col(c).alias(n) for c, n in names.items()])
    both = near.join(size, own).join(as_other(size, n="m"), ["match_id", "other"]).join(kit, own, "left").join(as_other(kit, h="oh", s="os", v="ov"), ["match_id", "other"], "left")
    alike = F.coalesce(hsv_distance(tuple(F.col(c) for c in "hsv"), tuple(F.col(f"o{c}") for c in "hsv")) <= apart, F.lit(True))
    taker, taken = F.when(F.col("n") >= F.col("m"), F.col("player")).otherwise(F.col("other")), F.when(F.col("n") >= F.col("m"), F.col("other")).otherwise(F.col("player"))
    first = both.filter(alike).groupBy("match_id").agg(F.min_by(F.struct(taker.alias("taker"), taken.alias("taken")), F.struct("player", "other")).alias("p"))
    return first.select("match_id", "p.*")


def _absorbed(rows: DataFrame) -> DataFrame:
    """``rows`` (with the pair of their match) after the merge: a time that both have stays with the taker."""
    at = Window.partitionBy("match_id", "t_ms")
    has = F.max(F.col("kept") & (F.col("player") == F.col("taker"))).over(at)
    goes = F.col("player") == F.col("taken")
    merged = rows.withColumns({"kept": F.col("kept") & ~(goes & has), "player": F.when(goes, F.col("taker")).otherwise(F.col("player"))})
    return merged.drop("taker", "taken")


def displacement(frames: DataFrame) -> DataFrame:
    """``pair_id, moved``: the upper median over the players of the first frame of the way to the nearest of the second one.

    ``frames`` are (pair_id, side: a or b, x, y); a pair is two frames of some twenty boxes."""
    a, b = frames.filter("side = 'a'"), frames.filter("side = 'b'").select("pair_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    near = a.join(b, "pair_id").groupBy("pair_id", "x", "y").agg(F.min(distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).alias("d"), F.count("*").alias("k"))
    return near.groupBy("pair_id").agg(upper_median(F.collect_list("d")).alias("moved"))


def chain_broken(tracks: DataFrame, width: float, gap_sec: float = 0.5, share: float = 0.08, apart: float = 60.0) -> DataFrame:
    """``match_id, track_id, chain_id``: tracks that begin where another ended just before are its continuation.

    ``tracks`` are (match_id, track_id, start_sec, end_sec, x0, y0, x1, y1, h, s, v). In order of their starts each takes the nearest
    chain that ended at most ``gap_sec`` before, near enough for that gap and of a like colour. Chains that ended earlier are let go.
    A match is cut where no track is seen for longer than ``gap_sec``, as nothing is chained across; stretches that begin within the
    same ``PART_ROWS`` tracks of a match are folded together, the others by themselves."""
    by_start = Window.partitionBy("match_id").orderBy("start_sec", "track_id")
    so_far = by_start.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(by_start) - 1
    seen_to = F.max("end_sec").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opening = F.when(F.coalesce(F.col("start_sec") - seen_to > gap_sec, F.lit(True)), place)
    columns = ["match_id", "track_id", "start_sec", "end_sec", "x0", "y0", "x1", "y1", "h", "s", "v"]
    parts = tracks.select(*columns, opening.alias("opening")).withColumn("part", F.floor(F.max("opening").over(so_far) / PART_ROWS)).drop("opening")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chains: dict[int, dict] = {}
        out = []
        n = 0
        for r in pdf.sort_values(["start_sec", "track_id"]).itertuples():
            kit = None if pd.isna(r.h) else (r.h, r.s, r.v)
            chains = {k: c for k, c in chains.items() if r.start_sec - c["end"] <= gap_sec}
            fitting = []
            for k, c in chains.items():
                gap, d = r.start_sec - c["end"], math.dist((r.x0, r.y0), c["at"])
                if gap > 0 and d <= share * width * (1 + gap / gap_sec) and (kit is None or c["kits"].n == 0 or colour_gap(kit, c["kits"].middle()) <= apart):
                    fitting.append((d, k))
            k = min(fitting)[1] if fitting else n
            if not fitting:
                chains[k] = {"kits": Middle()}
                n += 1
            if kit:
                chains[k]["kits"].add(kit)
            chains[k] |= {"end": r.end_sec, "at": (r.x1, r.y1)}
            out.append((*key, r.track_id, k, 0 if fitting else 1))
        return pd.DataFrame(out, columns=["match_id", "part", "track_id", "chain_id", "opens"])

    own = parts.groupBy("match_id", "part").applyInPandas(fold, "match_id long, part long, track_id long, chain_id long, opens long")
    return _numbered_through(own, "chain_id", "part").drop("part")


def seed_tracks(detections: DataFrame, width: float, share: float = 0.08, apart: float = 60.0) -> DataFrame:
    """``clip_id, frame_index, det_id, track_id``: in each frame every track in turn takes the nearest detection of its colour.

    ``detections`` are (clip_id, frame_index, det_id, x, y, h, s, v) of clips of some seconds; each clip is folded by itself.
    Of rows with the same frame and ``det_id`` one counts: that with the largest place and colour, unread colours last."""

    def fold(key: tuple, c: dict[str, np.ndarray]) -> tuple:
        frames, dets = c["frame_index"].tolist(), c["det_id"].tolist()
        at = list(zip(c["x"].tolist(), c["y"].tolist()))
        kits = [None if h is None or h != h else (h, s, v) for h, s, v in zip(c["h"].tolist(), c["s"].tolist(), c["v"].tolist())]
        places: list[tuple] = []
        colours: list[Middle] = []
        taken, seen = [-1] * len(dets), []
        a = 0
        while a < len(dets):
            b = a + 1
            while b < len(dets) and frames[b] == frames[a]:
                b += 1
            free = [i for i in range(a, b) if i + 1 == b or dets[i + 1] != dets[i]]
            seen += free
            for k, place in enumerate(places):
                if not free:
                    break
                kit = colours[k].middle() if colours[k].n else None
                like = [(math.dist(at[i], place), i) for i in free if kit is None or kits[i] is None or colour_gap(kits[i], kit) <= apart]
                best = min(like, default=None)
                if best and best[0] <= share * width:
                    i = best[1]
                    free.remove(i)
                    places[k], taken[i] = at[i], k
                    if kits[i]:
                        colours[k].add(kits[i])
            for i in free:
                taken[i] = len(places)
                places.append(at[i])
                colours.append(Middle())
                if kits[i]:
                    colours[-1].add(kits[i])
            a = b
        return [key[0]] * len(seen), *([column[i] for i in seen] for column in (frames, dets, taken))

    rows = detections.select("clip_id", "frame_index", "det_id", "x", "y", "h", "s", "v")
    return fold_groups(rows, ("clip_id",), ("frame_index", "det_id", "x", "y", "h", "s", "v"), fold, "clip_id long, frame_index long, det_id long, track_id long")


def until_loss(steps: DataFrame) -> DataFrame:
    """Steps (match_id, offset, found) of a review track that are reached from offset 0 without a loss in between, on each side."""
    side = F.when(F.col("offset") < 0, -1).otherwise(1)
    w = Window.partitionBy("match_id", side).orderBy(F.abs("offset"))
    lost = F.sum(F.when(F.col("found"), 0).otherwise(1)).over(w)
    return steps.withColumn("lost", lost).filter("lost = 0").drop("lost")
