"""Ball trajectory to contact candidates to review windows, with window functions only.

Everything is partitioned by match; sorts are by frame or by time, so the windows of one operator share a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config
from touchline.functions.columns import angle_between, both_ways, distance, listed


def split_tracks(samples: DataFrame) -> DataFrame:
    """Adds ``track_id``: runs of samples with a position; samples without one are dropped."""
    w = Window.partitionBy("match_id").orderBy("frame_index")
    missing = F.when(F.col("x").isNull() | F.col("y").isNull(), 1).otherwise(0)
    return samples.withColumn("track_id", F.sum(missing).over(w)).filter("x is not null and y is not null")


def smooth(nodes: DataFrame) -> DataFrame:
    """Adds ``sx, sy``: mean of a node and its neighbours in its track; tracks of fewer than three nodes stay as they are."""
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_index")
    whole, near = Window.partitionBy("match_id", "track_id"), w.rowsBetween(-1, 1)
    n = F.count("*").over(whole)
    return nodes.withColumns({"sx": F.when(n < 3, F.col("x")).otherwise(F.avg("x").over(near)), "sy": F.when(n < 3, F.col("y")).otherwise(F.avg("y").over(near))})


def kinematics(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Speeds and heading change at the inner detected nodes of each track, with the kinds of contact they look like."""
    nodes = smooth(split_tracks(samples).filter("detected"))
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_index")
    for c in ("t_ms", "sx", "sy"):
        nodes = nodes.withColumn(f"p_{c}", F.lag(c).over(w)).withColumn(f"n_{c}", F.lead(c).over(w))
    dt_in, dt_out = (F.col("t_ms") - F.col("p_t_ms")) / 1000.0, (F.col("n_t_ms") - F.col("t_ms")) / 1000.0
    inner = nodes.withColumns({"dt_in": dt_in, "dt_out": dt_out}).filter("dt_in > 0 and dt_out > 0")
    v = {"vx_in": (F.col("sx") - F.col("p_sx")) / F.col("dt_in"), "vy_in": (F.col("sy") - F.col("p_sy")) / F.col("dt_in")}
    v |= {"vx_out": (F.col("n_sx") - F.col("sx")) / F.col("dt_out"), "vy_out": (F.col("n_sy") - F.col("sy")) / F.col("dt_out")}
    moved = inner.withColumns(v)
    zero = F.lit(0.0)
    moved = moved.withColumns(
        {
            "speed_before": distance(F.col("vx_in"), F.col("vy_in"), zero, zero),
            "speed_after": distance(F.col("vx_out"), F.col("vy_out"), zero, zero),
            "angle_deg": angle_between(F.col("vx_in"), F.col("vy_in"), F.col("vx_out"), F.col("vy_out")),
        }
    )
    before, after, angle, floor = F.col("speed_before"), F.col("speed_after"), F.col("angle_deg"), cfg.contact_min_speed_px_s
    turn = (angle >= cfg.contact_dir_change_deg) & (F.least(before, after) >= floor)
    stop = (before >= floor) & (after <= before * cfg.contact_stop_ratio)
    kick = (after >= floor) & (after >= before * cfg.contact_speed_spike_ratio)
    score = lambda c, v: F.when(c, F.least(F.lit(1.0), v)).otherwise(0.0)
    tiny = F.lit(1e-6)
    strength = F.greatest(score(turn, angle / 180.0), score(stop, 1 - after / F.greatest(before, tiny)), score(kick, 1 - before / F.greatest(after, tiny)))
    gap = F.greatest("dt_in", "dt_out") > cfg.contact_gap_sec
    return moved.withColumns({"kinds": listed((turn, "direction_change"), (stop, "stop"), (kick, "kick")), "from_gap": gap}).withColumn("strength", F.when(gap, strength * 0.5).otherwise(strength))


def candidates(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Nodes that look like contacts; samples with shots also get ``clock_ms``, the time of play (the gaps between shots taken out)."""
    found = kinematics(samples, cfg).filter("size(kinds) > 0")
    if "shot_id" not in samples.columns:
        return found
    return found.join(shot_shifts(samples), ["match_id", "shot_id"]).withColumn("clock_ms", F.col("t_ms") + F.col("shift_ms")).drop("shift_ms")


def clock(found: DataFrame) -> str:
    """The time that merging and budgets go by: that of play, where it is known."""
    return "clock_ms" if "clock_ms" in found.columns else "t_ms"


def merge_contacts(found: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates at most ``contact_merge_sec`` of play apart are one contact: the strongest stands for it, with all their kinds."""
    at = clock(found)
    w = Window.partitionBy("match_id").orderBy(at, "frame_index")
    opens = F.when(F.col(at) - F.lag(at).over(w) <= int(cfg.contact_merge_sec * 1000), 0).otherwise(1)
    groups = found.withColumn("opens", opens).withColumn("contact_id", F.sum("opens").over(w))
    best = F.max_by(F.struct("frame_index", *dict.fromkeys(("t_ms", at)), "x", "y", "strength"), F.struct("strength", -F.col("frame_index")))
    kinds = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "kinds"))), lambda s: s["kinds"])))
    out = groups.groupBy("match_id", "contact_id").agg(best.alias("r"), kinds.alias("kinds"), F.bool_or("from_gap").alias("from_gap"), F.count("*").alias("n_merged"))
    return out.select("match_id", "contact_id", "r.*", "kinds", "from_gap", "n_merged")


def fair_cap(found: DataFrame, limit: int | str, cfg: Config = DEFAULT) -> DataFrame:
    """At most ``limit`` (a number, or a column of the match) contacts of a match, taken round by round: the strongest of every bucket of the time of play first."""
    bucket = F.floor(F.col(clock(found)) / int(cfg.candidate_fair_window_sec * 1000))
    ranked = found.withColumn("bucket", bucket).withColumn("round", F.row_number().over(Window.partitionBy("match_id", "bucket").orderBy(F.desc("strength"), "t_ms", "frame_index")))
    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy("match_id").orderBy("round", "bucket"))).filter(F.col("pick") <= most)


def cap_candidates(found: DataFrame, durations: DataFrame, cfg: Config = DEFAULT, least: int = 60) -> DataFrame:
    """Contacts within the budget of their match: so many a minute of its ``duration_sec``, ``least`` at least, and never more than ``max_candidates``.

    Where the duration is unknown or zero, ``max_candidates`` alone counts."""
    scaled = F.when(F.col("duration_sec") > 0, F.greatest(F.lit(least), F.floor(cfg.max_candidates_per_min * F.col("duration_sec") / 60.0)))
    known = found.join(durations.select("match_id", "duration_sec"), "match_id", "left")
    return fair_cap(known.withColumn("budget", F.least(F.lit(cfg.max_candidates), scaled).cast("int")).drop("duration_sec"), "budget", cfg)


def touch_windows(contacts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Padded windows around contacts, merged where the gap between windows is small: ends ``a`` and ``b`` in milliseconds."""
    before, after, merge = (int(1000 * v) for v in (cfg.hotspot_pad_before_sec, cfg.hotspot_pad_after_sec, cfg.hotspot_gap_merge_sec))
    w = Window.partitionBy("match_id").orderBy("t_ms", "frame_index")
    joined = F.col("t_ms") - before - (F.lag("t_ms").over(w) + after) <= merge
    zones = contacts.withColumn("opens", F.when(joined, 0).otherwise(1)).withColumn("hotspot_id", F.sum("opens").over(w))
    times = F.array_sort(F.collect_list("t_ms")).alias("contact_ms")
    return zones.groupBy("match_id", "hotspot_id").agg((F.min("t_ms") - before).alias("a"), (F.max("t_ms") + after).alias("b"), F.count("*").alias("n_contacts"), F.max("t_ms").alias("last_ms"), times)


def run_on(windows: DataFrame, samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Windows that last until the ball first leaves the place it had at the last contact, if it does so in time.

    The samples are matched by match and by bins as long as the reach, so a window meets two bins and no product of rows arises."""
    reach = int(cfg.possession_max_extend_sec * 1000)
    bins = windows.select("match_id", "hotspot_id", "last_ms").withColumn("bin", F.explode(F.array(F.floor(F.col("last_ms") / reach), F.floor(F.col("last_ms") / reach) + 1)))
    seen = samples.filter("x is not null and y is not null").select("match_id", F.col("t_ms").alias("s_ms"), "frame_index", "x", "y", F.floor(F.col("t_ms") / reach).alias("bin"))
    near = bins.join(seen, ["match_id", "bin"]).filter((F.col("s_ms") >= F.col("last_ms")) & (F.col("s_ms") <= F.col("last_ms") + reach))
    w = Window.partitionBy("match_id", "hotspot_id").orderBy("s_ms", "frame_index")
    origin = near.withColumn("o", F.first(F.struct("x", "y")).over(w))
    gone = F.min(F.when(distance(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y")) > cfg.possession_leave_px, F.col("s_ms")))
    left = origin.groupBy("match_id", "hotspot_id").agg((gone + int(cfg.hotspot_pad_after_sec * 1000)).alias("gone"))
    return windows.join(left, ["match_id", "hotspot_id"], "left").withColumn("b", F.greatest("b", F.coalesce("gone", "b"))).drop("gone")


def finished(windows: DataFrame, durations: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Windows in seconds, grown evenly to a least length and clamped to the video."""
    lack = F.greatest(F.lit(0.0), (cfg.hotspot_min_zone_sec * 1000 - (F.col("b") - F.col("a"))) / 2.0)
    out = windows.select("match_id", "hotspot_id", (F.greatest(F.lit(0.0), F.col("a") - lack) / 1000.0).alias("start_sec"), ((F.col("b") + lack) / 1000.0).alias("end_sec"), "n_contacts", "last_ms", "contact_ms")
    if durations is None:
        return out
    return out.join(durations.select("match_id", "duration_sec"), "match_id", "left").withColumn("end_sec", F.least("end_sec", F.coalesce("duration_sec", "end_sec"))).drop("duration_sec")


def hotspots(contacts: DataFrame, cfg: Config = DEFAULT, samples: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Review windows around contacts; with ``samples`` of the ball each runs on until the ball leaves."""
    windows = touch_windows(contacts, cfg)
    return finished(windows if samples is None else run_on(windows, samples, cfg), durations, cfg)


def first_hotspots(zones: DataFrame, most: int = 10) -> DataFrame:
    """Adds ``place``: the first windows of each match, as its summary lists them."""
    w = Window.partitionBy("match_id").orderBy("start_sec", "hotspot_id")
    return zones.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def segments(zones: DataFrame) -> DataFrame:
    """Windows in the shape of the workspace: the window as core, the contact times (or its middle) as ticks."""
    ticks = F.transform("contact_ms", lambda t: t / 1000.0)
    middle = F.array((F.col("start_sec") + F.col("end_sec")) / 2)
    return zones.select("match_id", "hotspot_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.col("start_sec").alias("core_start"), F.col("end_sec").alias("core_end"), F.when(F.size(ticks) > 0, ticks).otherwise(middle).alias("ticks"))


def reject_alternation(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``rejected``: detections in a sustained run of out-and-back steps, one on either side included."""
    seen = samples.filter("detected and x is not null and y is not null")
    w = Window.partitionBy("match_id").orderBy("frame_index")
    for c in ("x", "y", "t_ms"):
        seen = seen.withColumn(f"p_{c}", F.lag(c).over(w)).withColumn(f"n_{c}", F.lead(c).over(w))
    out = distance(F.col("x"), F.col("y"), F.col("p_x"), F.col("p_y"))
    turn = angle_between(F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y"), F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y"), 1e-6)
    back = distance(F.col("n_x"), F.col("n_y"), F.col("p_x"), F.col("p_y"))
    gap = int(cfg.pingpong_max_gap_sec * 1000)
    bad = (F.col("t_ms") - F.col("p_t_ms") <= gap) & (F.col("n_t_ms") - F.col("t_ms") <= gap) & (out >= cfg.pingpong_min_step_px) & (turn >= cfg.pingpong_min_turn_deg) & (back <= cfg.pingpong_return_frac * out)
    runs = seen.withColumn("bad", F.coalesce(bad, F.lit(False))).withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    long = F.sum(F.when(F.col("bad"), 1).otherwise(0)).over(Window.partitionBy("match_id", "run")) >= cfg.pingpong_min_alternations
    marked = runs.withColumn("hit", F.col("bad") & long)
    hit = F.col("hit") | F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False))
    return marked.select("match_id", "frame_index", hit.alias("rejected"))


def without_rejected(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Samples whose alternating detections (``reject_alternation``) have become misses: rows without a position."""
    marked = samples.join(reject_alternation(samples, cfg).filter("rejected"), ["match_id", "frame_index"], "left")
    gone = F.coalesce(F.col("rejected"), F.lit(False))
    return marked.withColumns({"x": F.when(~gone, F.col("x")), "y": F.when(~gone, F.col("y")), "detected": F.col("detected") & ~gone}).drop("rejected")


def hold_positions(samples: DataFrame) -> DataFrame:
    """``hx, hy``: held positions between two detections on the line between them, all others as they are.

    Held samples are interpolated ones with a position; a run of them counts only where a detection stands directly on both sides in
    the same shot. A hold that ends otherwise has nothing to go by and keeps its place."""
    back, ahead = both_ways(("match_id", "shot_id"), ("frame_index",), own=False)
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    held = F.col("interpolated") & ~F.col("detected") & placed
    edge = F.when(~held, F.struct("t_ms", "x", "y", (F.col("detected") & placed).alias("seen")))
    both = samples.withColumns({"held": held, "before": F.last(edge, True).over(back), "after": F.last(edge, True).over(ahead)})
    span = F.col("after.t_ms") - F.col("before.t_ms")
    share = (F.col("t_ms") - F.col("before.t_ms")) / span
    moved = F.col("held") & F.coalesce(F.col("before.seen") & F.col("after.seen") & (span > 0), F.lit(False))
    lerp = lambda c: F.when(moved, F.col(f"before.{c}") + share * (F.col(f"after.{c}") - F.col(f"before.{c}"))).otherwise(F.col(c))
    return both.select("match_id", "frame_index", lerp("x").alias("hx"), lerp("y").alias("hy"))


def shot_shifts(samples: DataFrame) -> DataFrame:
    """``match_id, shot_id, shift_ms``: what to add to a time in a shot to get that of play, in which shots follow each other directly."""
    shots = samples.groupBy("match_id", "shot_id").agg(F.min("t_ms").alias("first_ms"), (F.max("t_ms") - F.min("t_ms")).alias("span"))
    w = Window.partitionBy("match_id").orderBy("shot_id").rowsBetween(Window.unboundedPreceding, -1)
    return shots.select("match_id", "shot_id", (F.coalesce(F.sum("span").over(w), F.lit(0)) - F.col("first_ms")).alias("shift_ms"))


def processed_clock(samples: DataFrame) -> DataFrame:
    """Time with the gaps between shots taken out: the spans of earlier shots plus the time since this one began."""
    return samples.join(shot_shifts(samples), ["match_id", "shot_id"]).select("match_id", "frame_index", ((F.col("t_ms") + F.col("shift_ms")) / 1000.0).alias("processed_sec"))


def summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("match_id").agg(
        F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), F.count_if("interpolated").alias("n_interpolated"), F.count_if(F.col("x").isNull()).alias("n_missing"), F.avg(F.col("detected").cast("double")).alias("detected_ratio")
    )
