"""Interval algebra per match.

Points meet ranges in one sorted union per match, so nothing is multiplied; ranges meet ranges in bins of time. A match
without ranges is unrestricted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config
from touchline.functions.columns import both_ways, rounded

BIN_SEC = 60.0  # ranges are met in bins of this length


def normalize(ranges: DataFrame, duration: float | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Ends swapped into order, clamped, empty ones dropped, rounded to 3 places, and those that touch within ``range_merge_sec`` merged."""
    a, b = F.greatest(F.lit(0.0), F.least("start_sec", "end_sec")), F.greatest("start_sec", "end_sec")
    if duration:
        a, b = F.least(a, F.lit(duration)), F.least(b, F.lit(duration))
    nan = F.isnan("start_sec") | F.isnan("end_sec") | F.col("start_sec").isNull() | F.col("end_sec").isNull()
    clean = ranges.filter(~nan).select("match_id", a.alias("a"), b.alias("b")).filter("b > a").select("match_id", rounded(F.col("a"), 3).alias("a"), rounded(F.col("b"), 3).alias("b"))
    w = Window.partitionBy("match_id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("opens", F.when(F.col("a") <= reach + cfg.range_merge_sec, 0).otherwise(1))
    groups = marked.withColumn("g", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy("match_id", "g").agg(F.min("a").alias("start_sec"), F.max("b").alias("end_sec")).drop("g")


def pad(ranges: DataFrame, seconds: float, cfg: Config = DEFAULT) -> DataFrame:
    return normalize(ranges.select("match_id", F.greatest(F.lit(0.0), F.col("start_sec") - seconds).alias("start_sec"), (F.col("end_sec") + seconds).alias("end_sec")), cfg=cfg)


def totals(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("match_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))).alias("total_sec"), F.min("start_sec").alias("envelope_start"), F.max("end_sec").alias("envelope_end"), F.count("*").alias("n_ranges"))


def whole_match(ranges: DataFrame, duration: float, tolerance: float = 1.0) -> DataFrame:
    """``match_id, whole``: one range that reaches both ends of the video within the tolerance."""
    g = ranges.groupBy("match_id").agg(F.count("*").alias("n"), F.min("start_sec").alias("a"), F.max("end_sec").alias("b"))
    return g.select("match_id", ((F.col("n") == 1) & (F.col("a") <= tolerance) & (F.col("b") >= duration - tolerance)).alias("whole"))


def _beside(points: DataFrame, ranges: DataFrame, at: str, *extra: str):
    """Points and ranges of a match sorted together: the points as rows, and windows that look back and ahead over the ranges."""
    r = ranges.select("match_id", F.struct(F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), *extra).alias("__r"), F.col("start_sec").cast("double").alias("__at"))
    both = points.withColumn("__at", F.col(at).cast("double")).withColumn("__p", F.lit(1)).unionByName(r.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    return both, *both_ways(("match_id",), ("__at", "__p"))


def _flagged(points: DataFrame, ranges: DataFrame, at: str) -> DataFrame:
    """Points with ``__in``: whether some range of their match holds them, null where the match has none."""
    both, back, _ = _beside(points, ranges, at)
    reach, any_range = F.max(F.col("__r.b")).over(back), F.max(F.col("__r.b").isNotNull()).over(Window.partitionBy("match_id"))
    held = F.when(any_range, F.coalesce(reach >= F.col("__at"), F.lit(False)))
    return both.withColumn("__in", held).filter("__p = 1").select(*points.columns, "__in")


def inside(points: DataFrame, ranges: DataFrame, at: str = "t_sec") -> DataFrame:
    """Points within a range of their match, both ends included; a match without ranges is unrestricted."""
    return _flagged(points, ranges, at).filter(F.coalesce("__in", F.lit(True))).drop("__in")


def outside(points: DataFrame, ranges: DataFrame, at: str = "t_sec") -> DataFrame:
    """Points in no range of their match."""
    return _flagged(points, ranges, at).filter(~F.coalesce("__in", F.lit(False))).drop("__in")


def _bins(a: Column, b: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))


def intersect(pieces: DataFrame, ranges: DataFrame, width: float = BIN_SEC) -> DataFrame:
    """Each piece cut to each range of its match, ends rounded to 3 places; other columns are carried along.

    Pieces and ranges meet in bins of ``width`` seconds; a pair is taken in the bin where its common part begins. Pieces of a
    match without ranges stay as they are."""
    r = ranges.select("match_id", F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b")).filter("__b > __a").withColumn("__bin", _bins(F.col("__a"), F.col("__b"), width))
    p = pieces.filter("end_sec > start_sec").withColumn("__bin", _bins(F.col("start_sec"), F.col("end_sec"), width))
    both = p.join(r, ["match_id", "__bin"]).withColumns({"__s": F.greatest("start_sec", "__a"), "__e": F.least("end_sec", "__b")})
    cut = both.filter((F.col("__e") > F.col("__s")) & (F.floor(F.col("__s") / width) == F.col("__bin"))).withColumns({"start_sec": rounded(F.col("__s"), 3), "end_sec": rounded(F.col("__e"), 3)})
    free = pieces.join(ranges.select("match_id").distinct(), "match_id", "left_anti")
    return cut.select(*pieces.columns).unionByName(free)


def clamp(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each time moved to the nearest place in the ranges of its match (the earlier range if two are as near); ranges are disjoint."""
    both, back, ahead = _beside(points.select("match_id", "point_id", "t_sec"), ranges, "t_sec")
    seen = both.withColumns({"__before": F.last("__r", True).over(back), "__after": F.last("__r", True).over(ahead)}).filter("__p = 1")
    t, low, high = F.col("t_sec"), F.when(F.col("__before").isNotNull(), F.least(F.col("t_sec"), F.col("__before.b"))), F.col("__after.a")
    near = F.when(high.isNull() | (low.isNotNull() & (t - low <= high - t)), low).otherwise(high)
    moved = F.when(near == t, t).otherwise(rounded(near, 3))
    return seen.select("match_id", "point_id", F.coalesce(F.when(F.col("__before").isNotNull() | F.col("__after").isNotNull(), moved), t).alias("t_sec"))


def time_at_fraction(ranges: DataFrame, fraction: float) -> DataFrame:
    """The time at a share of the total length of the ranges, counted over the ranges one after another."""
    w = Window.partitionBy("match_id").orderBy("start_sec", "end_sec")
    span = F.col("end_sec") - F.col("start_sec")
    cumulated = ranges.withColumns({"upto": F.sum(span).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(span).over(Window.partitionBy("match_id"))})
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(fraction))) * F.col("total")
    at = F.when(target <= F.col("upto"), F.col("start_sec") + target - (F.col("upto") - span))
    return cumulated.withColumn("at", at).groupBy("match_id").agg(rounded(F.coalesce(F.min("at"), F.max("end_sec")), 3).alias("t_sec"))


def ranges_hash(ranges: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Eight hex digits that name the ranges of a match; ``all`` for those of ``matches`` that have none."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec"))), lambda r: F.format_string("%.1f-%.1f", r["start_sec"], r["end_sec"]))
    named = ranges.groupBy("match_id").agg(F.substring(F.sha1(F.array_join(text, ";").cast("binary")), 1, 8).alias("hash"))
    if matches is None:
        return named
    return matches.select("match_id").distinct().join(named, "match_id", "left").withColumn("hash", F.coalesce("hash", F.lit("all")))


def widest_gap(ranges: DataFrame) -> DataFrame:
    """The longest stretch between neighbouring ranges of a match (the first if several are as long)."""
    w = Window.partitionBy("match_id").orderBy("start_sec", "end_sec")
    gaps = ranges.select("match_id", F.col("end_sec").alias("gap_start"), F.lead("start_sec").over(w).alias("gap_end")).filter("gap_end > gap_start")
    best = F.max_by(F.struct("gap_start", "gap_end"), F.struct(F.col("gap_end") - F.col("gap_start"), -F.col("gap_start")))
    return gaps.groupBy("match_id").agg(best.alias("g")).select("match_id", "g.*")


def add_period(ranges: DataFrame, duration: float, least_gap: float = 20.0) -> DataFrame:
    """The ranges with one more in the middle of the widest free stretch; where there is none, the widest range is split.

    Fixed values: a new period takes 60 % of the stretch, or 40 % but 60 s at least if that is less; a split leaves a fifth of
    the range free, between 20 and 300 s, and needs a range of 40 s."""
    whole, w = Window.partitionBy("match_id"), Window.partitionBy("match_id").orderBy("start_sec", "end_sec")
    length = F.col("end_sec") - F.col("start_sec")
    stretch = lambda a, b: F.struct((b - a).alias("size"), (-a).alias("order"), b.alias("b"))
    before = stretch(F.coalesce(F.lag("end_sec").over(w), F.lit(0.0)), F.col("start_sec"))
    rows = ranges.select("match_id", "start_sec", "end_sec").withColumns({"before": before, "k": F.row_number().over(w)})
    # all of a match in one pass over its sorted rows: the widest free stretch, the widest range (the first of equal ones)
    rows = rows.withColumns({"free": F.max("before").over(whole), "last": F.max("end_sec").over(whole), "widest": F.max(F.struct(length.alias("size"), (-F.col("k")).alias("k"))).over(whole)})
    rows = rows.withColumn("g", F.greatest("free", stretch(F.col("last"), F.lit(float(duration)))))
    size, a = F.col("g.size"), -F.col("g.order")
    span, mid = F.least(size * 0.6, F.greatest(F.lit(60.0), size * 0.4)), (a + F.col("g.b")) / 2
    piece = lambda a, b: F.struct(a.alias("start_sec"), b.alias("end_sec"))
    own = piece(F.col("start_sec"), F.col("end_sec"))
    half = (length - F.greatest(F.lit(20.0), F.least(length * 0.2, F.lit(300.0)))) / 2
    halves = F.array(piece(F.col("start_sec"), F.col("start_sec") + half), piece(F.col("end_sec") - half, F.col("end_sec")))
    roomy, first = size > least_gap, F.col("k") == 1
    out = F.when(roomy & first, F.array(own, piece(mid - span / 2, mid + span / 2))).when(~roomy & (F.col("k") == -F.col("widest.k")) & (length >= 40), halves).otherwise(F.array(own))
    return rows.select("match_id", F.inline(out))


def shot_of(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """The shot that contains each sample's time, ends included; samples in no shot drop out.

    Shots of a match don't overlap, but may touch: on a shared end the earlier shot counts."""
    w = Window.partitionBy("match_id").orderBy("start_sec", "end_sec", "range_id")
    s = shots.withColumns({"__e": F.lag("end_sec").over(w), "__s": F.lag("range_id").over(w)})
    both, back, _ = _beside(samples.select("match_id", "point_id", "t_sec"), s, "t_sec", F.col("range_id").alias("s"), F.col("__e").alias("e"), F.col("__s").alias("p"))
    seen = both.withColumn("__b", F.last("__r", True).over(back)).filter("__p = 1")
    shot = F.when(F.col("__b.e") >= F.col("t_sec"), F.col("__b.p")).when(F.col("__b.b") >= F.col("t_sec"), F.col("__b.s"))
    return seen.select("match_id", "point_id", shot.alias("shot")).filter("shot is not null")
