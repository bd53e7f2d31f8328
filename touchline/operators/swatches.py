"""Kit colours from the pixels of player crops: the pitch's palette, standout colours, two kits and their swatches.

Pixels are rows (match_id, crop_id, r, g, b). They are counted first: a sketch holds each colour of a crop or match once, with its
number, so its size is bounded by the colours there are and not by the pixels. Clusters are found on sketches by seeded Lloyd rounds,
one row a crop or match in an Arrow batch; everything else is aggregates and joins. Distances are in 8-bit Lab, where white and navy
differ in lightness and yellow and blue in colour."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from touchline.functions import columns as X
from touchline.operators import colour
from touchline.operators.grouped import fold_groups
from touchline.tables import Stage

# fixed values
PITCH_K, PITCH_SHARE, PITCH_RADIUS, PITCH_TOLERANCE = 3, 0.08, 26.0, 26.0
LEAST_GRASS = 100  # grass pixels for a frame to tell the pitch's colour
KEPT_SHARE, KEPT_PIXELS, READABLE = 0.12, 8, 12  # of a crop that is not pitch
COLOUR_SHARE, COLOUR_PIXELS = 0.12, 8  # of a cluster that may stand out
SECOND_CHROMA, SECOND_LIGHTNESS = 60.0, 120.0
LEAST_CROPS = 4  # of a match to tell two kits
SWATCH_SHARE, SWATCH_APART, MOST_SWATCHES = 0.18, 60.0, 3
ROUNDS = 8
STEP = 4  # of Lab in the sketch of a pitch
BROADCAST_ROWS = 100_000  # of a palette; longer ones are joined by shuffle


def lloyd(points: np.ndarray, counts: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """The cluster of each counted point, for at most k clusters.

    The first centre is the first point, each further one the point with the largest count times squared distance to its nearest centre
    (the first of equal ones); points nearest to several centres go to the first, and a cluster without points keeps its centre."""
    centres = points[:1].astype(float)
    for _ in range(k - 1):
        away = ((points[:, None].astype(float) - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[np.argmax(counts * away)]])
    for _ in range(rounds + 1):
        d = points[:, None].astype(float) - centres[None]
        label = np.argmin(d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2, axis=1)
        sums = np.stack([np.bincount(label, counts * points[:, j], k) for j in range(3)], axis=1)
        n = np.bincount(label, counts, k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return label


@F.pandas_udf(ArrayType(IntegerType()))
def clustered(x: pd.Series, y: pd.Series, z: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    """``lloyd`` on the sketch of each row."""
    return pd.Series([lloyd(np.stack([a, b, c], axis=1), np.asarray(m), int(j)).astype(np.int32) for a, b, c, m, j in zip(x, y, z, n, k)])


def part(name: str):
    """The field of that name of a struct."""
    return lambda s: s[name]


def sketch(rows: DataFrame, key: list[str], names: tuple[str, str, str], step: int = 1, weight: Column | None = None) -> DataFrame:
    """One row a key: arrays ``x, y, z`` of its colours (in steps) and ``n`` of their numbers, the most frequent first; rows that count ``weight`` times also give the sums of the colours themselves."""
    q = [F.floor(F.col(c) / step).cast("int") for c in names]
    sums = [] if weight is None else [F.sum(weight * F.col(c).cast("long")).alias(f"s{a}") for c, a in zip(names, "xyz")]
    bins = rows.groupBy(*key, *[c.alias(a) for c, a in zip(q, "xyz")]).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"), *sums)
    fields = [*"xyz", "n"] + [f"s{a}" for a in "xyz" if sums]
    whole = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), *fields))).alias("bins"))
    return whole.select(*key, *[F.transform("bins", part(f)).alias(f) for f in fields], F.aggregate("bins", F.lit(0).cast("long"), lambda t, b: t + b["n"]).alias("total"))


def clusters(sketched: DataFrame, key: list[str], k: Column) -> DataFrame:
    """The colours of sketches, one a row, with their ``cluster`` and the ``total`` of the sketch."""
    labelled = sketched.withColumn("cluster", clustered("x", "y", "z", "n", k))
    arrays = [c for c in labelled.columns if c not in (*key, "total")]
    return labelled.select(*key, "total", F.inline(F.arrays_zip(*arrays)))


def middle(c: str) -> Column:
    """The median of a counted colour."""
    return F.percentile(c, F.lit(0.5), F.col("n"))


def lab(r: Column, g: Column, b: Column) -> Column:
    return X.rgb_to_lab(F.struct(r.alias("r"), g.alias("g"), b.alias("b")))


def lab_gap(a: Column, b: Column) -> Column:
    return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in ("l", "a", "b")))


def second_colour(a: Column, b: Column) -> Column:
    """Whether two colours (Lab) are two colours of a kit, not one shirt lit two ways."""
    chroma = F.sqrt((a["a"] - b["a"]) * (a["a"] - b["a"]) + (a["b"] - b["b"]) * (a["b"] - b["b"]))
    return (chroma > SECOND_CHROMA) | (F.abs(a["l"] - b["l"]) > SECOND_LIGHTNESS)


def pitch_palette(pixels: DataFrame) -> DataFrame:
    """``match_id, place, l, a, b, share``: what the pitch of each match is made of, from the pixels (match_id, r, g, b) of its lower middle."""
    counted = pixels.groupBy("match_id", *"rgb").agg(F.count("*").alias("n"))
    coloured = counted.select("match_id", "n", lab(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("match_id", "n", "c.*")
    whole = sketch(coloured, ["match_id"], ("l", "a", "b"), STEP, F.col("n"))
    parts = clusters(whole, ["match_id"], F.least(F.lit(PITCH_K), F.greatest(F.lit(1), F.floor(F.col("total") / 50))).cast("int"))
    g = parts.groupBy("match_id", "cluster").agg(F.sum("n").alias("n"), F.first("total").alias("total"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"]).withColumn("share", F.col("n") / F.col("total"))
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), "cluster"))
    return g.filter(F.col("share") >= PITCH_SHARE).select("match_id", place.alias("place"), *[(F.col(f"s{c}") / F.col("n")).alias(o) for c, o in zip("xyz", ("l", "a", "b"))], "share")


def pitch_reference(pixels: DataFrame) -> DataFrame:
    """``match_id, l, a, b``: one colour of the pitch, the median over frames of the medians of their grass (match_id, frame_index, r, g, b)."""
    hsv = pixels.withColumn("c", X.rgb_to_hsv(F.struct("r", "g", "b"))).filter(colour.is_grass(F.col("c.h"), F.col("c.s"), F.col("c.v")))
    frames = hsv.groupBy("match_id", "frame_index").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in "rgb"]).filter(F.col("n") >= LEAST_GRASS)
    return frames.groupBy("match_id").agg(*[F.floor(F.median(c)).alias(c) for c in "rgb"]).select("match_id", lab(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("match_id", "c.*")


def references(palette: DataFrame) -> DataFrame:
    """``match_id, refs``: the few colours of each pitch in one array."""
    return palette.groupBy("match_id").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("l", "a", "b")])).alias("refs"))


def pitch_gap(c: Column, refs: Column) -> Column:
    """Distance to the nearest colour of the pitch; null where none is known."""
    return F.array_min(F.transform(refs, lambda p: lab_gap(c, p)))


def with_references(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """``rows`` with the ``refs`` of their match; ``palette`` is a written table, so it is counted before it is broadcast."""
    refs = references(palette)
    return rows.join(F.broadcast(refs) if palette.count() <= BROADCAST_ROWS else refs, "match_id", "left")


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of counted values, halfway between the two in the middle."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    low, high = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")
    return (float(values[order[low]]) + float(values[order[high]])) / 2


def crop_parts(pixels: DataFrame, palette: DataFrame, hues: bool = False) -> DataFrame:
    """The clusters of what each readable crop shows beside the pitch of its match (the band of grass where that is unknown).

    ``match_id, crop_id, cluster, n, total``, the medians ``x, y, z`` of the cluster, ``mx, my, mz`` of all that is kept and, with
    ``hues``, ``mh, ms, mv`` of the whole crop. Pixels are read once: counted, then folded crop by crop in shared Arrow batches, so a
    crop in memory is as large as its number of colours. Pixels without a colour, crop or match count for nothing."""
    key = ["match_id", "crop_id"]
    counted = pixels.na.drop(subset=[*key, *"rgb"]).groupBy(*key, *"rgb").agg(F.count("*").alias("n"))
    seen = with_references(counted, palette)
    hsv = X.rgb_to_hsv(F.struct("r", "g", "b"))
    seen = seen.withColumns({"hsv": hsv if hues else F.when(F.col("refs").isNull(), hsv), "lab": lab(F.col("r"), F.col("g"), F.col("b"))})
    away = F.coalesce(pitch_gap(F.col("lab"), F.col("refs")) > PITCH_RADIUS, ~colour.is_grass(F.col("hsv.h"), F.col("hsv.s"), F.col("hsv.v")))
    rows = seen.select(*key, *[F.col(c).cast("long").alias(c) for c in "rgb"], "n", away.alias("away"), *[F.col(f"hsv.{c}").alias(c) for c in "hsv" if hues])

    def fold(k: tuple, c: dict[str, np.ndarray]) -> list:
        n, away = c["n"], c["away"].astype(bool)
        total = int(n[away].sum())
        if total < max(KEPT_PIXELS, READABLE, math.floor(KEPT_SHARE * int(n.sum()))):
            return [[] for _ in names]
        points, counts = np.stack([c[v][away] for v in "rgb"], axis=1), n[away]
        order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], -counts))
        points, counts = points[order], counts[order]
        label = lloyd(points, counts, 3 if total >= 60 else 2)
        whole = [weighted_median(points[:, j], counts) for j in range(3)] + [weighted_median(c[v], n) for v in "hsv" if hues]
        out = []
        for j in np.unique(label):
            own = label == j
            out.append([*k, int(j), int(counts[own].sum()), total, *[weighted_median(points[own, i], counts[own]) for i in range(3)], *whole])
        return [list(v) for v in zip(*out)]

    fields = [f"{c} {pixels.schema[c].dataType.simpleString()}" for c in key] + ["cluster int", "n long", "total long"] + [f"{c} double" for c in ("x", "y", "z", "mx", "my", "mz", *(("mh", "ms", "mv") if hues else ()))]
    names = [f.split(" ")[0] for f in fields]
    return fold_groups(rows, tuple(key), (), fold, ", ".join(fields))


def readings_of(parts: DataFrame, palette: DataFrame) -> DataFrame:
    """The standout colours of crops from their parts; a crop none of whose parts is large enough has the middle of all, with score 0."""
    key = ["match_id", "crop_id"]
    own = F.coalesce("refs", F.array(lab(*[F.floor(F.col(f"m{c}")) for c in "xyz"])))
    c = with_references(parts, palette).withColumns({"refs": own, "lab": lab(*[F.floor(F.col(v)) for v in "xyz"])})
    scored = c.withColumn("score", pitch_gap(F.col("lab"), F.col("refs")) * F.sqrt(F.col("n") / F.col("total")))
    large = (F.col("n") >= COLOUR_SHARE * F.col("total")) & (F.col("n") >= COLOUR_PIXELS)
    colour_ = F.struct((-F.col("score")).alias("order"), "cluster", F.col("x").alias("r"), F.col("y").alias("g"), F.col("z").alias("b"), "lab")
    ranked = scored.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(large, colour_))).alias("c"), *[F.max(f"m{v}").alias(f"m{v}") for v in "xyz"])
    first = F.get("c", 0)
    others = F.filter(F.slice("c", 2, 2), lambda o: second_colour(o["lab"], first["lab"]))
    plain = lambda s: F.struct(s["r"].alias("r"), s["g"].alias("g"), s["b"].alias("b"), (-s["order"]).alias("score"))
    drab = F.array(F.struct(*[F.col(f"m{v}").alias(o) for v, o in zip("xyz", "rgb")], F.lit(0.0).alias("score")))
    found = F.when(F.size("c") > 0, F.transform(F.concat(F.array(first), F.slice(others, 1, 1)), plain)).otherwise(drab)
    return ranked.select(*key, F.posexplode(found).alias("at", "s")).select(*key, (F.col("at") + 1).alias("place"), "s.r", "s.g", "s.b", "s.score")


def standout_colours(pixels: DataFrame, palette: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``match_id, crop_id, place, r, g, b, score``: the one or two colours of each crop that stand out from the pitch.

    A colour's score is its distance from the pitch times the root of its share, so neither a big drab part nor a few bright pixels win.
    A second colour is reported only if it is one of the kit's, not the first in other light. Readings, a few a crop, are written, so
    that what is made of them doesn't read the pixels again."""
    stage = stage or Stage(pixels.sparkSession)
    palette = stage.write(palette)
    return stage.write(readings_of(crop_parts(pixels, palette), palette))


def lab_kits(readings: DataFrame) -> DataFrame:
    """``match_id, crop_id, team``: the crops of each match in two kits by their first standout colour, team 0 the larger; none for matches of fewer than four crops."""
    c = readings.filter("place = 1").select("match_id", "crop_id", lab(*[F.floor(F.col(v)) for v in "rgb"]).alias("c")).select("match_id", "crop_id", *[F.col(f"c.{v}").cast("int").alias(v) for v in ("l", "a", "b")])
    parts = clusters(sketch(c, ["match_id"], ("l", "a", "b")).filter(F.col("total") >= LEAST_CROPS), ["match_id"], F.lit(2))
    sides = parts.groupBy("match_id", "cluster").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("match_id")
    sides = sides.withColumns({"team": F.row_number().over(w.orderBy(F.desc("n"), "cluster")) - 1, "sides": F.count("*").over(w)}).filter("sides = 2")
    named = parts.join(sides.select("match_id", "cluster", "team"), ["match_id", "cluster"]).select("match_id", F.col("x").alias("l"), F.col("y").alias("a"), F.col("z").alias("b"), "team")
    return c.join(named, ["match_id", "l", "a", "b"]).select("match_id", "crop_id", "team")


def swatches(readings: DataFrame, *key: str) -> DataFrame:
    """``hexes`` of each key's readings (r, g, b), the larger colour first: as many as are distinct, up to three.

    One colour is the median of the larger of two groups of readings. More are reported while every group holds enough readings, its
    centre is far from the others, and all are colours of a kit and not of its lighting."""
    own = list(key)
    q = readings.select(*own, *[F.floor(F.col(c)).cast("int").alias(c) for c in "rgb"])
    whole = sketch(q, own, ("r", "g", "b"))
    hex_ = lambda c: X.rgb_to_hex(*[F.floor(c[v]) for v in "rgb"])
    out = clusters(whole, own, F.lit(1)).groupBy(*own).agg(F.first("total").alias("total"), F.struct(*[middle(c).alias(v) for c, v in zip("xyz", "rgb")]).alias("all"))
    for k in range(2, MOST_SWATCHES + 1):
        g = clusters(whole, own, F.lit(k)).groupBy(*own, "cluster").agg(F.sum("n").alias("n"), F.first("total").alias("total"), F.struct(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(v) for c, v in zip("xyz", "rgb")]).alias("centre"), F.struct(*[middle(c).alias(v) for c, v in zip("xyz", "rgb")]).alias("median"))
        g = g.withColumn("lab", lab(*[F.floor(F.col(f"centre.{v}")) for v in "rgb"]))
        ranked = g.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "cluster", "n", "centre", "median", "lab"))).alias("c"), F.first("total").alias("total"))
        pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
        at = lambda i: F.get("c", i)["centre"]
        apart = [F.sqrt(sum((at(i)[v] - at(j)[v]) * (at(i)[v] - at(j)[v]) for v in "rgb")) >= SWATCH_APART for i, j in pairs]
        kits = [second_colour(F.get("c", i)["lab"], F.get("c", j)["lab"]) for i, j in pairs]
        good = (F.size("c") == k) & (F.col("total") >= max(8, 4 * k)) & (F.array_min(F.transform("c", lambda s: s["n"])) >= SWATCH_SHARE * F.col("total"))
        for test in (*apart, *kits):
            good = good & test
        out = out.join(ranked.select(*own, F.coalesce(good, F.lit(False)).alias(f"good{k}"), F.transform("c", lambda s: hex_(s["median"])).alias(f"hexes{k}"), F.get("c", 0).alias(f"top{k}")), own)
    larger = F.when((F.col("total") >= 8) & (F.col("top2.n") >= 4), F.col("top2.median")).otherwise(F.col("all"))
    return out.select(*own, F.when(F.col("good2") & F.col("good3"), F.col("hexes3")).when(F.col("good2"), F.col("hexes2")).otherwise(F.array(hex_(larger))).alias("hexes"))


def kit_vote(pixels: DataFrame, palette: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``match_id, team, hex, hexes, n_crops``: the two kits of each match; nothing where they can't be told apart.

    Crops of referees, of no colour or of the pitch itself don't vote. A colour that both sides claim is taken from the smaller one,
    unless it has no other; sides with the same first colour are no two kits. Readings, a few a crop, are written between the steps."""
    stage = stage or Stage(pixels.sparkSession)
    palette = stage.write(palette)
    parts = stage.write(crop_parts(pixels, palette, hues=True))
    whole = [F.floor(F.col(f"m{v}")) for v in "hsv"]
    readings = stage.write(readings_of(parts.filter(~colour.referee_crop(*whole) & ~colour.neutral_crop(*whole[1:])), palette))
    first = with_references(readings.filter("place = 1"), palette).withColumn("lab", lab(*[F.floor(F.col(v)) for v in "rgb"]))
    ground = F.coalesce(pitch_gap(F.col("lab"), F.col("refs")) < PITCH_TOLERANCE, F.lit(False))
    worn = stage.write(readings.join(first.filter(~ground).select("match_id", "crop_id"), ["match_id", "crop_id"]))
    teams = stage.write(lab_kits(worn))
    sets = stage.write(swatches(worn.join(teams, ["match_id", "crop_id"]), "match_id", "team").join(teams.groupBy("match_id", "team").agg(F.count("*").alias("n_crops")), ["match_id", "team"]))
    side = lambda t: sets.filter(F.col("team") == t).select("match_id", F.col("hexes").alias(f"h{t}"), F.col("n_crops").alias(f"n{t}"))
    rest = F.array_except("h1", "h0")
    both = side(0).join(side(1), "match_id").withColumn("h1", F.when(F.size(rest) > 0, rest).otherwise(F.col("h1"))).filter("h0[0] <> h1[0]")
    rows = F.array(*[F.struct(F.lit(n).alias("team"), F.get(h, 0).alias("hex"), F.col(h).alias("hexes"), F.col(c).alias("n_crops")) for n, h, c in (("team_a", "h0", "n0"), ("team_b", "h1", "n1"))])
    return both.select("match_id", F.inline(rows))
