"""Column builders; all stay in the JVM and inside whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config


def rounded(value: Column, places: int = 4) -> Column:
    """Half-up rounding that agrees between engines: floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(value * 10.0**places + 0.5) / 10.0**places


def both_ways(keys: tuple[str, ...], order: tuple[str, ...], own: bool = True) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the rows up to each row (itself included if ``own``), in order and from the end; ``F.last`` over the second is the next one.

    A frame that ends unbounded is read anew for each row, which makes a group quadratic; from the end it is one pass."""
    to = 0 if own else -1
    back, ahead = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return back.rowsBetween(Window.unboundedPreceding, to), ahead.rowsBetween(Window.unboundedPreceding, to)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column, least: float = 0.0) -> Column:
    """Degrees between two vectors; 0 if one of them is null-length."""
    n1, n2 = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / (n1 * n2)))
    return F.when((n1 <= least) | (n2 <= least), 0.0).otherwise(F.degrees(F.acos(cosine)))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_box_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx = F.greatest(x1 - x, F.lit(0.0), x - x2)
    dy = F.greatest(y1 - y, F.lit(0.0), y - y2)
    return F.sqrt(dx * dx + dy * dy)


def feet_point(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The middle of the lower third of a box."""
    return (x1 + x2) / 2, y1 + (y2 - y1) * 5 / 6


def around(x: Column, y: Column, half: float) -> tuple[Column, Column, Column, Column]:
    """A square box that stands for the ball at a point."""
    h = max(1.0, half)
    return x - h, y - h, x + h, y + h


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def torso(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whole-pixel bounds of the torso of a box: 15 to 55 % of its height, a fifth in from each side; null if nothing is left."""
    h, w = F.greatest(y2 - y1, F.lit(1.0)), F.greatest(x2 - x1, F.lit(1.0))
    cut = lambda c: c.cast("int")
    left, top, right, bottom = cut(x1 + 0.2 * w), cut(y1 + 0.15 * h), cut(x2 - 0.2 * w), cut(y1 + 0.55 * h)
    return F.when((bottom > top) & (right > left), F.array(left, top, right, bottom))


def roi(x: Column, y: Column, half: float, width: int, height: int) -> Column:
    """Whole-pixel bounds of a region around a point (half-even rounding), clamped to the frame and never empty."""
    near = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.bround(c - half).cast("int")))
    far = lambda c, most: F.greatest(near(c, most) + 1, F.least(F.lit(most), F.bround(c + half).cast("int")))
    return F.array(near(x, width), near(y, height), far(x, width), far(y, height))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def hsv_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Hue-weighted distance of 8-bit HSV colours; hue wraps at 180. Null if a part is null."""
    raw = F.abs(a[0] - b[0])
    dh = F.when(raw > 90, 180 - raw).otherwise(raw)
    ds, dv = a[1] - b[1], a[2] - b[2]
    return F.sqrt(4 * dh * dh + ds * ds + 0.25 * dv * dv)


def nearest_colour(kit: tuple[Column, Column, Column], refs: list[tuple[float, float, float]]) -> Column:
    """Distance of a colour to the nearest of a kit's colours; null if the colour or the kit is unknown."""
    each = [hsv_distance(kit, tuple(F.lit(float(v)) for v in r)) for r in refs]
    return F.lit(None).cast("double") if not each else each[0] if len(each) == 1 else F.least(*each)


def colour_gap(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    """The same distance of two given colours, when a plan is built."""
    hue = abs(a[0] - b[0])
    return math.hypot(2 * min(hue, 180 - hue), a[1] - b[1], 0.5 * (a[2] - b[2]))


def separable(mine: list[tuple[float, float, float]], other: list[tuple[float, float, float]], apart: float) -> bool:
    """Kits whose nearest pair of colours is further apart than ``apart``."""
    return bool(mine and other) and min(colour_gap(a, b) for a in mine for b in other) > apart


def hex_to_rgb(hex_: Column) -> Column:
    """(r, g, b) of ``#rrggbb``, null for anything else."""
    digits = F.lower(F.regexp_extract(hex_, "^#?([0-9a-fA-F]{6})$", 1))
    two = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(two(1).alias("r"), two(3).alias("g"), two(5).alias("b")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, whatever uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def rgb_to_hsv(rgb: Column, whole: bool = True) -> Column:
    """(h, s, v) with h up to 180 and s, v up to 255; ``whole`` rounds each half-even to 8 bits, as image libraries do."""

    def converted(c: Column) -> Column:
        r, g, b = (c[k].cast("double") for k in "rgb")
        most = F.greatest(r, g, b)
        d = most - F.least(r, g, b)
        turn = F.when(d == 0, 0.0).when(most == r, 60 * (g - b) / d).when(most == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
        hue = F.pmod(turn, F.lit(360.0)) / 2
        sat = F.when(most == 0, 0.0).otherwise(d * 255 / most)
        if whole:
            hue, sat = F.pmod(F.bround(hue), F.lit(180.0)), F.bround(sat)
        return F.when(c.isNotNull(), F.named_struct(F.lit("h"), hue, F.lit("s"), sat, F.lit("v"), most))

    return let(rgb, converted)


# fixed values: from linear sRGB to XYZ, relative to the white point
XYZ = ((0.412453 / 0.950456, 0.357580 / 0.950456, 0.180423 / 0.950456), (0.212671, 0.715160, 0.072169), (0.019334 / 1.088754, 0.119193 / 1.088754, 0.950227 / 1.088754))


def rgb_to_lab(rgb: Column) -> Column:
    """(l, a, b) in 8 bits each, as image libraries scale them: lightness of 100 is 255, and no colour is 128.

    Plain expressions, as the planner takes long over nested lambdas; common parts are computed once in generated code."""
    line = [F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) for v in (rgb[k].cast("double") / 255.0 for k in "rgb")]
    x, y, z = (sum(m * v for m, v in zip(row, line)) for row in XYZ)
    fx, fy, fz = (F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16.0 / 116.0) for t in (x, y, z))
    light = F.when(y > 0.008856, 116.0 * fy - 16.0).otherwise(903.3 * y)
    whole = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v + 0.5).cast("double")))
    return F.when(rgb.isNotNull(), F.named_struct(F.lit("l"), whole(light * 255.0 / 100.0), F.lit("a"), whole(500.0 * (fx - fy) + 128.0), F.lit("b"), whole(200.0 * (fy - fz) + 128.0)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0")
    return F.concat(F.lit("#"), F.lower(F.concat(two(r), two(g), two(b))))


# fixed values: upper ends of the hue ranges in degrees, and their names
HUES = ((20, "red"), (45, "orange"), (70, "yellow"), (100, "yellow-green"), (160, "green"), (200, "cyan"), (260, "blue"), (320, "purple/magenta"), (361, "red"))


def colour_name(h: Column, s: Column, v: Column) -> Column:
    """A plain name of an HSV colour."""
    base = reduce(lambda c, p: c.when(2 * h < p[0], p[1]), HUES[1:], F.when(2 * h < HUES[0][0], HUES[0][1]))
    shade = F.when(v < 110, "dark ").when(s < 90, "pale ").otherwise("")
    return F.when(v < 50, "very dark / near-black").when((s < 40) & (v > 180), "white").when(s < 40, "grey").otherwise(F.concat(shade, base))


def upper_median(values: Column) -> Column:
    """The value at place floor(n / 2) of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def file_size(n: Column) -> Column:
    """Bytes as B, whole KB, or MB with one place."""
    n = F.coalesce(n, F.lit(0))
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", F.floor(n / (1 << 20) * 10 + 0.5) / 10)).when(n >= 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def minutes(seconds: Column) -> Column:
    """mm:ss, with as many minutes as there are."""
    s = F.floor(F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0))))
    m = F.floor(s / 60).cast("string")
    return F.concat(F.when(F.length(m) < 2, F.lpad(m, 2, "0")).otherwise(m), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def orbital_prior(dist: Column, dt: Column, cfg: Config = DEFAULT) -> Column:
    """1 inside a radius that grows with time, falling to a floor outside it; neutral after a long gap."""
    radius = cfg.orbital_base_px + cfg.orbital_growth_px_s * F.greatest(F.lit(0.0), dt)
    over = (dist - radius) / F.greatest(radius, F.lit(1e-6))
    return F.when((dt > cfg.orbital_max_gap_sec) | (dist <= radius), 1.0).otherwise(F.greatest(F.lit(cfg.orbital_floor), 1 - cfg.orbital_falloff * over))


def listed(*cases: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))


def clock(seconds: Column) -> Column:
    """m:ss below an hour, h:mm:ss from then on."""
    s = F.floor(seconds)
    ss = F.lpad((s % 60).cast("string"), 2, "0")
    mm = F.floor(s / 60)
    long = F.concat(F.floor(mm / 60).cast("string"), F.lit(":"), F.lpad((mm % 60).cast("string"), 2, "0"), F.lit(":"), ss)
    return F.when(mm >= 60, long).otherwise(F.concat(mm.cast("string"), F.lit(":"), ss))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def version_parts(version: Column) -> Column:
    """The leading numbers of a version such as v1.10.0-beta, or null if it has none."""
    parts = F.split(F.regexp_replace(F.trim(version), "^[vV]+", ""), r"[.\-+]")
    numbers = F.aggregate(parts, F.struct(F.lit(True).alias("go"), F.array().cast("array<int>").alias("n")), lambda a, p: F.when(a["go"] & p.rlike(r"^\d+$"), F.struct(F.lit(True).alias("go"), F.concat(a["n"], F.array(p.cast("int"))).alias("n"))).otherwise(F.struct(F.lit(False).alias("go"), a["n"].alias("n"))))["n"]
    return F.when(F.size(numbers) > 0, numbers)


def is_newer(latest: Column, current: Column) -> Column:
    """Versions compared number by number; one that can't be read is never newer."""
    return F.coalesce(version_parts(latest) > version_parts(current), F.lit(False))
