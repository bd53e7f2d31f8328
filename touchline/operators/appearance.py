"""Appearance descriptors: histograms of pixels, their likeness, and galleries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUE_BINS, SAT_BINS = 12, 4


def descriptor(pixels: DataFrame, *key: str, hue_bins: int = HUE_BINS, sat_bins: int = SAT_BINS) -> DataFrame:
    """``descriptor``: counts of hue and saturation bins, scaled to unit length; a bin without pixels is 0."""
    n = hue_bins * sat_bins
    bin_ = F.least(F.lit(hue_bins - 1), F.floor(F.col("h") * hue_bins / 180)) * sat_bins + F.least(F.lit(sat_bins - 1), F.floor(F.col("s") * sat_bins / 256))
    counts = pixels.groupBy(*key, bin_.cast("int").alias("__bin")).agg(F.count("*").cast("double").alias("__n"))
    held = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__n"))).alias("__m"), F.sqrt(F.sum(F.col("__n") * F.col("__n"))).alias("__l"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0.0)) / F.col("__l"))
    return held.select(*key, filled.alias("descriptor"))


def rgb_histogram(pixels: DataFrame, *key: str, bins: int = 8) -> DataFrame:
    """``descriptor`` over ``bins`` cubed bins of r, g and b, scaled to unit length."""
    at = reduce(lambda a, c: a * bins + F.least(F.lit(bins - 1), F.floor(F.col(c) * bins / 256)), "rgb", F.lit(0))
    counts = pixels.groupBy(*key, at.cast("int").alias("__bin")).agg(F.count("*").cast("double").alias("__n"))
    held = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__n"))).alias("__m"), F.sqrt(F.sum(F.col("__n") * F.col("__n"))).alias("__l"))
    return held.select(*key, F.transform(F.sequence(F.lit(0), F.lit(bins**3 - 1)), lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0.0)) / F.col("__l")).alias("descriptor"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def correlation(a: Column, b: Column) -> Column:
    """Correlation of two histograms, from 0 to 1; 1 where both are flat, 0 where something is missing."""
    n = F.size(a).cast("double")
    va, vb = _sum(F.transform(a, lambda x: x * x)) - _sum(a) * _sum(a) / n, _sum(F.transform(b, lambda x: x * x)) - _sum(b) * _sum(b) / n
    cov = _sum(F.zip_with(a, b, lambda x, y: x * y)) - _sum(a) * _sum(b) / n
    r = F.when(F.abs(va * vb) > 1e-15, cov / F.sqrt(va * vb)).otherwise(1.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)), F.lit(0.0))


def bhattacharyya(a: Column, b: Column) -> Column:
    """0 for histograms of the same shape, up to 1."""
    scale = F.sqrt(_sum(a) * _sum(b))
    overlap = _sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.when(scale > 0, overlap / scale).otherwise(1.0)))


def gallery_score(items: DataFrame, gallery: DataFrame, likeness=correlation) -> DataFrame:
    """``app``: the best likeness of each item's descriptor to those of the gallery (match_id, descriptor), null if there is none.

    A gallery is the few samples that a user gave for a match; it joins as one array per match."""
    few = gallery.filter("descriptor is not null").groupBy("match_id").agg(F.collect_list("descriptor").alias("__g"))
    best = F.array_max(F.transform("__g", lambda g: likeness(F.col("descriptor"), g)))
    return items.join(few, "match_id", "left").withColumn("app", F.when(F.col("descriptor").isNotNull() & F.col("__g").isNotNull(), best)).drop("__g")
