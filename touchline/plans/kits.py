"""Queries over pixels, kits and appearance, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import appearance as AP
from touchline.operators import attribution as A
from touchline.operators import clustering as C
from touchline.operators import colour as K
from touchline.sources.projections import duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# pixels of torso crops: every line of an order is a pixel of the crop of its supplier
PIXELS = (
    "l_suppkey AS crop_id", "CAST(l_orderkey * 31 % 180 AS DOUBLE) AS h", "CAST(l_partkey * 7 % 256 AS DOUBLE) AS s", "CAST(l_orderkey * 13 % 256 AS DOUBLE) AS v",
    "l_linenumber % 5 = 0 AS own", "CAST(l_partkey % 256 AS BIGINT) AS r", "CAST(l_orderkey % 256 AS BIGINT) AS g", "CAST(l_suppkey * 11 % 256 AS BIGINT) AS b",
)
# crops with one or two clear hues and some noise
DYED = (
    "l_suppkey AS crop_id",
    "CAST(CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 180 WHEN l_suppkey % 3 = 0 AND l_partkey % 2 = 0 THEN (l_suppkey * 17 + 85 + l_orderkey % 5) % 180 ELSE (l_suppkey * 17 + l_orderkey % 5) % 180 END AS DOUBLE) AS h",
    "CAST(120 + l_partkey % 100 AS DOUBLE) AS s", "CAST(90 + l_orderkey % 120 AS DOUBLE) AS v",
)
CROPS = ("p_partkey % 20 AS match_id", "p_partkey AS item", "CAST(CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 110 END + p_size % 6 AS DOUBLE) AS h", "CAST(150 + p_partkey % 25 AS DOUBLE) AS s", "CAST(120 + p_size % 40 * CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS v")
BANDS = (
    "l_orderkey % 97 AS box_id", "CAST(l_partkey % 560 AS DOUBLE) AS x1", "CAST(l_suppkey * 37 % 300 AS DOUBLE) AS y1", "CAST(l_partkey % 560 + 2 + l_suppkey % 30 AS DOUBLE) AS x2", "CAST(l_suppkey * 37 % 300 + 4 + l_partkey % 60 AS DOUBLE) AS y2",
    "l_orderkey", "l_linenumber",
)

_P = f"p AS {duck('lineitem', PIXELS)}"
_R = lambda c, n=4: f"floor(({c}) * {10**n} + 0.5) / {10**n}"
_GRASS = "(h BETWEEN 32 AND 95 AND s >= 40 AND v >= 40)"


@query(f"WITH {_P} SELECT crop_id, {_R(f'avg({_GRASS}::INT::DOUBLE)')} AS grass FROM p GROUP BY crop_id")
def q_grass_share(spark, sf_dir):
    return K.grass_share(project(spark, sf_dir, "lineitem", PIXELS), "crop_id").select("crop_id", X.rounded(F.col("grass")).alias("grass"))


@query(f"WITH {_P}, g AS (SELECT crop_id, count(*) FILTER (WHERE NOT own) AS n, count(*) FILTER (WHERE NOT own AND s >= 60) AS c, count(*) FILTER (WHERE NOT own AND s >= 60 AND NOT h BETWEEN 15 AND 60) AS o FROM p GROUP BY crop_id) SELECT crop_id, n >= 16 AND c >= 12 AND c >= 0.25 * n AND o >= 0.7::DOUBLE * c AS \"foreign\" FROM g")
def q_foreign_surface(spark, sf_dir):
    return K.foreign_surface(project(spark, sf_dir, "lineitem", PIXELS), "crop_id")


_CIRC = """m AS (SELECT crop_id, avg(cos(h / (90 / pi()))) AS c, avg(sin(h / (90 / pi()))) AS s1, count(*) AS n FROM q GROUP BY crop_id),
mm AS (SELECT crop_id, n, CASE WHEN atan2(s1, c) < 0 THEN atan2(s1, c) + 2 * pi() ELSE atan2(s1, c) END AS mean, sqrt(c * c + s1 * s1) AS r FROM m),
de AS (SELECT q.crop_id, q.h / (90 / pi()) - mean + pi() AS d FROM q JOIN mm USING (crop_id)),
md AS (SELECT crop_id, median(d - floor(d / (2 * pi())) * 2 * pi() - pi()) AS d FROM de GROUP BY crop_id),
ch AS (SELECT crop_id, n, r, mean, (mean + d) - floor((mean + d) / (2 * pi())) * 2 * pi() AS med FROM mm JOIN md USING (crop_id))"""


@query(
    f"""WITH {_P}, q AS (SELECT * FROM p), {_CIRC} SELECT crop_id, n, {_R('mean * (90 / pi())', 3)} % 180 AS hue_mean, {_R('med * (90 / pi())', 3)} % 180 AS hue_median, {_R('sqrt(-2 * ln(r)) * (90 / pi())', 3)} AS hue_std FROM ch"""
)
def q_circular_hue(spark, sf_dir):
    return K.circular_hue(K.dealt(project(spark, sf_dir, "lineitem", PIXELS), "crop_id"), "crop_id").select("crop_id", "n", *[(X.rounded(F.col(c), 3) % 180).alias(c) for c in ("hue_mean", "hue_median")], X.rounded(F.col("hue_std"), 3).alias("hue_std"))


@query(
    f"""WITH {_P}, w AS (SELECT *, s >= 40 AND v >= 50 AS vote, count(*) FILTER (WHERE s >= 40 AND v >= 50) OVER (PARTITION BY crop_id) AS k FROM p), q AS (SELECT * FROM w WHERE vote OR k < 4), {_CIRC}, o AS (SELECT crop_id, median(s) AS s, median(v) AS v FROM p GROUP BY crop_id)
SELECT crop_id, {_R('med * (90 / pi())', 3)} % 180 AS h, s, v FROM ch JOIN o USING (crop_id)"""
)
def q_jersey_colour(spark, sf_dir):
    return K.representative(K.dealt(project(spark, sf_dir, "lineitem", PIXELS), "crop_id"), "crop_id").withColumn("h", X.rounded(F.col("h"), 3) % 180)


@query(f"WITH {_P}, c AS (SELECT *, {_GRASS} AS grass, count(*) OVER (PARTITION BY crop_id) AS n, count(*) FILTER (WHERE NOT {_GRASS}) OVER (PARTITION BY crop_id) AS k FROM p) SELECT crop_id, count(*) AS kept FROM c WHERE NOT grass AND k >= greatest(8, floor(n * 0.12::DOUBLE)) GROUP BY crop_id")
def q_without_grass(spark, sf_dir):
    return K.without_grass(project(spark, sf_dir, "lineitem", PIXELS), "crop_id").groupBy("crop_id").agg(F.count("*").alias("kept"))


@query()
def q_shirt_colours(spark, sf_dir):
    return K.shirt_colours(project(spark, sf_dir, "lineitem", DYED), "crop_id")


@query(
    f"""WITH {_P}, c AS (SELECT crop_id, (least(11, floor(h * 12 / 180)) * 4 + least(3, floor(s * 4 / 256)))::INT AS bin, count(*)::DOUBLE AS n FROM p GROUP BY ALL) SELECT crop_id, bin, {_R('n / sqrt(sum(n * n) OVER (PARTITION BY crop_id))')} AS level FROM c"""
)
def q_descriptor(spark, sf_dir):
    d = AP.descriptor(project(spark, sf_dir, "lineitem", PIXELS), "crop_id")
    return d.select("crop_id", F.posexplode("descriptor").alias("bin", "l")).filter("l > 0").select("crop_id", "bin", X.rounded(F.col("l")).alias("level"))


_DESC = f"""c AS (SELECT crop_id, (least(11, floor(h * 12 / 180)) * 4 + least(3, floor(s * 4 / 256)))::INT AS bin, count(*)::DOUBLE AS n FROM p GROUP BY ALL), l AS (SELECT crop_id, sqrt(sum(n * n)) AS l FROM c GROUP BY crop_id),
a AS (SELECT crop_id, bin, coalesce(n, 0) / l.l AS x FROM l CROSS JOIN range(48) t(bin) LEFT JOIN c USING (crop_id, bin))"""


@query(
    f"""WITH {_P}, {_DESC}, t AS (SELECT crop_id + 1 AS crop_id, bin, x AS y FROM a), m AS (SELECT crop_id, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(sqrt(x * y)) AS q FROM a JOIN t USING (crop_id, bin) GROUP BY crop_id)
SELECT crop_id, {_R('greatest(0.0, least(1.0, (xy - sx * sy / 48) / sqrt((xx - sx * sx / 48) * (yy - sy * sy / 48))))')} AS correlation, {_R('sqrt(greatest(0.0, 1 - q / sqrt(sx * sy)))')} AS bhattacharyya FROM m"""
)
def q_likeness(spark, sf_dir):
    """Each crop's descriptor against that of the crop before."""
    d = AP.descriptor(project(spark, sf_dir, "lineitem", PIXELS), "crop_id")
    both = d.join(d.select((F.col("crop_id") + 1).alias("crop_id"), F.col("descriptor").alias("other")), "crop_id")
    a, b = F.col("descriptor"), F.col("other")
    return both.select("crop_id", X.rounded(AP.correlation(a, b)).alias("correlation"), X.rounded(AP.bhattacharyya(a, b)).alias("bhattacharyya"))


@query(f"WITH {_P}, c AS (SELECT crop_id, (least(7, floor(r / 32)) * 64 + least(7, floor(g / 32)) * 8 + least(7, floor(b / 32)))::INT AS bin, count(*)::DOUBLE AS n FROM p GROUP BY ALL) SELECT crop_id, bin, {_R('n / sqrt(sum(n * n) OVER (PARTITION BY crop_id))')} AS level FROM c")
def q_rgb_histogram(spark, sf_dir):
    d = AP.rgb_histogram(project(spark, sf_dir, "lineitem", PIXELS), "crop_id")
    return d.select("crop_id", F.posexplode("descriptor").alias("bin", "l")).filter("l > 0").select("crop_id", "bin", X.rounded(F.col("l")).alias("level"))


@query(f"WITH {_P} SELECT crop_id, list_sort(list(r))[len(list(r)) // 2 + 1] AS r, list_sort(list(g))[len(list(g)) // 2 + 1] AS g, list_sort(list(b))[len(list(b)) // 2 + 1] AS b FROM p GROUP BY crop_id")
def q_patch_median(spark, sf_dir):
    return K.patch_median(project(spark, sf_dir, "lineitem", PIXELS), "crop_id")


_RGB = "c AS (SELECT p_partkey, '#' || lower(lpad(to_hex(p_partkey * 37 % 256), 2, '0') || lpad(to_hex(p_size * 5 % 256), 2, '0') || lpad(to_hex(p_partkey * 13 % 256), 2, '0')) AS hex, (p_partkey * 37 % 256)::DOUBLE AS r, (p_size * 5 % 256)::DOUBLE AS g, (p_partkey * 13 % 256)::DOUBLE AS b FROM part)"
_HSV = f"""{_RGB}, m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c),
t AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS a, CASE WHEN v = 0 THEN 0.0 ELSE d * 255 / v END AS sat FROM m),
hsv AS (SELECT p_partkey, round_even(CASE WHEN a < 0 THEN a + 360 ELSE a END / 2, 0) % 180 AS h, round_even(sat, 0) AS s, v, {_R('CASE WHEN a < 0 THEN a + 360 ELSE a END / 2')} AS fine_h, {_R('sat')} AS fine_s FROM t)"""


def _hexes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", X.rgb_to_hex(F.col("p_partkey") * 37 % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 13 % 256).alias("hex"))


@query(f"WITH {_HSV} SELECT p_partkey, h, s, v, fine_h, fine_s FROM hsv")
def q_hex_to_hsv(spark, sf_dir):
    rgb = _hexes(spark, sf_dir).withColumn("rgb", X.hex_to_rgb(F.col("hex")))
    c = rgb.withColumns({"w": X.rgb_to_hsv(F.col("rgb")), "f": X.rgb_to_hsv(F.col("rgb"), False)})
    return c.select("p_partkey", "w.h", "w.s", "w.v", X.rounded(F.col("f.h")).alias("fine_h"), X.rounded(F.col("f.s")).alias("fine_s"))


@query(
    f"""WITH {_HSV} SELECT p_partkey, CASE WHEN v < 50 THEN 'very dark / near-black' WHEN s < 40 AND v > 180 THEN 'white' WHEN s < 40 THEN 'grey' ELSE CASE WHEN v < 110 THEN 'dark ' WHEN s < 90 THEN 'pale ' ELSE '' END ||
CASE WHEN 2 * h < 20 THEN 'red' WHEN 2 * h < 45 THEN 'orange' WHEN 2 * h < 70 THEN 'yellow' WHEN 2 * h < 100 THEN 'yellow-green' WHEN 2 * h < 160 THEN 'green' WHEN 2 * h < 200 THEN 'cyan' WHEN 2 * h < 260 THEN 'blue' WHEN 2 * h < 320 THEN 'purple/magenta' ELSE 'red' END END AS name,
(h <= 12 OR h >= 168) AND s >= 70 AND v >= 50 AS referee, s < 30 AND v > 55 AND v < 195 AS neutral FROM hsv"""
)
def q_colour_name(spark, sf_dir):
    named = X.let(X.rgb_to_hsv(X.hex_to_rgb(F.col("hex"))), lambda c: F.named_struct(F.lit("name"), X.colour_name(c["h"], c["s"], c["v"]), F.lit("referee"), K.referee_crop(c["h"], c["s"], c["v"]), F.lit("neutral"), K.neutral_crop(c["s"], c["v"])))
    return _hexes(spark, sf_dir).select("p_partkey", named.alias("n")).select("p_partkey", "n.*")


@query(
    f"""WITH RECURSIVE c AS {duck('part', CROPS)}, d AS (SELECT match_id, h, s, v, count(*) AS n, min(item) AS item FROM c GROUP BY ALL),
e AS (SELECT a.match_id, a.item AS a, b.item AS b, b.n FROM d a JOIN d b ON a.match_id = b.match_id AND 4 * (a.h - b.h) * (a.h - b.h) + (a.s - b.s) * (a.s - b.s) + (a.v - b.v) * (a.v - b.v) <= 324),
core AS (SELECT match_id, a FROM e GROUP BY ALL HAVING sum(n) >= 3), ce AS (SELECT e.match_id, e.a, e.b FROM e JOIN core x ON x.match_id = e.match_id AND x.a = e.a JOIN core y ON y.match_id = e.match_id AND y.a = e.b),
r AS (SELECT match_id, a, a AS l FROM core UNION SELECT ce.match_id, ce.b, r.l FROM r JOIN ce ON ce.match_id = r.match_id AND ce.a = r.a),
cl AS (SELECT match_id, a, min(l) AS l FROM r GROUP BY ALL),
lab AS (SELECT d.match_id, d.item, d.h, d.s, d.v, d.n, coalesce(own.l, (SELECT min(cl.l) FROM e JOIN cl ON cl.match_id = e.match_id AND cl.a = e.b WHERE e.match_id = d.match_id AND e.a = d.item)) AS l FROM d LEFT JOIN cl own ON own.match_id = d.match_id AND own.a = d.item),
sz AS (SELECT match_id, l, sum(n) AS k, row_number() OVER (PARTITION BY match_id ORDER BY sum(n) DESC, l) - 1 AS place FROM lab WHERE l IS NOT NULL GROUP BY match_id, l)
SELECT c.match_id, c.item, CASE WHEN place < 2 AND k >= 4 THEN place ELSE -1 END AS team FROM c JOIN lab ON lab.match_id = c.match_id AND lab.h = c.h AND lab.s = c.s AND lab.v = c.v LEFT JOIN sz ON sz.match_id = lab.match_id AND sz.l = lab.l"""
)
def q_dbscan(spark, sf_dir):
    return C.classify_crops(project(spark, sf_dir, "part", CROPS))


@query()
def q_two_kits(spark, sf_dir):
    return C.two_kits(project(spark, sf_dir, "part", CROPS))


@query()
def q_shade_merge(spark, sf_dir):
    c = _hexes(spark, sf_dir).withColumn("c", X.rgb_to_hsv(X.hex_to_rgb(F.col("hex"))))
    return K.merge_shades(c.select((F.col("p_partkey") % 40).alias("match_id"), F.col("p_partkey").alias("rank"), "c.h", "c.s", "c.v"))


@query(
    f"""WITH b AS {duck('lineitem', BANDS)}, t AS (SELECT *, greatest(y2 - y1, 1.0) AS h, greatest(x2 - x1, 1.0) AS w FROM b),
c AS (SELECT l_orderkey, l_linenumber, trunc(x1 + 0.2::DOUBLE * w)::INT AS l, trunc(y1 + 0.15::DOUBLE * h)::INT AS t, trunc(x2 - 0.2::DOUBLE * w)::INT AS r, trunc(y1 + 0.55::DOUBLE * h)::INT AS b FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN b > t AND r > l THEN l || ',' || t || ',' || r || ',' || b END AS torso FROM c"""
)
def q_torso_crop(spark, sf_dir):
    b = project(spark, sf_dir, "lineitem", BANDS)
    return b.select("l_orderkey", "l_linenumber", F.array_join(X.torso(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), ",").alias("torso"))


@query("SELECT l_orderkey, l_linenumber, coalesce((l_orderkey % 50)::DOUBLE / 100.0 >= 0.12::DOUBLE AND CASE WHEN l_linenumber % 4 <> 0 THEN (l_partkey * 7 % 100)::DOUBLE / 100.0 END < 0.18::DOUBLE, false) AS sideline FROM lineitem")
def q_sideline(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 4 != 0, (F.col("l_partkey") * 7 % 100).cast("double") / 100.0).alias("feet"), ((F.col("l_orderkey") % 50).cast("double") / 100.0).alias("scene"))
    return rows.select("l_orderkey", "l_linenumber", A.off_pitch(F.col("scene"), F.col("feet")).alias("sideline"))
