"""Queries over the pixels of pitches and kits, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import swatches as W
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


# pixels of torso crops: shirts in red or blue, some halved in white, with shorts and turf; one crop in eleven is turf only
SHIRTS = (
    "l_suppkey % 10 AS match_id", "l_suppkey AS crop_id",
    "CAST(CASE WHEN l_suppkey % 11 = 0 OR l_linenumber % 3 = 0 THEN 60 + l_partkey % 12 WHEN l_linenumber % 5 = 1 THEN 70 + l_orderkey % 9 WHEN l_suppkey % 7 = 0 AND l_partkey % 2 = 0 THEN 228 + l_orderkey % 20 WHEN l_suppkey % 20 < 10 THEN 196 + l_partkey % 24 ELSE 22 + l_orderkey % 16 END AS INT) AS r",
    "CAST(CASE WHEN l_suppkey % 11 = 0 OR l_linenumber % 3 = 0 THEN 118 + l_orderkey % 14 WHEN l_linenumber % 5 = 1 THEN 68 + l_partkey % 7 WHEN l_suppkey % 7 = 0 AND l_partkey % 2 = 0 THEN 226 + l_partkey % 22 WHEN l_suppkey % 20 < 10 THEN 24 + l_orderkey % 18 ELSE 40 + l_partkey % 18 END AS INT) AS g",
    "CAST(CASE WHEN l_suppkey % 11 = 0 OR l_linenumber % 3 = 0 THEN 48 + l_partkey % 9 WHEN l_linenumber % 5 = 1 THEN 74 + l_orderkey % 8 WHEN l_suppkey % 7 = 0 AND l_partkey % 2 = 0 THEN 224 + l_orderkey % 24 WHEN l_suppkey % 20 < 10 THEN 30 + l_partkey % 14 ELSE 176 + l_orderkey % 30 END AS INT) AS b",
)
# pixels of pitches: sunlit and shaded turf, and some worn dirt
TURF = (
    "o_custkey % 10 AS match_id", "o_orderkey % 4 AS frame_index",
    "CAST(CASE o_orderkey % 7 WHEN 0 THEN 120 + o_custkey % 9 WHEN 1 THEN 36 + o_custkey % 8 WHEN 2 THEN 36 + o_custkey % 8 ELSE 60 + o_custkey % 13 END AS INT) AS r",
    "CAST(CASE o_orderkey % 7 WHEN 0 THEN 92 + o_custkey % 7 WHEN 1 THEN 84 + o_orderkey % 9 WHEN 2 THEN 84 + o_orderkey % 9 ELSE 120 + o_orderkey % 12 END AS INT) AS g",
    "CAST(CASE o_orderkey % 7 WHEN 0 THEN 62 + o_orderkey % 6 WHEN 1 THEN 30 + o_custkey % 6 WHEN 2 THEN 30 + o_custkey % 6 ELSE 50 + o_custkey % 8 END AS INT) AS b",
)


def _lab(name: str, source: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """CTEs ending in ``name``: ``source`` with its colour in 8-bit Lab as ``cl, ca, cb``."""
    line = lambda v: f"CASE WHEN {v} / 255.0::DOUBLE > 0.04045::DOUBLE THEN pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {v} / 255.0::DOUBLE / 12.92::DOUBLE END"
    mix = lambda row: " + ".join(f"{m!r}::DOUBLE * {v}" for m, v in zip(row, ("lr", "lg", "lb")))
    root = lambda v: f"CASE WHEN {v} > 0.008856::DOUBLE THEN pow({v}, {1 / 3!r}::DOUBLE) ELSE 7.787::DOUBLE * {v} + {16.0 / 116.0!r}::DOUBLE END"
    whole = lambda v: f"greatest(0.0, least(255.0, floor({v} + 0.5::DOUBLE)))::DOUBLE"
    return f"""{name}_1 AS (SELECT *, {line(r)} AS lr, {line(g)} AS lg, {line(b)} AS lb FROM {source}),
{name}_2 AS (SELECT *, {mix(X.XYZ[0])} AS tx, {mix(X.XYZ[1])} AS ty, {mix(X.XYZ[2])} AS tz FROM {name}_1), {name}_3 AS (SELECT *, {root('tx')} AS fx, {root('ty')} AS fy, {root('tz')} AS fz FROM {name}_2),
{name} AS (SELECT * EXCLUDE (lr, lg, lb, tx, ty, tz, fx, fy, fz), {whole("CASE WHEN ty > 0.008856::DOUBLE THEN 116.0::DOUBLE * fy - 16.0::DOUBLE ELSE 903.3::DOUBLE * ty END * 255.0::DOUBLE / 100.0::DOUBLE")} AS cl, {whole('500.0::DOUBLE * (fx - fy) + 128.0::DOUBLE')} AS ca, {whole('200.0::DOUBLE * (fy - fz) + 128.0::DOUBLE')} AS cb FROM {name}_3)"""


def _lloyd(name: str, bins: str, key: str) -> str:
    """CTEs ending in ``name``: counted points ``bins`` (key, x, y, z, n, k of 1 to 3) with their ``cluster``."""
    away = lambda i: f"(x - x{i}) * (x - x{i}) + (y - y{i}) * (y - y{i}) + (z - z{i}) * (z - z{i})"
    pick = "first({'x': x, 'y': y, 'z': z} ORDER BY %s n DESC, x, y, z)"
    far = lambda d: pick % f"n * ({d}) DESC,"
    out = [
        f"{name}_a AS (SELECT {key}, any_value(k) AS k, {pick % ''} AS p FROM {bins} GROUP BY {key}), {name}_b AS (SELECT {key}, k, p.x AS x0, p.y AS y0, p.z AS z0 FROM {name}_a)",
        f"{name}_c AS (SELECT {key}, {far(away(0))} AS p FROM {bins} JOIN {name}_b USING ({key}) GROUP BY {key}), {name}_d AS (SELECT {name}_b.*, p.x AS x1, p.y AS y1, p.z AS z1 FROM {name}_b JOIN {name}_c USING ({key}))",
        f"{name}_e AS (SELECT {key}, {far(f'least({away(0)}, {away(1)})')} AS p FROM {bins} JOIN {name}_d USING ({key}) GROUP BY {key})",
        f"{name}_m0 AS (SELECT {key}, k, x0::DOUBLE AS x0, y0::DOUBLE AS y0, z0::DOUBLE AS z0, CASE WHEN k > 1 THEN x1::DOUBLE END AS x1, CASE WHEN k > 1 THEN y1::DOUBLE END AS y1, CASE WHEN k > 1 THEN z1::DOUBLE END AS z1, CASE WHEN k > 2 THEN p.x::DOUBLE END AS x2, CASE WHEN k > 2 THEN p.y::DOUBLE END AS y2, CASE WHEN k > 2 THEN p.z::DOUBLE END AS z2 FROM {name}_d JOIN {name}_e USING ({key}))",
    ]
    # the centres are rewritten once a round: labels by the nearest, then means
    for r in range(W.ROUNDS + 1):
        d = [f"coalesce({away(i)}, 1e300)" for i in range(3)]
        label = f"CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} THEN 0 WHEN {d[1]} <= {d[2]} THEN 1 ELSE 2 END"
        keep = "b.* EXCLUDE (k)"
        out.append(f"{name}_l{r} AS (SELECT {keep}, m.* EXCLUDE ({key}), {label} AS cluster FROM {bins} b JOIN {name}_m{r} m USING ({key}))")
        means = ", ".join(f"coalesce(sum(n * {c}) FILTER (WHERE cluster = {i})::DOUBLE / sum(n) FILTER (WHERE cluster = {i})::DOUBLE, any_value({c}{i})) AS {c}{i}" for i in range(3) for c in "xyz")
        out.append(f"{name}_m{r + 1} AS (SELECT {key}, any_value(k) AS k, {means} FROM {name}_l{r} GROUP BY {key})")
    drop = ", ".join(f"{c}{i}" for i in range(3) for c in "xyz")
    return ",\n".join([*out[:-1], f"{name} AS (SELECT * EXCLUDE ({drop}) FROM {name}_l{W.ROUNDS})"])


_R = lambda c: f"floor({c} * 10000 + 0.5) / 10000 AS {c}"
_TURF = f"""turf AS {duck('orders', TURF)}, {_lab('tl', 'turf')},
tb AS (SELECT match_id, floor(cl / 4)::INT AS x, floor(ca / 4)::INT AS y, floor(cb / 4)::INT AS z, count(*) AS n, sum(cl)::DOUBLE AS sl, sum(ca)::DOUBLE AS sa, sum(cb)::DOUBLE AS sb FROM tl GROUP BY ALL),
tk AS (SELECT *, least(3, greatest(1, floor(sum(n) OVER (PARTITION BY match_id) / 50)))::INT AS k, sum(n) OVER (PARTITION BY match_id) AS total FROM tb), {_lloyd('tc', 'tk', 'match_id')},
pal0 AS (SELECT match_id, cluster, sum(n) AS n, sum(sl) / sum(n) AS l, sum(sa) / sum(n) AS a, sum(sb) / sum(n) AS b, sum(n)::DOUBLE / any_value(total)::DOUBLE AS share FROM tc GROUP BY match_id, cluster),
pal AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, cluster) AS place FROM pal0 WHERE share >= 0.08::DOUBLE)"""


@query(f"WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), {_lab('d', 'c')} SELECT p_partkey, cl AS l, ca AS a, cb AS b_ FROM d")
def q_rgb_to_lab(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.struct((F.col("p_partkey") * 37 % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.col("p_partkey") * 13 % 256).alias("b")).alias("c"))
    return p.select("p_partkey", X.rgb_to_lab(F.col("c")).alias("c")).select("p_partkey", "c.l", "c.a", F.col("c.b").alias("b_"))


@query(
    f"""WITH turf AS {duck('orders', TURF)}, m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM turf),
t AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60 * (g - b)::DOUBLE / d WHEN v = g THEN 120 + 60 * (b - r)::DOUBLE / d ELSE 240 + 60 * (r - g)::DOUBLE / d END AS turn, CASE WHEN v = 0 THEN 0.0 ELSE round_even(d * 255::DOUBLE / v, 0) END AS s FROM m),
h AS (SELECT *, round_even(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2, 0) % 180 AS h FROM t),
f AS (SELECT match_id, frame_index, median(r) AS r, median(g) AS g, median(b) AS b FROM h WHERE h BETWEEN 32 AND 95 AND s >= 40 AND v >= 40 GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT match_id, floor(median(r)) AS r, floor(median(g)) AS g, floor(median(b)) AS b FROM f GROUP BY match_id), {_lab('o', 'c')} SELECT match_id, cl AS l, ca AS a, cb AS b FROM o"""
)
def q_pitch_reference(spark, sf_dir):
    return W.pitch_reference(project(spark, sf_dir, "orders", TURF))


@query(f"WITH {_TURF} SELECT match_id, place, {_R('l')}, {_R('a')}, {_R('b')}, {_R('share')} FROM pal")
def q_pitch_palette(spark, sf_dir):
    p = W.pitch_palette(project(spark, sf_dir, "orders", TURF))
    return p.select("match_id", F.col("place").cast("long").alias("place"), *[X.rounded(F.col(c)).alias(c) for c in ("l", "a", "b", "share")])


_AWAY = "(SELECT min(sqrt((cl - pal.l) * (cl - pal.l) + (ca - pal.a) * (ca - pal.a) + (cb - pal.b) * (cb - pal.b))) FROM pal WHERE pal.match_id = {0}.match_id)"
_STAND = f"""{_TURF}, px AS (SELECT match_id, crop_id, r, g, b, count(*) AS n FROM {duck('lineitem', SHIRTS)} GROUP BY ALL), {_lab('pl', 'px')},
aw AS (SELECT *, {_AWAY.format('pl')} > 26.0 AS away FROM pl), sz AS (SELECT *, sum(n) OVER (PARTITION BY crop_id) AS size, coalesce(sum(n) FILTER (WHERE away) OVER (PARTITION BY crop_id), 0) AS kept FROM aw),
kp AS (SELECT match_id, crop_id, r AS x, g AS y, b AS z, n, kept AS total, CASE WHEN kept >= 60 THEN 3 ELSE 2 END AS k FROM sz WHERE away AND kept >= greatest(8, floor(0.12::DOUBLE * size)) AND kept >= 12), {_lloyd('sc', 'kp', 'crop_id')},
md AS (SELECT any_value(match_id) AS match_id, crop_id, cluster, any_value(total) AS total, count(*) AS n, median(x) AS r, median(y) AS g, median(z) AS b FROM (SELECT sc.*, unnest(range(n)) FROM sc) GROUP BY crop_id, cluster),
mf AS (SELECT *, floor(r) AS fr, floor(g) AS fg, floor(b) AS fb FROM md WHERE n >= 0.12::DOUBLE * total AND n >= 8), {_lab('ml', 'mf', 'fr', 'fg', 'fb')},
so AS (SELECT *, {_AWAY.format('ml')} * sqrt(n::DOUBLE / total::DOUBLE) AS score FROM ml), rk AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, cluster) AS rk FROM so),
sec AS (SELECT o.*, row_number() OVER (PARTITION BY o.crop_id ORDER BY o.rk) AS nth FROM rk o JOIN rk f ON f.crop_id = o.crop_id AND f.rk = 1 WHERE o.rk > 1 AND (sqrt((o.ca - f.ca) * (o.ca - f.ca) + (o.cb - f.cb) * (o.cb - f.cb)) > 60 OR abs(o.cl - f.cl) > 120)),
stand AS (SELECT match_id, crop_id, 1 AS place, r, g, b, score, cl, ca, cb FROM rk WHERE rk = 1 UNION ALL SELECT match_id, crop_id, 2, r, g, b, score, cl, ca, cb FROM sec WHERE nth = 1)"""


def _palette(spark, sf_dir):
    return W.pitch_palette(project(spark, sf_dir, "orders", TURF))


@query(f"WITH {_STAND} SELECT match_id, crop_id, place::BIGINT AS place, r, g, b, {_R('score')} FROM stand")
def q_standout_colours(spark, sf_dir):
    s = W.standout_colours(project(spark, sf_dir, "lineitem", SHIRTS), _palette(spark, sf_dir))
    return s.select("match_id", "crop_id", F.col("place").cast("long").alias("place"), "r", "g", "b", X.rounded(F.col("score")).alias("score"))


@query(
    f"""WITH {_STAND}, rd AS (SELECT match_id, crop_id, cl::INT AS x, ca::INT AS y, cb::INT AS z FROM stand WHERE place = 1), rb AS (SELECT *, 2 AS k FROM (SELECT match_id, x, y, z, count(*) AS n FROM rd GROUP BY ALL) WHERE match_id IN (SELECT match_id FROM rd GROUP BY match_id HAVING count(*) >= 4)),
{_lloyd('rc', 'rb', 'match_id')}, sd AS (SELECT match_id, cluster, row_number() OVER (PARTITION BY match_id ORDER BY sum(n) DESC, cluster) - 1 AS team, count(*) OVER (PARTITION BY match_id) AS sides FROM rc GROUP BY match_id, cluster)
SELECT rd.match_id, rd.crop_id, team FROM rd JOIN rc USING (match_id, x, y, z) JOIN sd ON sd.match_id = rc.match_id AND sd.cluster = rc.cluster WHERE sides = 2"""
)
def q_lab_kits(spark, sf_dir):
    return W.lab_kits(W.standout_colours(project(spark, sf_dir, "lineitem", SHIRTS), _palette(spark, sf_dir))).withColumn("team", F.col("team").cast("long"))


@query()
def q_kit_swatches(spark, sf_dir):
    """The colours of each crop's supplier, as a kit."""
    s = W.standout_colours(project(spark, sf_dir, "lineitem", SHIRTS), _palette(spark, sf_dir))
    return W.swatches(s.withColumn("kit", F.col("crop_id") % 20), "match_id", "kit").select("match_id", "kit", F.array_join("hexes", ",").alias("hexes"))


@query()
def q_kit_vote(spark, sf_dir):
    v = W.kit_vote(project(spark, sf_dir, "lineitem", SHIRTS), _palette(spark, sf_dir))
    return v.select("match_id", "team", "hex", F.array_join("hexes", ",").alias("hexes"), "n_crops")
