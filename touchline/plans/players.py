"""Queries over tracks, moments and camera maps, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import attribution as A
from touchline.operators import clips as L
from touchline.operators import moments as M
from touchline.operators import pitch as P
from touchline.operators import tracks as T
from touchline.sources.projections import BOXES, duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_R = lambda c, n=4: f"floor(({c}) * {10**n} + 0.5) / {10**n}"
TRACKS = (
    "user_id % 16 AS match_id", "user_id AS track_id", "event_id AS frame_index", "event_id * 40 AS t_ms", "CAST((user_id * 37 + event_id) % 640 AS DOUBLE) AS x", "CAST((user_id * 53 + event_id) % 360 AS DOUBLE) AS y",
    "CAST(20 + user_id % 40 AS DOUBLE) AS height", "CASE WHEN event_type <> 'error' THEN CAST((event_id * 7 + user_id) % 180 AS DOUBLE) END AS h", "CAST(event_id % 200 AS DOUBLE) AS s", "CAST(event_id % 250 AS DOUBLE) AS v",
)
ASKED = ("o_custkey % 16 AS match_id", "o_orderkey AS point_id", "o_orderkey * 13 % 40000 AS t_ms", "CAST(o_custkey * 7 % 640 AS DOUBLE) AS x", "CAST(o_orderkey * 3 % 360 AS DOUBLE) AS y", "o_orderkey * 13 % 40000 + 1500 AS to_ms")
_T, _A = f"t AS {duck('events', TRACKS)}", f"a AS {duck('orders', ASKED)}"


@query(f"WITH {_T} SELECT match_id, track_id, count(*) AS n_points, min(t_ms) / 1000.0::DOUBLE AS start_sec, max(t_ms) / 1000.0::DOUBLE AS end_sec, (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS duration_sec FROM t GROUP BY ALL")
def q_track_summary(spark, sf_dir):
    return T.summaries(project(spark, sf_dir, "events", TRACKS))


@query(f"WITH {_T}, s AS (SELECT match_id, track_id, count(*) AS n, (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS d FROM t GROUP BY ALL HAVING count(*) >= 6 AND max(t_ms) - min(t_ms) >= 20000) SELECT match_id, track_id, row_number() OVER (PARTITION BY match_id ORDER BY track_id) - 1 AS number FROM s")
def q_lasting_tracks(spark, sf_dir):
    return T.lasting(project(spark, sf_dir, "events", TRACKS), 6, 20.0).select("match_id", "track_id", "number")


_NEAR = lambda at, extra="": f"(SELECT a.match_id, a.point_id, t.track_id, arg_min({{'x': t.x, 'y': t.y, 'h': t.height, 't': t.t_ms}}, {{'d': abs(t.t_ms - a.{at}), 't': t.t_ms}}) AS p FROM a JOIN t ON t.match_id = a.match_id AND abs(t.t_ms - a.{at}) <= 500 {extra} GROUP BY ALL)"
_LOC = f"""{_T}, {_A}, n AS {_NEAR('t_ms')}, hit AS (SELECT n.match_id, n.point_id, track_id FROM n JOIN a ON a.point_id = n.point_id WHERE sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) <= 1.5::DOUBLE * greatest(p.h, 1.0) / 1.75::DOUBLE),
loc AS (SELECT match_id, point_id, min(track_id) AS track_id FROM hit GROUP BY ALL HAVING count(*) = 1)"""


@query(f"WITH {_LOC} SELECT * FROM loc")
def q_locate(spark, sf_dir):
    return T.locate(project(spark, sf_dir, "orders", ASKED), project(spark, sf_dir, "events", TRACKS))


@query(f"WITH {_LOC}, n2 AS {_NEAR('to_ms')} SELECT loc.match_id, loc.point_id, p.x AS x, p.y AS y, p.t AS t_ms FROM loc JOIN n2 USING (match_id, point_id, track_id)")
def q_carry(spark, sf_dir):
    return T.carry(project(spark, sf_dir, "orders", ASKED), project(spark, sf_dir, "events", TRACKS))


_Q = "q AS (SELECT user_id % 16 AS match_id, user_id AS track_id, event_id AS point_id, event_id * 40 + 400 + event_id % 300 AS t_ms FROM events)"


@query(
    f"""WITH {_T}, {_Q}, w AS (SELECT q.match_id, q.track_id, q.point_id, q.t_ms, max(t.t_ms) FILTER (WHERE t.t_ms <= q.t_ms) AS t0, min(t.t_ms) FILTER (WHERE t.t_ms >= q.t_ms) AS t1 FROM q JOIN t USING (match_id, track_id) GROUP BY ALL),
v AS (SELECT w.*, b.x AS x0, b.y AS y0, e.x AS x1, e.y AS y1 FROM w LEFT JOIN t b ON b.match_id = w.match_id AND b.track_id = w.track_id AND b.t_ms = t0 LEFT JOIN t e ON e.match_id = w.match_id AND e.track_id = w.track_id AND e.t_ms = t1),
f AS (SELECT *, CASE WHEN t1 > t0 THEN (t_ms - t0)::DOUBLE / (t1 - t0) ELSE 0 END AS k FROM v)
SELECT match_id, track_id, point_id, {_R("CASE WHEN t0 = t_ms THEN x0 WHEN t0 IS NULL AND t1 - t_ms < 400 THEN x1 WHEN t1 IS NULL AND t_ms - t0 < 400 THEN x0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN x0 + k * (x1 - x0) END")} AS x,
{_R("CASE WHEN t0 = t_ms THEN y0 WHEN t0 IS NULL AND t1 - t_ms < 400 THEN y1 WHEN t1 IS NULL AND t_ms - t0 < 400 THEN y0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN y0 + k * (y1 - y0) END")} AS y FROM f"""
)
def q_track_position(spark, sf_dir):
    q = project(spark, sf_dir, "events", ("user_id % 16 AS match_id", "user_id AS track_id", "event_id AS point_id", "event_id * 40 + 400 + event_id % 300 AS t_ms"))
    return T.position_at(q, project(spark, sf_dir, "events", TRACKS)).select("match_id", "track_id", "point_id", *[X.rounded(F.col(c)).alias(c) for c in "xy"])


@query(
    f"""WITH {_T}, tap AS (SELECT user_id % 16 AS match_id, user_id AS track_id, min(event_id) AS point_id, (avg(event_id) * 40)::BIGINT AS tap_ms FROM events GROUP BY ALL),
m AS (SELECT tap.*, t.t_ms, abs(t.t_ms - tap_ms) AS gap FROM tap JOIN t USING (match_id, track_id)), n AS (SELECT *, count(*) FILTER (WHERE gap <= 9000) OVER (PARTITION BY match_id, track_id) AS ins, row_number() OVER (PARTITION BY match_id, track_id ORDER BY gap, t_ms) AS near FROM m),
k AS (SELECT *, count(*) OVER (PARTITION BY match_id, track_id) AS n, row_number() OVER (PARTITION BY match_id, track_id ORDER BY t_ms) - 1 AS i FROM n WHERE CASE WHEN ins < 3 THEN near <= 6 ELSE gap <= 9000 END)
SELECT match_id, track_id, point_id, t_ms FROM k WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda j: floor(j * n / 8.0::DOUBLE)::BIGINT), i)"""
)
def q_tap_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    taps = e.groupBy((F.col("user_id") % 16).alias("match_id"), F.col("user_id").alias("track_id")).agg(F.min("event_id").alias("point_id"), F.round(F.avg("event_id") * 40).cast("long").alias("tap_ms"))
    return T.tap_window(taps, project(spark, sf_dir, "events", TRACKS), 9000)


@query(
    f"""WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY match_id, track_id) AS n, row_number() OVER (PARTITION BY match_id, track_id ORDER BY t_ms, frame_index) AS i FROM t WHERE h IS NOT NULL), k AS (SELECT *, greatest(1, floor(n * 0.4::DOUBLE)) AS m FROM n),
g AS (SELECT match_id, track_id, max(n) AS n, {', '.join(f"list_sort(list({c}) FILTER (WHERE {w}))[len(list({c}) FILTER (WHERE {w})) // 2 + 1] AS {p}{c}" for p, w in (("e", "i <= m"), ("l", "i > n - m")) for c in "hsv")} FROM k GROUP BY ALL)
SELECT match_id, track_id, n >= 4 AND sqrt(4 * pow(CASE WHEN abs(eh - lh) > 90 THEN 180 - abs(eh - lh) ELSE abs(eh - lh) END, 2) + pow(es - ls, 2) + 0.25 * pow(ev - lv, 2)) > 55 AS switched FROM g"""
)
def q_colour_flip(spark, sf_dir):
    return T.colour_flips(project(spark, sf_dir, "events", TRACKS))


SIDE = (
    "user_id % 8 AS match_id", "user_id % 24 AS track_id", "CAST((event_id - event_id % 8) / 8 AS BIGINT) * 100 AS t_ms", "CAST(60 * (user_id % 8) + CASE WHEN user_id % 24 >= 16 THEN 300 ELSE 0 END + event_id % 9 AS DOUBLE) AS x", "CAST(100 + event_id % 7 AS DOUBLE) AS y",
    "CAST(60 + event_id % 5 + CASE WHEN user_id % 8 = 3 AND user_id % 24 >= 8 THEN 60 ELSE 0 END AS DOUBLE) AS h", "CAST(100 + user_id % 3 AS DOUBLE) AS s", "CAST(100 + user_id % 5 AS DOUBLE) AS v",
)
_GAP = lambda a, b: f"sqrt(4 * pow(CASE WHEN abs({a}h - {b}h) > 90 THEN 180 - abs({a}h - {b}h) ELSE abs({a}h - {b}h) END, 2) + pow({a}s - {b}s, 2) + 0.25 * pow({a}v - {b}v, 2))"


@query(
    f"""WITH p AS {duck('events', SIDE)}, k AS (SELECT match_id, track_id, median(h) AS h, median(s) AS s, median(v) AS v FROM p GROUP BY ALL),
m AS (SELECT a.match_id, a.track_id, b.track_id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.match_id = b.match_id AND a.t_ms = b.t_ms AND a.track_id < b.track_id),
g AS (SELECT match_id, track_id, other, count(*) AS n, list_sort(list(d))[len(list(d)) // 2 + 1] AS d FROM m GROUP BY ALL)
SELECT g.match_id, g.track_id, g.other FROM g JOIN k a ON a.match_id = g.match_id AND a.track_id = g.track_id JOIN k b ON b.match_id = g.match_id AND b.track_id = g.other WHERE n >= 3 AND d <= 0.035::DOUBLE * 640 AND {_GAP('a.', 'b.')} <= 60"""
)
def q_same_player(spark, sf_dir):
    """Two tracks of each match run side by side, those of every eighth match in unlike kits."""
    return T.same_player(project(spark, sf_dir, "events", SIDE), 640.0)


@query()
def q_merged_tracks(spark, sf_dir):
    """Parallel tracks merged until no pair is left; a match's tracks at a time, one point each."""
    p = project(spark, sf_dir, "events", SIDE).groupBy("match_id", "track_id", "t_ms").agg(*[F.avg(c).alias(c) for c in "xyhsv"])
    return T.merge_parallel(p, 640.0).groupBy("match_id", "track_id", "player").agg(F.count("*").alias("n_points"), F.count_if("kept").alias("n_kept"))


@query(
    f"""WITH b AS {duck('lineitem', BOXES)}, f AS (SELECT (frame_index - frame_index % 2) / 2 AS pair_id, CASE frame_index % 2 WHEN 0 THEN 'a' ELSE 'b' END AS side, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b),
n AS (SELECT a.pair_id, a.x, a.y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM (SELECT * FROM f WHERE side = 'a') a JOIN (SELECT * FROM f WHERE side = 'b') b ON a.pair_id = b.pair_id GROUP BY ALL)
SELECT pair_id::BIGINT AS pair_id, {_R('list_sort(list(d))[len(list(d)) // 2 + 1]')} AS moved FROM n GROUP BY pair_id"""
)
def q_displacement(spark, sf_dir):
    b = project(spark, sf_dir, "lineitem", BOXES)
    x, y = X.centre(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    f = b.select(((F.col("frame_index") - F.col("frame_index") % 2) / 2).cast("long").alias("pair_id"), F.when(F.col("frame_index") % 2 == 0, "a").otherwise("b").alias("side"), x.alias("x"), y.alias("y"))
    return T.displacement(f).select("pair_id", X.rounded(F.col("moved")).alias("moved"))


@query()
def q_broken_tracks(spark, sf_dir):
    pieces = project(spark, sf_dir, "orders", (
        "o_custkey % 50 AS match_id", "o_orderkey AS track_id", "o_orderkey / 10.0D AS start_sec", "o_orderkey / 10.0D + 0.3D AS end_sec", "CAST(o_custkey * 13 % 640 AS DOUBLE) AS x0", "CAST(o_custkey % 360 AS DOUBLE) AS y0",
        "CAST(o_custkey * 13 % 640 + 3 AS DOUBLE) AS x1", "CAST(o_custkey % 360 AS DOUBLE) AS y1", "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 180 AS DOUBLE) END AS h", "100.0D AS s", "100.0D AS v",
    ))
    return T.chain_broken(pieces, 640.0)


@query()
def q_seed_tracks(spark, sf_dir):
    dets = project(spark, sf_dir, "lineitem", (
        "CAST((l_orderkey - l_orderkey % 64) / 64 AS BIGINT) AS clip_id", "CAST(l_orderkey AS BIGINT) AS frame_index", "CAST(l_linenumber AS BIGINT) AS det_id", "CAST(l_linenumber * 80 + l_orderkey % 17 AS DOUBLE) AS x", "CAST(l_linenumber * 40 + l_orderkey % 11 AS DOUBLE) AS y",
        "CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_linenumber * 20 % 180 AS DOUBLE) END AS h", "150.0D AS s", "120.0D AS v",
    ))
    return T.seed_tracks(dets, 640.0)


@query(
    """WITH s AS (SELECT user_id AS match_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 6 AS o, event_type <> 'error' AS found FROM events), k AS (SELECT *, sum(CASE WHEN found THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, o < 0 ORDER BY abs(o)) AS lost FROM s) SELECT match_id, o AS "offset", found FROM k WHERE lost = 0"""
)
def q_until_loss(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = e.select(F.col("user_id").alias("match_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 6).alias("offset"), (F.col("event_type") != "error").alias("found"))
    return T.until_loss(steps)


_FRAC = "CASE WHEN reroll <= 0 THEN least(0.95::DOUBLE, greatest(0.03::DOUBLE, base)) ELSE 0.03::DOUBLE + ((base + reroll * 0.6180339887498949::DOUBLE) - floor(base + reroll * 0.6180339887498949::DOUBLE)) * (0.95::DOUBLE - 0.03::DOUBLE) END"


@query(
    f"""WITH v AS (SELECT c_custkey AS match_id, (c_custkey % 7)::INT AS reroll, (c_custkey * 37 % 6000)::DOUBLE AS d FROM customer), s AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM v), b AS (SELECT *, [0.10::DOUBLE, 0.35, 0.60, 0.85][slot + 1] AS base FROM s)
SELECT match_id, slot, CASE WHEN d > 0 THEN floor({_FRAC} * d * 100 + 0.5) / 100 ELSE 0.0 END AS t_sec FROM b"""
)
def q_slot_moments(spark, sf_dir):
    return M.slot_moments(project(spark, sf_dir, "customer", ("c_custkey AS match_id", "CAST(c_custkey % 7 AS INT) AS reroll", "CAST(c_custkey * 37 % 6000 AS DOUBLE) AS duration_sec")))


# every part is a moment near a slot of a match
MOMENTS = (
    "p_partkey % 25 AS match_id", "CAST(p_size % 4 AS INT) AS slot", "p_partkey AS place", "CAST(p_partkey * 7 % 1000 AS DOUBLE) AS t_sec", "CAST(p_partkey % 12 AS INT) AS n_players", "CAST(p_partkey * 3 % 50 AS DOUBLE) / 100.0D AS median_height_share",
    "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 <> 0 END AS kit_visible", "CAST(p_partkey % 40 AS DOUBLE) / 100.0D AS grass", "CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 20 AS DOUBLE) END AS moved", "CAST(p_partkey * 11 % 100 AS DOUBLE) / 100.0D AS cut_distance",
)
_FLAGS = f"""m AS {duck('part', MOMENTS)}, fl AS (SELECT *, n_players = 0 OR median_height_share > 0.35::DOUBLE AS is_zoom, n_players = 0 OR NOT coalesce(kit_visible, true) AS no_kit, n_players = 0 OR (n_players >= 6 AND grass < 0.12::DOUBLE) AS is_crowd,
n_players = 0 OR (n_players >= 6 AND coalesce(moved < 6, false)) AS is_static, n_players >= 6 AND cut_distance > 0.4::DOUBLE AS is_cut FROM m),
sc AS (SELECT *, CASE WHEN n_players = 0 THEN -1e9 ELSE n_players - (is_zoom::INT * 6 + no_kit::INT * 3 + is_crowd::INT * 8 + is_static::INT * 5 + is_cut::INT * 5) END::DOUBLE AS score FROM fl)"""


@query(f"WITH {_FLAGS} SELECT place, is_zoom, no_kit, is_crowd, is_static, is_cut, score, n_players >= 6 AND NOT is_zoom AND NOT is_crowd AND NOT is_static AND NOT is_cut AS good FROM sc")
def q_scene_score(spark, sf_dir):
    f = M.scene_flags(project(spark, sf_dir, "part", MOMENTS))
    return f.select("place", "is_zoom", "no_kit", "is_crowd", "is_static", "is_cut", F.col("score").cast("double").alias("score"), M.qualifies().alias("good"))


@query(
    f"""WITH {_FLAGS}, av AS (SELECT c_custkey % 25 AS match_id, (c_custkey * 31 % 1000)::DOUBLE AS t FROM customer WHERE c_nationkey = 3), n AS (SELECT *, EXISTS (SELECT 1 FROM av WHERE av.match_id = sc.match_id AND abs(av.t - sc.t_sec) < 8) AS near FROM sc),
g AS (SELECT *, n_players >= 6 AND NOT is_zoom AND NOT is_crowd AND NOT is_static AND NOT is_cut AND NOT near AS good FROM n)
SELECT match_id, slot, coalesce(arg_min(t_sec, place) FILTER (WHERE good), arg_max(t_sec, {{'v': score - CASE WHEN near THEN 1e6 ELSE 0 END, 'p': -place}})) AS t_sec FROM g GROUP BY ALL"""
)
def q_pick_moment(spark, sf_dir):
    avoid = project(spark, sf_dir, "customer", ("c_custkey % 25 AS match_id", "CAST(c_custkey * 31 % 1000 AS DOUBLE) AS t_sec", "c_nationkey")).filter("c_nationkey = 3").drop("c_nationkey")
    return M.pick_moments(M.nearby(M.scene_flags(project(spark, sf_dir, "part", MOMENTS)), avoid))


@query(
    "WITH v AS (SELECT p_partkey, (p_size % 30)::DOUBLE AS r FROM part), o AS (SELECT p_partkey, unnest(range(0, 1 + floor((r + 1e-6) / 5)::BIGINT)) AS k FROM v) SELECT p_partkey, (CASE WHEN k = 0 THEN 1 ELSE 2 * k END)::INT - 1 AS place, 5.0::DOUBLE * k AS off FROM o UNION ALL SELECT p_partkey, (2 * k)::INT, -5.0::DOUBLE * k FROM o WHERE k > 0"
)
def q_outward_offsets(spark, sf_dir):
    v = project(spark, sf_dir, "part", ("p_partkey", "CAST(p_size % 30 AS DOUBLE) AS r"))
    return v.select("p_partkey", F.posexplode(M.offsets_outward(F.col("r"))).alias("place", "off"))


@query()
def q_shuffle_history(spark, sf_dir):
    shown = project(spark, sf_dir, "events", ("user_id AS match_id", "CAST(event_id % 4 AS INT) AS slot", "event_id AS seq", "CAST(event_id * 97 % 3000 AS DOUBLE) AS t_sec"))
    return M.shuffle_history(shown).select("match_id", "slot", F.array_join("history", ",").alias("history"))


@query(
    f"""WITH b AS {duck('lineitem', BOXES)} SELECT frame_index, det_id FROM b WHERE conf >= CASE WHEN class_id = 0 THEN 0.35::DOUBLE * 0.4::DOUBLE ELSE 0.4::DOUBLE END"""
)
def q_confident_boxes(spark, sf_dir):
    return A.confident(project(spark, sf_dir, "lineitem", BOXES), 0.4).select("frame_index", "det_id")


_GATE = f"b AS {duck('lineitem', BOXES)}, d AS (SELECT *, (det_id * 13 % 60)::DOUBLE AS px, CASE WHEN frame_index % 3 <> 0 THEN (frame_index % 17)::DOUBLE END AS m FROM b)"


@query(f"WITH {_GATE} SELECT frame_index, det_id, px <= 25 OR m IS NULL OR m <= 8 AS near FROM d")
def q_metric_gate(spark, sf_dir):
    b = project(spark, sf_dir, "lineitem", BOXES)
    return b.select("frame_index", "det_id", A.metric_gate((F.col("det_id") * 13 % 60).cast("double"), F.when(F.col("frame_index") % 3 != 0, (F.col("frame_index") % 17).cast("double"))).alias("near"))


# a camera that pans and zooms a little at every frame, in shots of 64 frames
STEPS = ("user_id % 8 AS match_id", "CAST((event_id - event_id % 512) / 512 AS BIGINT) AS shot_id", "event_id AS frame_index", "CASE WHEN event_id % 9 <> 0 THEN array(1.0D + event_id % 3 / 1000.0D, 0.0D, CAST(event_id % 5 - 2 AS DOUBLE), 0.0D, 1.0D, CAST(event_id % 3 - 1 AS DOUBLE), 0.0D, 0.0D, 1.0D) END AS step")


@query()
def q_camera_matrix(spark, sf_dir):
    return L.compose_steps(project(spark, sf_dir, "events", STEPS)).select("match_id", "shot_id", "frame_index", F.transform("matrix", X.rounded).alias("matrix"))


@query(
    """WITH t AS (SELECT user_id % 8 AS match_id, event_id AS f, (event_id - event_id % 512) / 512 AS shot, 1 + (event_id % 7)::DOUBLE / 100 AS z, (event_id % 11)::DOUBLE AS tx, (event_id % 13)::DOUBLE AS ty FROM events),
q AS (SELECT o_custkey % 8 AS match_id, o_orderkey AS pair_id, o_orderkey * 7 % 10000 AS a, o_orderkey * 7 % 10000 + o_custkey % 40 AS b FROM orders),
n AS (SELECT q.match_id, pair_id, arg_min({'s': shot, 'z': z, 'x': tx, 'y': ty}, {'d': abs(f - a), 'f': f}) AS u, arg_min({'s': shot, 'z': z, 'x': tx, 'y': ty}, {'d': abs(f - b), 'f': f}) AS v FROM q JOIN t USING (match_id) GROUP BY ALL)
SELECT match_id, pair_id, floor(v.z / u.z * 10000 + 0.5) / 10000 AS zoom, floor((v.x - u.x * v.z / u.z) * 10000 + 0.5) / 10000 AS dx, floor((v.y - u.y * v.z / u.z) * 10000 + 0.5) / 10000 AS dy FROM n WHERE u.s = v.s"""
)
def q_relative_map(spark, sf_dir):
    track = project(spark, sf_dir, "events", ("user_id % 8 AS match_id", "event_id AS frame_index", "CAST((event_id - event_id % 512) / 512 AS BIGINT) AS shot_id", "array(1 + CAST(event_id % 7 AS DOUBLE) / 100, 0.0D, CAST(event_id % 11 AS DOUBLE), 0.0D, 1 + CAST(event_id % 7 AS DOUBLE) / 100, CAST(event_id % 13 AS DOUBLE), 0.0D, 0.0D, 1.0D) AS matrix"))
    pairs = project(spark, sf_dir, "orders", ("o_custkey % 8 AS match_id", "o_orderkey AS pair_id", "o_orderkey * 7 % 10000 AS from_frame", "o_orderkey * 7 % 10000 + o_custkey % 40 AS to_frame"))
    m = L.relative_maps(pairs, track)
    return m.select("match_id", "pair_id", *[X.rounded(F.get("map", k)).alias(n) for n, k in (("zoom", 0), ("dx", 2), ("dy", 5))])


_H = "(2 + (p_size % 5)::DOUBLE / 10) AS k, (p_partkey % 100)::DOUBLE AS ox, (p_size)::DOUBLE AS oy, (p_partkey % 640)::DOUBLE AS ax, (p_partkey * 7 % 360)::DOUBLE AS ay, (p_partkey * 3 % 640)::DOUBLE AS bx, (p_size * 11 % 360)::DOUBLE AS by_"


@query(f"WITH p AS (SELECT p_partkey, {_H} FROM part) SELECT p_partkey, {_R('(ax - ox) / k')} AS x, {_R('(ay - oy) / k')} AS y, {_R('sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) / k')} AS d FROM p")
def q_ground_distance(spark, sf_dir):
    p = project(spark, sf_dir, "part", ("p_partkey", "array(2 + CAST(p_size % 5 AS DOUBLE) / 10, 0.0D, CAST(p_partkey % 100 AS DOUBLE), 0.0D, 2 + CAST(p_size % 5 AS DOUBLE) / 10, CAST(p_size AS DOUBLE), 0.0D, 0.0D, 1.0D) AS m", "CAST(p_partkey % 640 AS DOUBLE) AS ax", "CAST(p_partkey * 7 % 360 AS DOUBLE) AS ay", "CAST(p_partkey * 3 % 640 AS DOUBLE) AS bx", "CAST(p_size * 11 % 360 AS DOUBLE) AS by"))
    at = P.to_pitch(F.col("m"), F.col("ax"), F.col("ay"))
    return p.select("p_partkey", X.rounded(at["x"]).alias("x"), X.rounded(at["y"]).alias("y"), X.rounded(P.ground_distance(F.col("m"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("d"))


ERRORS = ("c_nationkey AS match_id", "c_custkey % 3 AS frame_index", "concat('spot', CAST(c_custkey % 9 AS STRING)) AS landmark", "CAST(c_custkey * 17 % 50 AS DOUBLE) / 10.0D AS error_px")


@query("WITH e AS (SELECT c_nationkey AS match_id, c_custkey % 3 AS f, c_custkey % 9 AS l, (c_custkey * 17 % 50)::DOUBLE / 10.0 AS e FROM customer) SELECT match_id, median(e) AS median_px, floor(sqrt(avg(e * e)) * 10000 + 0.5) / 10000 AS rms_px, 2 * count(DISTINCT l) - 5 - 2 * count(DISTINCT f) AS dof FROM e GROUP BY match_id")
def q_fit_quality(spark, sf_dir):
    return P.fit_quality(project(spark, sf_dir, "customer", ERRORS)).select("match_id", "median_px", X.rounded(F.col("rms_px")).alias("rms_px"), "dof")


@query("SELECT c_nationkey AS match_id, c_custkey % 3 AS frame_index, 'spot' || (c_custkey % 9) AS landmark, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_clicks(spark, sf_dir):
    return P.duplicate_clicks(project(spark, sf_dir, "customer", ERRORS))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'not_supplied' WHEN c_custkey % 5 = 0 THEN 'unreadable' WHEN c_custkey % 11 > 6 THEN 'quality_rejected' WHEN c_custkey % 3 = 0 THEN 'no_camera_track' WHEN c_custkey % 13 = 0 THEN 'mapper_failed' ELSE 'ok' END AS status FROM customer")
def q_calibration_status(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", P.calibration_status(k % 7 != 0, k % 5 != 0, (k % 11).cast("double"), k % 3 != 0, k % 13 != 0).alias("status"))


@query("SELECT o_custkey AS match_id, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS contacts_metric, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS contacts_pixel, floor(avg((o_orderkey % 3 <> 0)::INT::DOUBLE) * 10000 + 0.5) / 10000 AS metric_coverage FROM orders GROUP BY o_custkey")
def q_metric_coverage(spark, sf_dir):
    return P.coverage(project(spark, sf_dir, "orders", ("o_custkey AS match_id", "o_orderkey % 3 <> 0 AS measured")))


def _spots_seen(spark, sf_dir):
    """Clicks of made-up cameras, one a customer: 66 customers are a match, each clicks one of 33 spots in one of two frames.

    The camera stands behind the near touchline; spots outside its picture are not clicked."""
    k = F.col("c_custkey") - 1
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(k / 66).alias("match_id"), (k % 2).alias("frame_index"), (F.floor(k / 2) % 33).cast("int").alias("place"))
    names = F.array(*[F.lit(n) for n, *_ in P.LANDMARKS])
    spots = P.place(own.select("match_id", "frame_index", F.get(names, F.col("place")).alias("landmark")))
    m, f = F.col("match_id") % 5, F.col("frame_index")
    pan, tilt, focal = F.radians(80 + 6 * m + 8 * f), F.radians(14 + f), 620 + 20 * m
    ex, ey, ez = F.col("px") - 50 - m, F.col("py") + 14, F.lit(-9.0)
    along = F.cos(pan) * ex + F.sin(pan) * ey
    right, down, depth = F.sin(pan) * ex - F.cos(pan) * ey, -F.sin(tilt) * along - F.cos(tilt) * ez, F.cos(tilt) * along - F.sin(tilt) * ez
    x, y = 320 + focal * right / depth, 180 + focal * down / depth
    seen = spots.withColumns({"x": x, "y": y}).filter((depth > 0) & F.col("x").between(0, 640) & F.col("y").between(0, 360))
    return seen.select("match_id", "frame_index", "landmark", "x", "y")


_SPOT_ROWS = ", ".join(f"({k}, {l * P.LENGTH + dx}, {w * P.WIDTH + dy})" for k, (_, l, w, dx, dy) in enumerate(P.LANDMARKS))


@query(
    f"""WITH s(place, px, py) AS (VALUES {_SPOT_ROWS}), c AS (SELECT (c_custkey - 1) // 66 AS match_id, (c_custkey - 1) % 2 AS f, ((c_custkey - 1) // 2) % 33 AS place FROM customer),
a AS (SELECT match_id, radians(80 + 6 * (match_id % 5) + 8 * f) AS pan, radians(14 + f) AS tilt, 620 + 20 * (match_id % 5) AS focal, px::DOUBLE - 50 - match_id % 5 AS ex, py::DOUBLE + 14 AS ey FROM c JOIN s USING (place)),
d AS (SELECT match_id, focal, sin(pan) * ex - cos(pan) * ey AS r, -sin(tilt) * (cos(pan) * ex + sin(pan) * ey) + cos(tilt) * 9 AS w, cos(tilt) * (cos(pan) * ex + sin(pan) * ey) + sin(tilt) * 9 AS z FROM a)
SELECT match_id, true AS good FROM d WHERE z > 0 AND 320 + focal * r / z BETWEEN 0 AND 640 AND 180 + focal * w / z BETWEEN 0 AND 360 GROUP BY match_id HAVING count(*) >= 4"""
)
def q_camera_pose(spark, sf_dir):
    """The camera of each match with four clicks or more; it is found if the clicks are met within a pixel."""
    fitted = P.fit_poses(P.place(_spots_seen(spark, sf_dir)))
    return fitted.select("match_id", (F.col("median_px") < 1.0).alias("good"))
