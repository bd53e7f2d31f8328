"""Queries over ball trajectories and intervals, with their DuckDB statements."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from touchline.config import DEFAULT
from touchline.functions.columns import rounded
from touchline.operators import contacts as C
from touchline.operators import intervals as I
from touchline.sources.projections import POINTS, RANGES, SAMPLES, duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def samples(spark, sf_dir):
    return project(spark, sf_dir, "events", SAMPLES)


def ranges(spark, sf_dir):
    return project(spark, sf_dir, "orders", RANGES)


def points(spark, sf_dir):
    return project(spark, sf_dir, "orders", POINTS)


_S = f"s AS {duck('events', SAMPLES)}"
_R = f"r AS {duck('orders', RANGES)}"
_P = f"p AS {duck('orders', POINTS)}"
_TRACKS = f"""{_S},
tracks AS (SELECT * FROM (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS track_id FROM s) WHERE x IS NOT NULL)"""
_KIN = f"""{_TRACKS},
nodes AS (SELECT * FROM tracks WHERE detected),
sm AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY match_id, track_id) < 3 THEN x ELSE avg(x) OVER w END AS sx, CASE WHEN count(*) OVER (PARTITION BY match_id, track_id) < 3 THEN y ELSE avg(y) OVER w END AS sy
  FROM nodes WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
steps AS (SELECT *, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE AS dt_in, (lead(t_ms) OVER w - t_ms) / 1000.0::DOUBLE AS dt_out, sx - lag(sx) OVER w AS ax, sy - lag(sy) OVER w AS ay, lead(sx) OVER w - sx AS bx, lead(sy) OVER w - sy AS by_
  FROM sm WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index)),
vel AS (SELECT *, ax / dt_in AS vx_in, ay / dt_in AS vy_in, bx / dt_out AS vx_out, by_ / dt_out AS vy_out FROM steps WHERE dt_in > 0 AND dt_out > 0),
sp AS (SELECT *, sqrt(vx_in * vx_in + vy_in * vy_in) AS speed_before, sqrt(vx_out * vx_out + vy_out * vy_out) AS speed_after FROM vel),
kin0 AS (SELECT *, CASE WHEN speed_before <= 0 OR speed_after <= 0 THEN 0.0 ELSE degrees(acos(least(1.0, greatest(-1.0, (vx_in * vx_out + vy_in * vy_out) / (speed_before * speed_after))))) END AS angle_deg FROM sp),
kin1 AS (SELECT *, angle_deg >= 50 AND least(speed_before, speed_after) >= 30 AS turn, speed_before >= 30 AND speed_after <= speed_before * 0.4::DOUBLE AS stop, speed_after >= 30 AND speed_after >= speed_before * 2 AS kick, greatest(dt_in, dt_out) > 0.5 AS from_gap FROM kin0),
kin AS (SELECT *, list_filter([CASE WHEN turn THEN 'direction_change' END, CASE WHEN stop THEN 'stop' END, CASE WHEN kick THEN 'kick' END], lambda z: z IS NOT NULL) AS kinds,
  greatest(CASE WHEN turn THEN least(1.0, angle_deg / 180.0) ELSE 0 END, CASE WHEN stop THEN least(1.0, 1 - speed_after / greatest(speed_before, 1e-6)) ELSE 0 END, CASE WHEN kick THEN least(1.0, 1 - speed_before / greatest(speed_after, 1e-6)) ELSE 0 END) * (CASE WHEN from_gap THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS strength FROM kin1),
cand AS (SELECT * FROM kin WHERE len(kinds) > 0)"""
_MERGED = f"""{_KIN},
shots AS (SELECT match_id, shot_id, min(t_ms) AS f, max(t_ms) - min(t_ms) AS span FROM s GROUP BY ALL),
shifts AS (SELECT match_id, shot_id, coalesce(sum(span) OVER (PARTITION BY match_id ORDER BY shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - f AS shift FROM shots),
played AS (SELECT cand.*, (t_ms + shift)::BIGINT AS c_ms FROM cand JOIN shifts USING (match_id, shot_id)),
opened AS (SELECT *, CASE WHEN c_ms - lag(c_ms) OVER (PARTITION BY match_id ORDER BY c_ms, frame_index) <= 300 THEN 0 ELSE 1 END AS opens FROM played),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY match_id ORDER BY c_ms, frame_index) AS contact_id FROM opened),
merged AS (SELECT match_id, contact_id, arg_max(frame_index, {{'s': strength, 'f': -frame_index}}) AS frame_index, arg_max(t_ms, {{'s': strength, 'f': -frame_index}}) AS t_ms, arg_max(c_ms, {{'s': strength, 'f': -frame_index}}) AS c_ms, max(strength) AS strength,
  bool_or(from_gap) AS from_gap, count(*) AS n_merged FROM grouped GROUP BY ALL)"""
_PINGPONG = """d AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS cy, lead(x) OVER w - lag(x) OVER w AS rx, lead(y) OVER w - lag(y) OVER w AS ry,
  t_ms - lag(t_ms) OVER w AS g1, lead(t_ms) OVER w - t_ms AS g2 FROM s0 WHERE detected WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
e AS (SELECT *, sqrt(ax * ax + ay * ay) AS o, sqrt(bx * bx + cy * cy) AS q FROM d),
f AS (SELECT *, coalesce(g1 <= 600 AND g2 <= 600 AND o >= 40 AND (CASE WHEN o <= 1e-6 OR q <= 1e-6 THEN 0.0 ELSE degrees(acos(least(1.0, greatest(-1.0, (ax * bx + ay * cy) / (o * q))))) END) >= 165 AND sqrt(rx * rx + ry * ry) <= 0.35::DOUBLE * o, false) AS bad FROM e),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS run FROM f),
h AS (SELECT *, bad AND sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, run) >= 2 AS hit FROM r),
rej AS (SELECT match_id, frame_index, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS rejected FROM h WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
s AS (SELECT s0.* REPLACE (CASE WHEN coalesce(rejected, false) THEN NULL ELSE x END AS x, CASE WHEN coalesce(rejected, false) THEN NULL ELSE y END AS y, detected AND NOT coalesce(rejected, false) AS detected) FROM s0 LEFT JOIN rej USING (match_id, frame_index))"""
_PLAYED = "WITH " + _MERGED.replace(_S, _S.replace("s AS", "s0 AS", 1) + ", " + _PINGPONG, 1) + " SELECT match_id, contact_id, frame_index, n_merged, round(c_ms / 1000.0::DOUBLE, 3) AS processed_sec FROM merged"
_ZONES = f"""{_MERGED},
zo AS (SELECT *, CASE WHEN t_ms - 2000 - (lag(t_ms) OVER (PARTITION BY match_id ORDER BY t_ms, frame_index) + 2000) <= 5000 THEN 0 ELSE 1 END AS zopen FROM merged),
zg AS (SELECT *, sum(zopen) OVER (PARTITION BY match_id ORDER BY t_ms, frame_index) AS hotspot_id FROM zo),
z0 AS (SELECT match_id, hotspot_id, min(t_ms) - 2000 AS a, max(t_ms) + 2000 AS b, count(*) AS n_contacts, max(t_ms) AS last_ms FROM zg GROUP BY ALL),
zones AS (SELECT match_id, hotspot_id, greatest(0.0, a - greatest(0.0, (3000 - (b - a)) / 2.0)) / 1000.0::DOUBLE AS start_sec, (b + greatest(0.0, (3000 - (b - a)) / 2.0)) / 1000.0::DOUBLE AS end_sec, n_contacts, last_ms FROM z0)"""
_R3 = lambda c: f"floor(({c}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
_N = f"""n0 AS (SELECT match_id, greatest(0.0, least(start_sec, end_sec)) AS a, greatest(start_sec, end_sec) AS b FROM r),
nn AS (SELECT match_id, {_R3('a')} AS a, {_R3('b')} AS b FROM n0 WHERE b > a),
n1 AS (SELECT *, max(b) OVER (PARTITION BY match_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nn),
n2 AS (SELECT *, sum(CASE WHEN a <= reach + 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n1),
n AS (SELECT match_id, min(a) AS start_sec, max(b) AS end_sec FROM n2 GROUP BY match_id, g)"""
_RN = f"{_R}, {_N}"
_R4 = lambda c: f"floor({c} * 10000 + 0.5) / 10000 AS {c}"


@query(f"WITH {_ZONES} SELECT match_id, hotspot_id, start_sec, end_sec, n_contacts FROM zones")
def q_contacts_hotspots(spark, sf_dir):
    return C.hotspots(C.merge_contacts(C.candidates(samples(spark, sf_dir)))).drop("last_ms", "contact_ms")


@query(f"WITH {_S} SELECT match_id, count(*) AS n, count(*) FILTER (WHERE detected) AS n_detected, count(*) FILTER (WHERE interpolated) AS n_interpolated, count(*) FILTER (WHERE x IS NULL) AS n_missing, floor(avg(detected::INT::DOUBLE) * 10000 + 0.5) / 10000 AS detected_ratio FROM s GROUP BY match_id")
def q_traj_summary(spark, sf_dir):
    return C.summary(samples(spark, sf_dir)).withColumn("detected_ratio", rounded(F.col("detected_ratio")))


@query(f"WITH {_TRACKS} SELECT match_id, track_id, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM tracks GROUP BY ALL")
def q_split_tracks(spark, sf_dir):
    return C.split_tracks(samples(spark, sf_dir)).groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query(f"WITH {_KIN} SELECT match_id, frame_index, {_R4('sx')}, {_R4('sy')} FROM sm")
def q_smooth_ma(spark, sf_dir):
    return C.smooth(C.split_tracks(samples(spark, sf_dir)).filter("detected")).select("match_id", "frame_index", rounded(F.col("sx")).alias("sx"), rounded(F.col("sy")).alias("sy"))


@query(f"WITH {_KIN} SELECT match_id, frame_index, {_R4('speed_before')}, {_R4('speed_after')}, {_R4('angle_deg')}, from_gap FROM kin")
def q_kinematics(spark, sf_dir):
    out = C.kinematics(samples(spark, sf_dir))
    return out.select("match_id", "frame_index", *[rounded(F.col(c)).alias(c) for c in ("speed_before", "speed_after", "angle_deg")], "from_gap")


@query(f"WITH {_MERGED} SELECT match_id, contact_id, frame_index, {_R4('strength')}, from_gap, n_merged FROM merged")
def q_contact_merge(spark, sf_dir):
    return C.merge_contacts(C.candidates(samples(spark, sf_dir))).select("match_id", "contact_id", "frame_index", rounded(F.col("strength")).alias("strength"), "from_gap", "n_merged")


@query(f"WITH {_KIN} SELECT kind, count(*) AS n, count(*) FILTER (WHERE from_gap) AS n_from_gap FROM (SELECT unnest(kinds) AS kind, from_gap FROM cand) GROUP BY kind")
def q_kind_hist(spark, sf_dir):
    return C.candidates(samples(spark, sf_dir)).select(F.explode("kinds").alias("kind"), "from_gap").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("from_gap").alias("n_from_gap"))


@query(
    f"""WITH {_MERGED}, b AS (SELECT *, floor(c_ms / 30000) AS bucket FROM merged), k AS (SELECT *, row_number() OVER (PARTITION BY match_id, bucket ORDER BY strength DESC, t_ms, frame_index) AS round FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round, bucket) AS pick FROM k) SELECT match_id, contact_id, frame_index, pick FROM c WHERE pick <= 5"""
)
def q_fair_cap(spark, sf_dir):
    return C.fair_cap(C.merge_contacts(C.candidates(samples(spark, sf_dir))), 5).select("match_id", "contact_id", "frame_index", "pick")


_CAPPED = f"""{_MERGED}, du AS (SELECT match_id, (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS duration_sec FROM s GROUP BY match_id), bu AS (SELECT match_id, least(7, greatest(3, floor(4 * duration_sec / 60)))::INT AS budget FROM du),
b AS (SELECT *, floor(c_ms / 30000) AS bucket FROM merged), k AS (SELECT *, row_number() OVER (PARTITION BY match_id, bucket ORDER BY strength DESC, t_ms, frame_index) AS round FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round, bucket) AS pick FROM k)"""


@query(f"WITH {_CAPPED} SELECT match_id, contact_id, frame_index, pick FROM c JOIN bu USING (match_id) WHERE pick <= budget")
def q_candidate_budget(spark, sf_dir):
    """The budget of a match by its length, with limits small enough to bite on these tables."""
    s = samples(spark, sf_dir)
    length = s.groupBy("match_id").agg(((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("duration_sec"))
    cfg = replace(DEFAULT, max_candidates=7, max_candidates_per_min=4)
    return C.cap_candidates(C.merge_contacts(C.candidates(s)), length, cfg, least=3).select("match_id", "contact_id", "frame_index", "pick")


@query(f"WITH {_ZONES} SELECT match_id, hotspot_id, start_sec AS start, end_sec AS end_, len(ms) AS n_ticks, ms[1] / 1000.0::DOUBLE AS first_tick FROM zones JOIN (SELECT match_id, hotspot_id, list(t_ms ORDER BY t_ms) AS ms FROM zg GROUP BY ALL) USING (match_id, hotspot_id)")
def q_segments(spark, sf_dir):
    out = C.segments(C.hotspots(C.merge_contacts(C.candidates(samples(spark, sf_dir)))))
    return out.select("match_id", "hotspot_id", "start", F.col("end").alias("end_"), F.size("ticks").cast("long").alias("n_ticks"), F.get("ticks", 0).alias("first_tick"))


@query(
    f"""WITH {_ZONES}, near AS (SELECT z.*, s.t_ms AS s_ms, s.frame_index, s.x, s.y FROM zones z JOIN s ON s.match_id = z.match_id AND s.x IS NOT NULL AND s.t_ms BETWEEN z.last_ms AND z.last_ms + 6000),
o AS (SELECT *, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM near WINDOW w AS (PARTITION BY match_id, hotspot_id ORDER BY s_ms, frame_index)),
g AS (SELECT match_id, hotspot_id, min(s_ms) FILTER (WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) > 120) AS gone FROM o GROUP BY ALL)
SELECT match_id, hotspot_id, start_sec, greatest(end_sec, coalesce((gone + 2000) / 1000.0::DOUBLE, end_sec)) AS end_sec, n_contacts FROM zones LEFT JOIN g USING (match_id, hotspot_id)"""
)
def q_possession_extend(spark, sf_dir):
    s = samples(spark, sf_dir)
    return C.hotspots(C.merge_contacts(C.candidates(s)), samples=s).drop("last_ms", "contact_ms")


@query(
    f"""WITH {_S}, d AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS cy, lead(x) OVER w - lag(x) OVER w AS rx, lead(y) OVER w - lag(y) OVER w AS ry,
  t_ms - lag(t_ms) OVER w AS g1, lead(t_ms) OVER w - t_ms AS g2 FROM s WHERE detected WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
e AS (SELECT *, sqrt(ax * ax + ay * ay) AS o, sqrt(bx * bx + cy * cy) AS q FROM d),
f AS (SELECT *, coalesce(g1 <= 600 AND g2 <= 600 AND o >= 40 AND (CASE WHEN o <= 1e-6 OR q <= 1e-6 THEN 0.0 ELSE degrees(acos(least(1.0, greatest(-1.0, (ax * bx + ay * cy) / (o * q))))) END) >= 165 AND sqrt(rx * rx + ry * ry) <= 0.35::DOUBLE * o, false) AS bad FROM e),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS run FROM f),
h AS (SELECT *, bad AND sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, run) >= 2 AS hit FROM r)
SELECT match_id, frame_index, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS rejected FROM h WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)"""
)
def q_pingpong(spark, sf_dir):
    return C.reject_alternation(samples(spark, sf_dir))


@query(
    f"""WITH {_S}, k AS (SELECT *, interpolated AND NOT detected AND x IS NOT NULL AS held FROM s), e AS (SELECT *, CASE WHEN NOT held THEN {{'t': t_ms, 'x': x, 'y': y, 'd': detected AND x IS NOT NULL}} END AS edge FROM k),
b AS (SELECT *, last_value(edge IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(edge IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM e WINDOW w AS (PARTITION BY match_id, shot_id ORDER BY frame_index)),
m AS (SELECT *, held AND coalesce(p.d AND n.d AND n.t > p.t, false) AS moved FROM b)
SELECT match_id, frame_index, floor((CASE WHEN moved THEN p.x + ((t_ms - p.t) / (n.t - p.t)) * (n.x - p.x) ELSE x END) * 10000 + 0.5) / 10000 AS hx, floor((CASE WHEN moved THEN p.y + ((t_ms - p.t) / (n.t - p.t)) * (n.y - p.y) ELSE y END) * 10000 + 0.5) / 10000 AS hy FROM m"""
)
def q_hold_interp(spark, sf_dir):
    return C.hold_positions(samples(spark, sf_dir)).select("match_id", "frame_index", rounded(F.col("hx")).alias("hx"), rounded(F.col("hy")).alias("hy"))


@query(
    _PLAYED
)
def q_played_contacts(spark, sf_dir):
    """Contacts of trajectories whose alternating detections have become misses first."""
    return C.merge_contacts(C.candidates(C.without_rejected(samples(spark, sf_dir)))).select("match_id", "contact_id", "frame_index", "n_merged", F.round(F.col("clock_ms") / 1000.0, 3).alias("processed_sec"))


@query(f"WITH {_ZONES}, k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start_sec, hotspot_id) AS place FROM zones) SELECT match_id, place::BIGINT AS place, start_sec, end_sec, n_contacts FROM k WHERE place <= 10")
def q_top_hotspots(spark, sf_dir):
    """The ten windows that the summary of a match lists."""
    return C.first_hotspots(C.hotspots(C.merge_contacts(C.candidates(samples(spark, sf_dir))))).select("match_id", F.col("place").cast("long").alias("place"), "start_sec", "end_sec", "n_contacts")


@query(
    f"""WITH {_S}, k AS (SELECT match_id, shot_id, min(t_ms) AS f, max(t_ms) - min(t_ms) AS span FROM s GROUP BY ALL), c AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY match_id ORDER BY shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k)
SELECT match_id, frame_index, (b + t_ms - f)::DOUBLE / 1000.0::DOUBLE AS processed_sec FROM s JOIN c USING (match_id, shot_id)"""
)
def q_processed_clock(spark, sf_dir):
    return C.processed_clock(samples(spark, sf_dir))


@query(f"WITH {_RN} SELECT * FROM n")
def q_range_normalize(spark, sf_dir):
    return I.normalize(ranges(spark, sf_dir))


@query(f"WITH {_R.replace('r AS', 'r0 AS', 1)}, r AS (SELECT match_id, greatest(0.0, start_sec - 15) AS start_sec, end_sec + 15 AS end_sec FROM r0), {_N} SELECT * FROM n")
def q_range_pad(spark, sf_dir):
    return I.pad(ranges(spark, sf_dir), 15.0)


@query(f"WITH {_RN} SELECT match_id, sum(greatest(0.0, end_sec - start_sec)) AS total_sec, min(start_sec) AS envelope_start, max(end_sec) AS envelope_end, count(*) AS n_ranges FROM n GROUP BY match_id")
def q_envelope(spark, sf_dir):
    return I.totals(I.normalize(ranges(spark, sf_dir)))


@query(f"WITH {_RN}, {_P} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.match_id = p.match_id) OR EXISTS (SELECT 1 FROM n WHERE n.match_id = p.match_id AND p.t_sec BETWEEN n.start_sec AND n.end_sec)")
def q_range_contains(spark, sf_dir):
    return I.inside(points(spark, sf_dir), I.normalize(ranges(spark, sf_dir)))


@query(f"WITH {_RN}, {_P} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.match_id = p.match_id AND p.t_sec BETWEEN n.start_sec AND n.end_sec)")
def q_bench_anti(spark, sf_dir):
    return I.outside(points(spark, sf_dir), I.normalize(ranges(spark, sf_dir)))


@query(
    f"""WITH {_RN}, m AS (SELECT match_id, start_sec + 20.1237 AS a, end_sec + 60 AS b FROM n WHERE match_id % 5 <> 0) SELECT r.match_id, range_id, {_R3('greatest(r.start_sec, m.a)')} AS start_sec, {_R3('least(r.end_sec, m.b)')} AS end_sec FROM r JOIN m USING (match_id)
WHERE least(r.end_sec, m.b) > greatest(r.start_sec, m.a) UNION ALL SELECT match_id, range_id, start_sec, end_sec FROM r WHERE match_id NOT IN (SELECT match_id FROM m)"""
)
def q_range_intersect(spark, sf_dir):
    """Shots cut to the playing time; every fifth match has none and keeps its shots whole."""
    r = ranges(spark, sf_dir)
    return I.intersect(r, I.normalize(r).filter("match_id % 5 <> 0").select("match_id", (F.col("start_sec") + 20.1237).alias("start_sec"), (F.col("end_sec") + 60).alias("end_sec")))


@query(
    f"""WITH {_RN}, {_P}, c AS (SELECT p.match_id, point_id, p.t_sec, coalesce(least(greatest(t_sec, start_sec), end_sec), t_sec) AS spot, start_sec FROM p LEFT JOIN n USING (match_id))
SELECT match_id, point_id, first(spot ORDER BY abs(spot - t_sec), start_sec) AS t_sec FROM c GROUP BY match_id, point_id"""
)
def q_range_clamp(spark, sf_dir):
    return I.clamp(points(spark, sf_dir), I.normalize(ranges(spark, sf_dir)))


@query(
    f"""WITH {_RN}, c AS (SELECT *, sum(end_sec - start_sec) OVER (PARTITION BY match_id ORDER BY start_sec, end_sec) AS upto, sum(end_sec - start_sec) OVER (PARTITION BY match_id) AS total FROM n)
SELECT match_id, floor(coalesce(min(CASE WHEN 0.6::DOUBLE * total <= upto THEN start_sec + 0.6::DOUBLE * total - (upto - (end_sec - start_sec)) END), max(end_sec)) * 1000 + 0.5) / 1000 AS t_sec FROM c GROUP BY match_id"""
)
def q_time_at_fraction(spark, sf_dir):
    return I.time_at_fraction(I.normalize(ranges(spark, sf_dir)), 0.6)


@query(
    f"""WITH {_RN}, m AS (SELECT DISTINCT c_custkey AS match_id FROM customer), h AS (SELECT match_id, substr(sha1(string_agg(format('{{:.1f}}-{{:.1f}}', start_sec, end_sec), ';' ORDER BY start_sec, end_sec)), 1, 8) AS hash FROM n GROUP BY match_id)
SELECT match_id, coalesce(hash, 'all') AS hash FROM m LEFT JOIN h USING (match_id)"""
)
def q_range_hash(spark, sf_dir):
    return I.ranges_hash(I.normalize(ranges(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("match_id")))


@query(
    f"""WITH {_RN}, g AS (SELECT match_id, end_sec AS gap_start, lead(start_sec) OVER (PARTITION BY match_id ORDER BY start_sec, end_sec) AS gap_end FROM n)
SELECT match_id, gap_start, gap_end FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY gap_end - gap_start DESC, gap_start) AS k FROM g WHERE gap_end > gap_start) WHERE k = 1"""
)
def q_widest_gap(spark, sf_dir):
    return I.widest_gap(I.normalize(ranges(spark, sf_dir)))


_HALVES = f"""{_RN}, h AS (SELECT match_id, start_sec, start_sec + floor((end_sec - start_sec) / 2) AS mid, end_sec FROM n),
shots AS (SELECT match_id, start_sec, mid AS end_sec, start_sec * 2 AS range_id FROM h WHERE mid > start_sec UNION ALL SELECT match_id, mid, end_sec, start_sec * 2 + 1 FROM h)"""


@query(f"WITH {_HALVES}, {_P} SELECT p.match_id, point_id, first(range_id ORDER BY start_sec, end_sec) AS shot FROM p JOIN shots s ON p.match_id = s.match_id AND t_sec BETWEEN start_sec AND end_sec GROUP BY p.match_id, point_id")
def q_live_shot_join(spark, sf_dir):
    """Points in shots that touch: every range cut in two."""
    n = I.normalize(ranges(spark, sf_dir)).withColumn("mid", F.col("start_sec") + F.floor((F.col("end_sec") - F.col("start_sec")) / 2))
    first = n.filter("mid > start_sec").select("match_id", "start_sec", F.col("mid").alias("end_sec"), (F.col("start_sec") * 2).alias("range_id"))
    return I.shot_of(points(spark, sf_dir), first.unionByName(n.select("match_id", F.col("mid").alias("start_sec"), "end_sec", (F.col("start_sec") * 2 + 1).alias("range_id"))))


@query(f"WITH {_RN} SELECT match_id, count(*) = 1 AND min(start_sec) <= 1 AND max(end_sec) >= 399 AS whole FROM n GROUP BY match_id")
def q_whole_match(spark, sf_dir):
    return I.whole_match(I.normalize(ranges(spark, sf_dir)), 400.0)


@query(
    f"""WITH {_RN}, k AS (SELECT match_id, start_sec, end_sec FROM n WHERE start_sec < 2700), b AS (SELECT match_id, coalesce(lag(end_sec) OVER (PARTITION BY match_id ORDER BY start_sec, end_sec), 0.0) AS a, start_sec AS b FROM k UNION ALL SELECT match_id, max(end_sec), 3000.0 FROM k GROUP BY match_id),
g AS (SELECT match_id, arg_max({{'a': a, 'b': b}}, {{'l': b - a, 'm': -a}}) AS g FROM b WHERE b - a > 20 GROUP BY match_id),
w AS (SELECT match_id, (g.a + g.b) / 2 AS mid, least((g.b - g.a) * 0.6::DOUBLE, greatest(60.0, (g.b - g.a) * 0.4::DOUBLE)) AS span FROM g),
f AS (SELECT k.*, row_number() OVER (PARTITION BY match_id ORDER BY end_sec - start_sec DESC, start_sec) AS rk, (end_sec - start_sec - greatest(20.0, least((end_sec - start_sec) * 0.2::DOUBLE, 300.0))) / 2 AS half FROM k WHERE match_id NOT IN (SELECT match_id FROM g)),
u AS (SELECT match_id, start_sec, end_sec FROM k WHERE match_id IN (SELECT match_id FROM g) UNION ALL SELECT match_id, mid - span / 2, mid + span / 2 FROM w
UNION ALL SELECT match_id, start_sec, CASE WHEN rk = 1 AND end_sec - start_sec >= 40 THEN start_sec + half ELSE end_sec END FROM f UNION ALL SELECT match_id, end_sec - half, end_sec FROM f WHERE rk = 1 AND end_sec - start_sec >= 40)
SELECT match_id, floor(start_sec * 10000 + 0.5) / 10000 AS start_sec, floor(end_sec * 10000 + 0.5) / 10000 AS end_sec FROM u"""
)
def q_add_period(spark, sf_dir):
    out = I.add_period(I.normalize(ranges(spark, sf_dir)).filter("start_sec < 2700"), 3000.0)
    return out.select("match_id", rounded(F.col("start_sec")).alias("start_sec"), rounded(F.col("end_sec")).alias("end_sec"))
