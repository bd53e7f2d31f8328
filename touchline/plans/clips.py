"""Queries over shots, camera tracks, clips and documents, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.functions.columns import rounded
from touchline.operators import clips as L
from touchline.operators import colour as K
from touchline.operators import review as R
from touchline.operators import services as V
from touchline.sources import documents as S
from touchline.sources.projections import SAMPLES, duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STATS = (
    "user_id % 64 AS match_id", "event_id AS frame_index", "event_id * 500 AS t_ms", "CAST(event_id * 7919 % 100 AS DOUBLE) / 100.0D AS hist_d", "CAST(event_id * 31 % 100 AS DOUBLE) / 100.0D AS green",
    "CAST(event_id * 17 % 70 AS DOUBLE) / 100.0D AS graphic", "CASE WHEN event_type <> 'error' THEN CAST(event_id * 13 % 30 AS DOUBLE) / 10.0D END AS motion",
)
TRACK = ("user_id % 64 AS match_id", "event_id AS frame_index", "event_id * 5 AS t_ms", "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 9 - 4 AS DOUBLE) END AS dx", "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 7 - 3 AS DOUBLE) END AS dy")
ASKED = ("o_custkey % 64 AS match_id", "o_orderkey AS point_id", "o_orderkey * 31 % 50000 AS t_ms")

_ST = f"st AS {duck('events', STATS)}, cut AS (SELECT *, sum(CASE WHEN hist_d > 0.45::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS cut FROM st)"
_TR = f"tr AS {duck('events', TRACK)}, ask AS {duck('orders', ASKED)}"


@query(f"WITH {_ST} SELECT match_id, cut, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM cut GROUP BY ALL")
def q_shot_islands(spark, sf_dir):
    return L.cut_shots(project(spark, sf_dir, "events", STATS)).groupBy("match_id", "cut").agg(F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query(
    f"""WITH {_ST}, g AS (SELECT match_id, cut, avg(green) AS green, avg(graphic) AS graphic, coalesce(avg(motion), 0) AS motion, (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS dur FROM cut GROUP BY ALL)
SELECT match_id, cut, dur, CASE WHEN green < 0.3::DOUBLE OR graphic > 0.5::DOUBLE THEN 'discard' WHEN dur >= 60 AND motion < 1.2::DOUBLE THEN 'deadtime' ELSE 'main_camera' END AS label FROM g"""
)
def q_shot_label(spark, sf_dir):
    return L.label_shots(L.cut_shots(project(spark, sf_dir, "events", STATS))).select("match_id", "cut", "dur", "label")


@query(
    f"""WITH {_TR}, c AS (SELECT ask.match_id, point_id, ask.t_ms, tr.t_ms AS at_ms, dx, row_number() OVER (PARTITION BY ask.match_id, point_id ORDER BY abs(ask.t_ms - tr.t_ms), tr.t_ms) AS k FROM ask JOIN tr ON tr.match_id = ask.match_id)
SELECT match_id, point_id, t_ms, at_ms, dx FROM c WHERE k = 1"""
)
def q_asof_camera(spark, sf_dir):
    return L.as_of_nearest(project(spark, sf_dir, "orders", ASKED), project(spark, sf_dir, "events", TRACK), ["dx"]).filter("at_ms is not null")


_CUM = f"{_TR}, cu AS (SELECT *, sum(coalesce(dx, 0)) OVER (PARTITION BY match_id ORDER BY frame_index) AS cum_dx, sum(coalesce(dy, 0)) OVER (PARTITION BY match_id ORDER BY frame_index) AS cum_dy FROM tr)"


@query(f"WITH {_CUM} SELECT match_id, frame_index, cum_dx, cum_dy FROM cu")
def q_camera_offset(spark, sf_dir):
    return L.accumulate(project(spark, sf_dir, "events", TRACK)).select("match_id", "frame_index", "cum_dx", "cum_dy")


@query(
    f"""WITH {_CUM}, b AS (SELECT ask.match_id, point_id, ask.t_ms, max(cu.t_ms) FILTER (WHERE cu.t_ms <= ask.t_ms) AS t0, min(cu.t_ms) FILTER (WHERE cu.t_ms >= ask.t_ms) AS t1 FROM ask JOIN cu ON cu.match_id = ask.match_id GROUP BY ALL)
SELECT b.match_id, point_id, floor((CASE WHEN t1 IS NULL THEN x.cum_dx WHEN t0 IS NULL THEN y.cum_dx WHEN t0 = t1 THEN x.cum_dx ELSE x.cum_dx + ((b.t_ms - t0) / (t1 - t0)) * (y.cum_dx - x.cum_dx) END) * 10000 + 0.5) / 10000 AS cum_dx
FROM b LEFT JOIN cu x ON x.match_id = b.match_id AND x.t_ms = t0 LEFT JOIN cu y ON y.match_id = b.match_id AND y.t_ms = t1"""
)
def q_camera_interpolate(spark, sf_dir):
    out = L.interpolate(project(spark, sf_dir, "orders", ASKED), L.accumulate(project(spark, sf_dir, "events", TRACK)), "cum_dx")
    return out.filter("cum_dx is not null").withColumn("cum_dx", rounded(F.col("cum_dx")))


@query(
    f"""WITH {_TR}, s AS (SELECT match_id, t_ms AS at_ms, frame_index FROM tr WHERE dx IS NOT NULL) SELECT ask.match_id, point_id, max(at_ms) AS at_ms FROM ask JOIN s ON s.match_id = ask.match_id AND at_ms <= ask.t_ms AND at_ms >= ask.t_ms - 8000 GROUP BY ALL"""
)
def q_asof_sighting(spark, sf_dir):
    return L.latest_before(project(spark, sf_dir, "orders", ASKED), project(spark, sf_dir, "events", TRACK).filter("dx is not null"), 8000)


@query(
    f"""WITH s AS {duck('events', SAMPLES)}, n AS (SELECT match_id, frame_index, count(*) OVER (PARTITION BY match_id) AS n, row_number() OVER (PARTITION BY match_id ORDER BY frame_index) - 1 AS i FROM s)
SELECT match_id, frame_index FROM n WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda j: round_even(j * (n - 1) / 7.0::DOUBLE, 0)::BIGINT), i)"""
)
def q_even_sample(spark, sf_dir):
    return L.evenly(project(spark, sf_dir, "events", SAMPLES), 8, "frame_index").select("match_id", "frame_index")


@query("SELECT event_id AS point_id, unnest(range(greatest(0, event_id - 6), least(last, event_id + 6) + 1, 3)) AS frame_index FROM events, (SELECT max(event_id) AS last FROM events)")
def q_frame_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return L.window_frames(e.select(F.col("event_id").alias("point_id"), F.col("event_id").alias("frame_index")), 6, 3, e.agg(F.max("event_id")).first()[0])


@query(
    """WITH RECURSIVE g AS (SELECT p_partkey, p_size::BIGINT AS s, 0 AS i FROM part UNION ALL SELECT p_partkey, (s * 9301 + 49297) % 233280, i + 1 FROM g WHERE i < 5) SELECT p_partkey, i, s FROM g WHERE i > 0"""
)
def q_lcg_segments(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.posexplode(L.lcg(F.col("p_size"), 5)).alias("k", "s")).select("p_partkey", (F.col("k") + 1).alias("i"), "s")


@query(
    """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, event_type = 'error' AS interrupted FROM events"""
)
def q_json_source(spark, sf_dir):
    """Tolerant read of JSON documents: unknown keys are ignored, missing ones get a default."""
    parsed = F.from_json("props", "k long, absent string", {"mode": "PERMISSIVE"})
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"), (F.col("event_type") == "error").alias("interrupted"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, max(event_id) - min(event_id) + 1 AS span FROM events")
def q_frame_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"), (F.max("event_id") - F.min("event_id") + 1).alias("span"))


@query("SELECT event_id AS frame_index, ts FROM events, (SELECT max(event_id) AS last FROM events) WHERE event_id % 7 = 0 AND event_id BETWEEN last // 20 AND last - last // 20")
def q_sampled_scan(spark, sf_dir):
    """Every seventh frame between bounds a twentieth in from the ends of the table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.agg(F.max("event_id")).first()[0] or 0
    return S.sampled_frames(e.withColumnRenamed("event_id", "frame_index"), 7, last // 20, last - last // 20).select("frame_index", "ts")


@query(
    """WITH q AS (SELECT user_id % 64 AS match_id, event_id AS rank, event_id % 11 AS grp, event_id % 4 = 0 AS crowded, CASE WHEN event_id % 5 = 0 THEN 'me' END AS decision FROM events),
d AS (SELECT match_id, grp, min(rank) AS rank FROM q WHERE decision = 'me' AND NOT crowded GROUP BY ALL) SELECT q.match_id, q.rank, coalesce(decision, CASE WHEN d.rank < q.rank AND NOT crowded THEN 'me' END) AS decision FROM q LEFT JOIN d USING (match_id, grp)"""
)
def q_propagation(spark, sf_dir):
    q = project(spark, sf_dir, "events", ("user_id % 64 AS match_id", "event_id AS rank", "event_id % 11 AS grp", "event_id % 4 = 0 AS crowded", "CASE WHEN event_id % 5 = 0 THEN 'me' END AS decision"))
    return R.propagate(q).select("match_id", "rank", "decision")


_STATUS = ("doc_id", "CASE doc_id % 6 WHEN 0 THEN 'Stage 4: shot ' || doc_id || ' / ' || n_chars WHEN 1 THEN 'Stage 2 filter' WHEN 2 THEN n_chars || ' live shots, deadtime' WHEN 3 THEN 'chunk ' || doc_id || '/900' WHEN 4 THEN 'Done' ELSE substr(coalesce(text, ''), 1, 200) END AS status")


@query(
    f"""WITH s AS {duck('documents', _STATUS)}, l AS (SELECT *, lower(coalesce(status, '')) AS t FROM s)
SELECT doc_id, CASE WHEN regexp_matches(t, 'stage 1|stage 2') THEN 'shot_filter' WHEN regexp_matches(t, 'stage 3|deadtime') THEN 'deadtime' WHEN regexp_matches(t, 'stage [4-7]|(shot|chunk)\\s+\\d+/\\d+') THEN 'inference' WHEN regexp_matches(t, 'stage 8|possession') THEN 'possession'
  WHEN regexp_matches(t, 'stage 9|timestamp') THEN 'timestamps' WHEN contains(t, 'done') THEN 'done' ELSE 'running' END AS stage,
  CASE WHEN regexp_matches(t, 'shot\\s*\\d+\\s*/\\s*\\d+') THEN TRY_CAST(regexp_extract(t, 'shot\\s*(\\d+)\\s*/\\s*(\\d+)', 1) AS INT) WHEN regexp_matches(t, '\\d+\\s*/\\s*\\d+') THEN TRY_CAST(regexp_extract(t, '(\\d+)\\s*/\\s*(\\d+)', 1) AS INT) WHEN regexp_matches(t, '\\d+\\s+live\\s+shot') THEN 0 END AS done,
  CASE WHEN regexp_matches(t, 'shot\\s*\\d+\\s*/\\s*\\d+') THEN TRY_CAST(regexp_extract(t, 'shot\\s*(\\d+)\\s*/\\s*(\\d+)', 2) AS INT) WHEN regexp_matches(t, '\\d+\\s*/\\s*\\d+') THEN TRY_CAST(regexp_extract(t, '(\\d+)\\s*/\\s*(\\d+)', 2) AS INT) WHEN regexp_matches(t, '\\d+\\s+live\\s+shot') THEN TRY_CAST(regexp_extract(t, '(\\d+)\\s+live\\s+shot', 1) AS INT) END AS total FROM l"""
)
def q_progress_parse(spark, sf_dir):
    s = project(spark, sf_dir, "documents", _STATUS)
    p = V.parse_progress(F.col("status"))
    return s.select("doc_id", V.parse_stage(F.col("status")).alias("stage"), p["done"].alias("done"), p["total"].alias("total"))


@query(
    """WITH k AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) FILTER (WHERE event_id % 2 = 0) AS a, list(DISTINCT event_type ORDER BY event_type) FILTER (WHERE event_id % 2 = 1 AND event_id % 3 = 0) AS b FROM events GROUP BY user_id),
d AS (SELECT user_id, coalesce(a, []) AS a, list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)) AS left_ FROM k) SELECT user_id, array_to_string(CASE WHEN len(left_) = 0 THEN a ELSE left_ END, ',') AS swatches FROM d"""
)
def q_swatch_difference(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))).alias("mine"), F.collect_set(F.when((F.col("event_id") % 2 == 1) & (F.col("event_id") % 3 == 0), F.col("event_type"))).alias("other"))
    return K.kit_swatches(k).select("user_id", F.array_join("swatches", ",").alias("swatches"))


@query("SELECT p_partkey, '#' || lower(lpad(to_hex(p_partkey * 37 % 256), 2, '0') || lpad(to_hex(p_size * 5 % 256), 2, '0') || lpad(to_hex(p_partkey * 13 % 256), 2, '0')) AS hex FROM part")
def q_color_hex(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", X.rgb_to_hex(F.col("p_partkey") * 37 % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 13 % 256).alias("hex"))


@query(
    f"""WITH {_ST}, g AS (SELECT match_id, cut, coalesce(avg(motion), 0) AS motion, (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS dur FROM cut GROUP BY ALL) SELECT match_id, cut, dur, dur >= 20 AND motion < 1.2::DOUBLE AS dead FROM g"""
)
def q_deadtime(spark, sf_dir):
    return L.dead_time(L.cut_shots(project(spark, sf_dir, "events", STATS)), least_sec=20.0).select("match_id", "cut", "dur", "dead")
