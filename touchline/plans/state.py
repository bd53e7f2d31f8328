"""Queries of order-dependent and streaming operators; most are checked against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import folds, identity, pitch, smoothing, tracks
from touchline.sources.projections import BOXES, SAMPLES, project
from touchline.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def q_smoother_fold(spark, sf_dir):
    return smoothing.smooth_ball(project(spark, sf_dir, "events", SAMPLES))


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label is not null").select(F.col("label").cast("long").alias("match_id"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


@query()
def q_greedy_cluster(spark, sf_dir):
    return folds.greedy_clusters(_vectors(spark, sf_dir), 0.5)


@query()
def q_two_means(spark, sf_dir):
    return folds.two_means(_vectors(spark, sf_dir))


@query()
def q_nms(spark, sf_dir):
    return folds.suppress_overlaps(project(spark, sf_dir, "lineitem", BOXES))


_DET = (
    "user_id % 64 AS match_id", "CAST((event_id - event_id % 6400) / 6400 AS BIGINT) AS shot_id", "CAST((event_id - event_id % 64) / 64 AS BIGINT) AS frame_index", "event_id AS det_id", "CAST((event_id - event_id % 64) / 64 AS BIGINT) * 320 AS t_ms",
    "CAST((event_id * 3 + user_id * 7) % 600 AS DOUBLE) AS x1", "CAST((event_id * 2 + user_id * 5) % 300 AS DOUBLE) AS y1", "CAST((event_id * 3 + user_id * 7) % 600 + 12 AS DOUBLE) AS x2", "CAST((event_id * 2 + user_id * 5) % 300 + 20 + user_id % 30 AS DOUBLE) AS y2",
)


@query()
def q_player_tracker(spark, sf_dir):
    return tracks.track_players(project(spark, sf_dir, "events", _DET))


# one body a match, still in the scene, under a camera that swings by more than a player can run; scenes of 512 frames
_PAN = "CAST(event_id * 37 % 400 AS DOUBLE)"
_STILL = (
    "user_id % 8 AS match_id", "0L AS shot_id", "event_id AS frame_index", "event_id AS det_id", "event_id * 100 AS t_ms", f"300 + {_PAN} AS x1", "100.0D + event_id % 3 AS y1", f"312 + {_PAN} AS x2", "130.0D + event_id % 3 AS y2",
)
_SWINGS = ("user_id % 8 AS match_id", "event_id AS frame_index", "CAST((event_id - event_id % 512) / 512 AS BIGINT) AS shot_id", f"array(1.0D, 0.0D, {_PAN}, 0.0D, 1.0D, 0.0D, 0.0D, 0.0D, 1.0D) AS matrix")


@query(
    """WITH d AS (SELECT user_id % 8 AS match_id, event_id AS f, (event_id - event_id % 512) // 512 AS scene FROM events),
b AS (SELECT *, CASE WHEN lag(scene) OVER w = scene AND (f - lag(f) OVER w) * 100 <= 2000 THEN 0 ELSE 1 END AS opens FROM d WINDOW w AS (PARTITION BY match_id ORDER BY f))
SELECT match_id, 0::BIGINT AS shot_id, f AS frame_index, f AS det_id, (sum(opens) OVER (PARTITION BY match_id ORDER BY f) - 1)::BIGINT AS track_id FROM b"""
)
def q_panned_tracks(spark, sf_dir):
    return tracks.track_players(project(spark, sf_dir, "events", _STILL), project(spark, sf_dir, "events", _SWINGS))


@query()
def q_identity_fold(spark, sf_dir):
    expressions = (
        "user_id % 64 AS match_id", "event_id AS contact_id", "event_id * 5 / 1000.0D AS t_sec", "CAST((event_id * 3 + user_id * 7) % 600 AS DOUBLE) AS x", "CAST(event_id * 2 % 330 AS DOUBLE) AS y",
        "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id * 17 % 101 AS DOUBLE) / 100.0D END AS app", "CAST(event_id * 37 % 180 AS DOUBLE) AS h", "CAST(event_id * 5 % 250 AS DOUBLE) AS s",
        "CASE WHEN event_id % 11 <> 0 THEN CAST(event_id * 13 % 256 AS DOUBLE) END AS v", "CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_mine",
    )
    return identity.score_identity(project(spark, sf_dir, "events", expressions))


def _clicks(spark, sf_dir):
    """Clicks of a made-up camera on the landmarks: eight a frame."""
    spots = pitch.landmarks(spark)
    named = spots.withColumn("place", F.abs(F.xxhash64("landmark")) % 8)
    frames = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("match_id"), F.col("c_custkey").alias("frame_index"), (F.col("c_custkey") % 8).alias("place"))
    seen = frames.join(named, "place").withColumns({"px": F.col("l") * 105 + F.col("dx"), "py": F.col("w") * 68 + F.col("dy")})
    depth = 1 + F.col("py") * 0.01 + F.col("frame_index") % 5 * 0.1
    return seen.select("match_id", "frame_index", "landmark", ((F.col("px") * 6 + F.col("frame_index") % 40) / depth).alias("x"), ((300 - F.col("py") * 3) / depth).alias("y"))


@query()
def q_homography(spark, sf_dir):
    return pitch.fit_homographies(pitch.place(_clicks(spark, sf_dir), 105.0, 68.0)).select("match_id", "frame_index", F.transform("h", lambda v: F.floor(v / F.get("h", 8) * 1e6 + 0.5) / 1e6).alias("h"), X.rounded(F.col("residual")).alias("residual"))


@query(
    """WITH e AS (VALUES ('L', 0, 1), ('R', 1, -1)), a(name, depth, across) AS (VALUES ('penarea_{}_goalline', 0.0, 20.16), ('penarea_{}_outer', 16.5, 20.16), ('goalarea_{}_goalline', 0.0, 9.16), ('goalarea_{}_outer', 5.5, 9.16), ('post_{}', 0.0, 3.66)),
s(side, sg) AS (VALUES ('near', -1), ('far', 1)), r AS (
SELECT replace(name, '{}', e.col0) || '_' || side AS landmark, e.col1 * 105 + e.col2 * depth AS px, 34 + sg * across AS py FROM e, a, s
UNION ALL SELECT 'penspot_' || e.col0, e.col1 * 105 + e.col2 * 11, 34 FROM e UNION ALL VALUES ('corner_near_left', 0, 0), ('corner_far_left', 0, 68), ('corner_near_right', 105, 0), ('corner_far_right', 105, 68),
('halfway_near', 52.5, 0), ('halfway_far', 52.5, 68), ('centre_spot', 52.5, 34), ('circle_near', 52.5, 24.85), ('circle_far', 52.5, 43.15), ('circle_left', 43.35, 34), ('circle_right', 61.65, 34))
SELECT landmark, floor(px::DOUBLE * 10000 + 0.5) / 10000 AS px, floor(py::DOUBLE * 10000 + 0.5) / 10000 AS py FROM r"""
)
def q_landmarks(spark, sf_dir):
    at = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return pitch.landmarks(spark).select("landmark", at(F.col("l") * 105 + F.col("dx")).alias("px"), at(F.col("w") * 68 + F.col("dy")).alias("py"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 20 AS limited FROM events GROUP BY ALL")
def q_hourly_counts(spark, sf_dir):
    return live.hourly_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(
    """WITH o AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n, max(value) AS peak FROM g GROUP BY user_id, s"""
)
def q_sessions(spark, sf_dir):
    return live.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
