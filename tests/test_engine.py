"""Operators of the engine on literal rows, invariants of the interval algebra, and every query against its DuckDB statement."""

import math
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from touchline.config import DEFAULT
from touchline.functions import columns as X
from touchline.operators import contacts, folds, intervals, review, tracks, valuation
from touchline.plans import registry
from touchline.streaming import live

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if math.isnan(v) else repr(float(v))
        return str(v)

    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_statement(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert _rows(registry.QUERIES[name](spark, DATA).toPandas()) == _rows(con.sql(registry.ORACLES[name]).df())


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["match_id", "hotspot_id", "start_sec", "end_sec", "n_contacts"]


_RANGE = st.tuples(st.integers(0, 3), st.integers(-50, 300), st.integers(-50, 300))


@settings(max_examples=8, deadline=None)
@given(st.lists(_RANGE, min_size=1, max_size=25))
def test_normalize_is_stable_and_disjoint(spark, rows):
    df = spark.createDataFrame([(m, float(a), float(b)) for m, a, b in rows], "match_id long, start_sec double, end_sec double")
    once = sorted(tuple(r) for r in intervals.normalize(df).collect())
    twice = sorted(tuple(r) for r in intervals.normalize(spark.createDataFrame(once, df.schema)).collect()) if once else []
    assert once == twice
    for a, b in zip(once, once[1:]):
        assert a[0] != b[0] or b[1] > a[2] + DEFAULT.range_merge_sec


def test_kinematics_literals(spark):
    path = [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0), (300.0, 0.0), (200.0, 0.0), (100.0, 0.0), (0.0, 0.0)]
    rows = [(1, i, i * 200, x, y, True) for i, (x, y) in enumerate(path)]
    s = spark.createDataFrame(rows, "match_id long, frame_index long, t_ms long, x double, y double, detected boolean")
    merged = contacts.merge_contacts(contacts.candidates(s)).collect()
    assert [m.frame_index for m in merged] == [3]


def test_points_outside_and_inside_split(spark):
    r = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 30.0)], "match_id long, start_sec double, end_sec double")
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, 15.0), (1, 3, 30.1), (2, 4, 99.0)], "match_id long, point_id long, t_sec double")
    assert sorted(x.point_id for x in intervals.inside(p, r).collect()) == [1, 4]
    assert sorted(x.point_id for x in intervals.outside(p, r).collect()) == [2, 3, 4]
    clamped = {x.point_id: x.t_sec for x in intervals.clamp(p, r).collect()}
    assert clamped == {1: 10.0, 2: 10.0, 3: 30.0, 4: 99.0}
    at = [intervals.time_at_fraction(r, f).first().t_sec for f in (0.0, 0.5, 0.75, 1.0)]
    assert at == [0.0, 10.0, 25.0, 30.0]


def test_suppression_takes_the_latest_free_shot(spark):
    log = [(1, 0, "Shot Taken", 1.0), (1, 1, "Shot Taken", 5.0), (1, 2, "Goal", 6.0), (1, 3, "Goal", 7.0), (1, 4, "Goal", 30.0), (1, 5, "Shot Taken", 30.0), (1, 6, "Shot Taken", 30.0)]
    a = spark.createDataFrame(log, "match_id long, seq long, action string, seconds double")
    assert sorted(r.seq for r in valuation.suppressed_shots(a).collect()) == [0, 1, 5]


def test_review_evidence_never_from_missing(spark):
    df = spark.createDataFrame([(None, 1.0, True, 1.0, None), (0.1, 0.5, True, 1.0, False)], "app double, prior double, a boolean, dt double, mine boolean")
    got = [r[0] for r in df.select(review.negative_evidence(F.col("app"), F.col("prior"), F.col("a"), F.col("dt"), F.col("mine"))).collect()]
    assert got == [[], ["appearance_mismatch", "outside_orbital", "other_team"]]


def test_overlap_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (1, 2, 1.0, 1.0, 11.0, 11.0, 0.8, 1), (1, 3, 1.0, 1.0, 11.0, 11.0, 0.7, 2), (2, 1, 0.0, 0.0, 1.0, 1.0, 0.1, 1)]
    b = spark.createDataFrame(rows, "frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, class_id long")
    assert sorted(tuple(r) for r in folds.suppress_overlaps(b).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_tracker_keeps_identity(spark):
    rows = [(1, 0, f, d, f * 100, d * 300.0 + f * 5, 10.0, d * 300.0 + f * 5 + 12, 45.0) for f in range(6) for d in range(2)]
    rows += [(1, 1, 9, 0, 900, 30.0, 10.0, 42.0, 45.0)]
    schema = "match_id long, shot_id long, frame_index long, det_id long, t_ms long, x1 double, y1 double, x2 double, y2 double"
    t = tracks.track_players(spark.createDataFrame(rows, schema)).collect()
    assert {(r.shot_id, r.det_id, r.track_id) for r in t} == {(0, 0, 0), (0, 1, 1), (1, 0, 2)}


def test_two_means_and_greedy_clusters(spark):
    rows = [(1, i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(10)]
    p = spark.createDataFrame(rows, "match_id long, item long, vector array<double>")
    side = {r["item"]: r.side for r in folds.two_means(p).collect()}
    assert len({side[i] for i in range(0, 10, 2)}) == 1 and side[0] != side[1]
    assert {r["item"] % 2 == r.cluster for r in folds.greedy_clusters(p, 1.0).collect()} == {True}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).select(F.timestamp_seconds(F.col("id") * 97 % 20_000).alias("ts"), (F.col("id") % 5).alias("user_id"), F.col("id").cast("double").alias("value"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    batch = sorted(tuple(r) for r in live.hourly_counts(spark.read.parquet(str(tmp_path / "in"))).collect())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.hourly_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("hourly").collect()) == batch


def test_scaled_config():
    c = DEFAULT.for_frame_width(1280)
    assert c.orbital_base_px == 160 and c.contact_min_speed_px_s == 60 and c.contact_merge_sec == DEFAULT.contact_merge_sec


def test_columns(spark):
    row = spark.range(1).select(X.clock(F.lit(59)), X.clock(F.lit(3725)), X.escape_html(F.lit("<a>&'")), X.rounded(F.lit(1.00005))).first()
    assert row[0] == "0:59" and row[1] == "1:02:05" and row[2] == "&lt;a&gt;&amp;'"
