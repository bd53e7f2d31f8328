"""Literal cases of single operators: the smoother, identity, intervals, attribution, valuation, review, galleries and tracks."""

import pytest
from pyspark.sql import functions as F

from touchline.config import DEFAULT
from touchline.operators import appearance, attribution, clustering, colour, contacts, intervals, moments, review, services, tracks, valuation
from touchline.operators.identity import Contact, Run, read, score_identity
from touchline.operators.smoothing import FADE, HOLD, LOST, advance
from touchline.sources import documents

RED, BLUE = (0.0, 200.0, 200.0), (120.0, 200.0, 200.0)


def _smoothed(sights):
    track, out = LOST, []
    for sight in sights:
        track, said = advance(track, sight and sight[:2], sight[2] if sight else 0.0)
        out.append(said)
    return out


def test_a_far_sight_needs_a_second_one():
    good, far = (105.0, 105.0, 0.67), (305.0, 105.0, 0.8)
    assert [s[:2] for s in _smoothed([good, far, far])] == [(105.0, 105.0), (105.0, 105.0), (305.0, 105.0)]
    assert _smoothed([good, (265.0, 105.0, 0.11)])[1] == (105.0, 105.0, FADE * 0.67, False)
    assert [s[3] for s in _smoothed([good, (255.0, 105.0, 0.7), (405.0, 105.0, 0.7)])] == [True, False, True]


def test_held_confidence_does_not_fade_further_and_ends():
    out = _smoothed([(0.0, 0.0, 1.0)] + [None] * (HOLD + 1) + [(900.0, 0.0, 0.5)])
    assert all(s == (0.0, 0.0, FADE, False) for s in out[1:-2]) and out[-2] is None and out[-1][3]


def test_a_wild_sight_drops_the_rumour_and_a_miss_keeps_it():
    good, far, wild = (0.0, 0.0, 0.9), (300.0, 0.0, 0.9), (900.0, 0.0, 0.9)
    assert _smoothed([good, far, wild, far])[3][3] is False
    assert _smoothed([good, far, None, far])[3][3] is True


def _read(*cs, sightings=(), kits=()):
    run, out = Run(), []
    for c in cs:
        run, said = read(run, Contact(*c), DEFAULT, sightings, kits)
        out.append(said)
    return out


def test_runs_go_on_over_soft_gaps_and_end_at_hard_ones():
    a, b = _read((100, 100, 0.0, 0.9, RED, True), (140, 100, 5.0, 0.45, RED, True))
    assert a["tracklet_id"] == b["tracklet_id"] and a["anchored"] and b["carried"] and b["confidence"] == 0.7
    for later in ((120, 100, 10.0, 0.9, RED, True), (700, 100, 5.0, 0.9, RED, True), (140, 100, 5.0, 0.9, BLUE, True)):
        a, b = _read((100, 100, 0.0, 0.9, RED, True), later)
        assert a["tracklet_id"] != b["tracklet_id"] and not b["carried"]
    a, b = _read((100, 100, 0.0, 0.9, RED, True), (140, 100, 5.0, 0.4, None, True))
    assert a["tracklet_id"] == b["tracklet_id"] and b["carried"]


def test_nobody_takes_the_reference_from_afar_or_in_another_kit():
    assert not _read((100, 100, 0.0, 0.9, RED, True), (600, 100, 1.0, 0.99, RED, True))[1]["anchored"]
    assert not _read((100, 100, 0.0, 0.9, RED, True), (130, 100, 1.0, 0.99, BLUE, True))[1]["anchored"]
    assert not _read((100, 100, 0.0, 0.95, RED, False))[0]["anchored"]
    near, far = _read((100, 100, 0.0, 0.92, RED, True), (130, 100, 1.0, 0.55, RED, True), (600, 100, 1.0, 0.55, RED, True))[1:]
    assert near["confidence"] > far["confidence"] and far["prior"] < 1 and not far["carried"]


def test_a_sighting_lends_a_reference():
    near, far = _read((120, 100, 1.0, 0.95, RED, True), (500, 100, 1.5, 0.95, RED, True), sightings=((100.0, 100.0, 0.0),), kits=(RED,))
    assert near["linked"] and not far["linked"]
    assert not _read((120, 100, 1.0, 0.95, RED, True))[0]["linked"]


def test_missing_measurements_never_count_against():
    a, b = _read((0, 0, 0.0, 0.9, RED, True), (10, 0, 0.5, None, None, None))
    assert b["evidence"] == "" and b["linked"]
    assert set(_read((0, 0, 0.0, 0.9, RED, True), (900, 900, 1.0, 0.3, BLUE, False))[1]["evidence"].split(",")) == {"appearance_mismatch", "outside_orbital", "other_team"}


def test_stretches_between_silences_are_scored_as_one_match(spark):
    rows = [(1, i, t, 10.0 * i, 5.0, 0.9 if i % 3 == 0 else 0.4, *RED, True) for i, t in enumerate((0.0, 1.0, 4.5, 20.0, 21.0, 60.0, 61.5, 100.0))]
    got = score_identity(spark.createDataFrame(rows, "match_id long, contact_id long, t_sec double, x double, y double, app double, h double, s double, v double, is_mine boolean")).orderBy("contact_id").collect()
    expected = _read(*[(r[3], r[4], r[2], r[5], RED, True) for r in rows])
    assert [{k: r[k] for k in expected[0]} for r in got] == expected


def _ranges(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "match_id long, start_sec double, end_sec double")


def _pairs(df):
    return sorted((r.start_sec, r.end_sec) for r in df.collect())


def test_ranges(spark):
    assert _pairs(intervals.normalize(_ranges(spark, [(100, 60), (500, 700), (650, 800)]), 750.0)) == [(60.0, 100.0), (500.0, 750.0)]
    assert _pairs(intervals.normalize(_ranges(spark, [(0, 100), (100.2, 200), (300.00049, 310.00051)]))) == [(0.0, 200.0), (300.0, 310.001)]
    shots = spark.createDataFrame([(m, a, b, "main") for m in (1, 2) for a, b in ((0.0, 50.0), (90.0, 120.0), (130.0, 150.0), (180.0, 320.0), (220.0, 260.0), (500.0, 600.0))], "match_id long, start_sec double, end_sec double, label string")
    cut = intervals.intersect(shots, _ranges(spark, [(100, 200), (300, 400)]))
    assert _pairs(cut.filter("match_id = 1")) == [(100.0, 120.0), (130.0, 150.0), (180.0, 200.0), (300.0, 320.0)] and cut.filter("match_id = 2 and label = 'main'").count() == 6
    assert {r.hash for r in intervals.ranges_hash(_ranges(spark, [(0, 1)]), spark.range(3).select(F.col("id").alias("match_id"))).filter("match_id <> 1").collect()} == {"all"}
    clamped = intervals.clamp(spark.createDataFrame([(1, k, t) for k, t in enumerate((210.0, 290.0, 50.0, 150.0, 500.0))], "match_id long, point_id long, t_sec double"), _ranges(spark, [(100, 200), (300, 400)]))
    assert [r.t_sec for r in clamped.orderBy("point_id").collect()] == [200.0, 300.0, 100.0, 150.0, 400.0]


def test_points_meet_ranges_without_a_product(spark):
    p = spark.range(3000).selectExpr("1L AS match_id", "id AS point_id", "CAST(id AS DOUBLE) AS t_sec")
    r = spark.range(1000).selectExpr("1L AS match_id", "id AS range_id", "CAST(id * 3 AS DOUBLE) AS start_sec", "CAST(id * 3 + 1 AS DOUBLE) AS end_sec")
    for out in (intervals.inside(p, r), intervals.outside(p, r), intervals.clamp(p, r), intervals.shot_of(p, r)):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert intervals.inside(p, r).count() == 2000 and intervals.outside(p, r).count() == 1000


def _player(f, k, x, y, h=40.0, w=17.0):
    return (f, k, x - w / 2, y - h, x + w / 2, float(y), 0.9, 2)


def test_contests(spark):
    frames = {
        1: [_player(1, 0, 150, 152), *[_player(1, k + 1, 150 + dx, 150 + dy) for k, (dx, dy) in enumerate(((60, 10), (-55, 20), (35, -50), (-40, -45)))]],
        2: [_player(2, 0, 147, 150), _player(2, 1, 154, 151)],
        3: [_player(3, 0, 150, 151)],
        4: [],
        5: [_player(5, 0, 150, 150, 18.0, 8.0), _player(5, 1, 162, 150, 18.0, 8.0)],
        6: [_player(6, 0, 150, 150, 18.0, 8.0), _player(6, 1, 190, 150, 18.0, 8.0)],
    }
    boxes = spark.createDataFrame([b for rows in frames.values() for b in rows], "frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, class_id int")
    ball = spark.createDataFrame([(f, 150.0, 150.0) for f in frames], "frame_index long, x double, y double")
    got = {r.frame_index: r.ambiguous for r in attribution.ambiguity(ball, attribution.contesting(ball, boxes, 80.0)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False}
    assert {r.frame_index: r.n_near for r in attribution.crowd(ball, boxes).collect()}[4] == 0


def test_goals_compare_the_seconds_themselves(spark):
    log = [(1, 0, "Shot Taken", 0.0), (1, 1, "Goal", 12.04), (2, 0, "Shot Taken", 5.01), (2, 1, "Shot Taken", 5.04), (2, 2, "Goal", 6.0), (3, 0, "Shot Taken", 0.0), (3, 1, "Goal", 12.0)]
    got = valuation.suppressed_shots(spark.createDataFrame(log, "match_id long, seq long, action string, seconds double")).collect()
    assert sorted((r.match_id, r.seq) for r in got) == [(2, 1), (3, 0)]


def test_the_last_valid_decision_counts(spark):
    items = spark.createDataFrame([(1, k, k, k * 1000, None if k else "me") for k in range(4)], "match_id long, rank int, contact_id long, t_ms long, decision string")
    d = spark.createDataFrame([(1, 1, "me", 1), (1, 1, "not_me", 2), (1, 2, "not_me", 1), (1, 2, "me", 2), (1, 2, "maybe", 3)], "match_id long, rank int, choice string, seq long")
    assert [r.decision for r in review.apply_decisions(items, d).orderBy("rank").collect()] == ["me", "not_me", "me", None]
    with pytest.raises(Exception, match="decision must be"):
        review.apply_decisions(items, d, strict=True).collect()


def test_hotspots(spark):
    c = lambda *ts: spark.createDataFrame([(1, int(t * 1000), k) for k, t in enumerate(ts)], "match_id long, t_ms long, frame_index long")
    d = spark.createDataFrame([(1, 100.0)], "match_id long, duration_sec double")
    assert _pairs(contacts.hotspots(c(10))) == [(8.0, 12.0)] and _pairs(contacts.hotspots(c(10, 12))) == [(8.0, 14.0)]
    assert len(_pairs(contacts.hotspots(c(10, 30)))) == 2 and _pairs(contacts.hotspots(c(1, 99.5), durations=d)) == [(0.0, 3.0), (97.5, 100.0)]
    ball = spark.createDataFrame([(1, k, 10_000 + k * 250, 100.0 + max(0, k - 12) * 100, 100.0) for k in range(30)], "match_id long, frame_index long, t_ms long, x double, y double")
    assert _pairs(contacts.hotspots(c(10), samples=ball)) == [(8.0, 15.5)]


def test_candidate_budget(spark):
    found = spark.range(400).selectExpr("1L AS match_id", "id AS contact_id", "id AS frame_index", "id * 450 AS t_ms", "1.0D AS strength")
    for seconds, n in ((180.0, 120), (30.0, 60), (6000.0, 400)):
        assert contacts.cap_candidates(found, spark.createDataFrame([(1, seconds)], "match_id long, duration_sec double")).count() == n


def test_likeness_and_galleries(spark):
    items = spark.createDataFrame([(1, 0, [1.0, 0.0, 2.0]), (1, 1, [0.0, 2.0, 0.0]), (2, 2, [1.0, 0.0, 0.0]), (1, 3, None)], "match_id long, item long, descriptor array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "match_id long, descriptor array<double>")
    got = [r.app for r in appearance.gallery_score(items, one).orderBy("item").collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] is None and got[3] is None


def test_two_dyes_and_one(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    red, blue = (np.column_stack([(h + rng.normal(0, 3, 100)) % 180, rng.uniform(120, 220, 100), rng.uniform(100, 220, 100)]) for h in (178, 88))
    crops = [np.concatenate([red, blue[:60]]), red, np.concatenate([red, blue[:10]])]
    rows = [(k, *map(float, p)) for k, crop in enumerate(crops) for p in crop]
    found = colour.shirt_colours(spark.createDataFrame(rows, "crop_id long, h double, s double, v double"), "crop_id").orderBy("crop_id", "place").collect()
    both = [r for r in found if r.crop_id == 0]
    assert len(both) == 2 and min(both[0].h, 180 - both[0].h) < 6 and abs(both[1].h - 88) < 4
    assert [r.crop_id for r in found] == [0, 0, 1, 2]


def test_density_clusters(spark):
    rows = [(1, k, 10.0 + k % 3, 150.0, 120.0) for k in range(8)] + [(1, 20 + k, 110.0 + k % 2, 160.0, 120.0) for k in range(5)] + [(1, 40, 60.0, 60.0, 60.0)] + [(2, 0, 1.0, 1.0, 1.0)]
    got = {(r.match_id, r["item"]): r.team for r in clustering.classify_crops(spark.createDataFrame(rows, "match_id long, item long, h double, s double, v double")).collect()}
    assert all(got[1, k] == 0 for k in range(8)) and all(got[1, 20 + k] == 1 for k in range(5)) and got[1, 40] == got[2, 0] == -1


def test_tracker_reach_scales_with_height(spark):
    schema = "match_id long, shot_id long, frame_index long, det_id long, t_ms long, x1 double, y1 double, x2 double, y2 double"
    walk = [(1, 0, f, 0, f * 250, 100.0 + 3 * f, 50.0, 112.0 + 3 * f, 85.0) for f in range(5)]
    jump = [(2, 0, f, 0, f * 250, 100.0 + 400 * f, 50.0, 112.0 + 400 * f, 85.0) for f in range(2)]
    got = tracks.track_players(spark.createDataFrame(walk + jump, schema)).groupBy("match_id").agg(F.countDistinct("track_id").alias("n")).collect()
    assert {r.match_id: r.n for r in got} == {1: 1, 2: 2}


def test_settings_survive_a_broken_write(spark, tmp_path):
    at = str(tmp_path / "settings")
    one = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 1)], "user_id long, key string, value string, seq long")
    documents.save_settings(spark, at, one)
    (tmp_path / "settings" / "v7").mkdir()  # a version without its mark of success
    last = documents.save_settings(spark, at, one.filter("key = 'a'").withColumn("value", F.lit("z")))
    assert {(r.key, r.value) for r in spark.read.parquet(last).collect()} == {("a", "z"), ("b", "y")}


def test_origins_and_moments(spark):
    urls = ["http://localhost:80/x", "https://127.0.0.1", "http://[::1]:5000/", "http://localhost.evil.com", "null", None, "http://user@localhost/", "http://localhost@evil.com/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(services.origin_allowed(F.col("u"))).collect()]
    assert got == [True, True, True, False, False, False, True, False]
    offsets = spark.createDataFrame([(12.0,), (4.0,)], "r double").select(moments.offsets_outward(F.col("r")).alias("o")).collect()
    assert [r.o for r in offsets] == [[0.0, 5.0, -5.0, 10.0, -10.0], [0.0]]
