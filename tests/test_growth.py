"""Work that must not grow faster than its input."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import clips, contacts, intervals, moments, tracks


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def _rows(spark):
    return spark.range(9).select((F.col("id") % 2).alias("match_id"), F.col("id").alias("point_id"), (F.col("id") * 10).alias("t_ms"))


def test_no_window_reads_the_rest_of_a_match_for_each_row(spark):
    rows = _rows(spark)
    track = rows.select("match_id", "t_ms", F.col("t_ms").cast("double").alias("v"))
    seconds = rows.select("match_id", "point_id", F.col("t_ms").cast("double").alias("t_sec"))
    ranges = seconds.select("match_id", F.col("t_sec").alias("start_sec"), (F.col("t_sec") + 5).alias("end_sec"))
    asked = rows.withColumn("track_id", F.lit(1))
    points = asked.select("match_id", "track_id", "t_ms", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    held = rows.select("match_id", F.lit(0).alias("shot_id"), F.col("point_id").alias("frame_index"), "t_ms", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(True).alias("detected"), F.lit(False).alias("interpolated"))
    for out in (clips.as_of_nearest(rows, track, ["v"]), clips.interpolate(rows, track, "v"), intervals.clamp(seconds, ranges), moments.nearby(seconds.drop("point_id"), seconds), tracks.position_at(asked, points), contacts.hold_positions(held)):
        assert "unboundedfollowing" not in _plan(out)


def test_neighbours_on_both_sides_with_rows_at_equal_times(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 14), (1, 4, 15), (1, 5, 99), (2, 6, 5)], "match_id long, point_id long, t_ms long")
    track = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0)], "match_id long, t_ms long, v double")
    near = {r.point_id: (r.at_ms, r.v) for r in clips.as_of_nearest(rows, track, ["v"]).collect()}
    assert near == {1: (10, 1.0), 2: (10, 1.0), 3: (10, 1.0), 4: (10, 1.0), 5: (20, 3.0), 6: (None, None)}
    between = {r.point_id: r.v for r in clips.interpolate(rows, track, "v").collect()}
    assert between == {1: 1.0, 2: 1.0, 3: pytest.approx(1.8), 4: 2.0, 5: 3.0, 6: None}


def test_many_small_groups_share_their_batches(spark):
    """A fold is called once a group, whole and in order, also where a group goes on in the next batch or has a null key."""
    from touchline.operators.grouped import fold_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, i) for k in [*range(40), None] for i in range(7 if k == 5 else 2)], "k long, i long").repartition(5)
        out = fold_groups(rows, ("k",), ("i",), lambda key, c: ([None if key[0] != key[0] else key[0]], [",".join(str(int(i)) for i in c["i"])]), "k long, seen string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 41 and {r.k: r.seen for r in out} == {k: "0,1,2,3,4,5,6" if k == 5 else "0,1" for k in [*range(40), None]}


def _grouped_by_python(df):
    return "flatmapgroups" in _plan(df)


def test_folds_of_shots_clips_and_frames_are_not_handed_over_one_by_one(spark):
    from touchline.operators import pitch, smoothing

    frames = spark.range(4).select(F.lit(1).alias("match_id"), F.lit(0).alias("shot_id"), F.col("id").alias("frame_index"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("conf"))
    dets = spark.range(4).selectExpr("1L AS clip_id", "id AS frame_index", "0L AS det_id", "1.0D AS x", "1.0D AS y", "1.0D AS h", "1.0D AS s", "1.0D AS v")
    boxes = spark.range(4).selectExpr("1L AS match_id", "0L AS shot_id", "id AS frame_index", "0L AS det_id", "id * 40 AS t_ms", "1.0D AS x1", "1.0D AS y1", "9.0D AS x2", "30.0D AS y2")
    clicks = spark.range(4).selectExpr("1L AS match_id", "id AS frame_index", "'a' AS landmark", "1.0D AS x", "1.0D AS y", "1.0D AS px", "1.0D AS py")
    for out in (smoothing.smooth_ball(frames), tracks.seed_tracks(dets, 640.0), tracks.track_players(boxes), pitch.fit_homographies(clicks)):
        assert not _grouped_by_python(out)
    assert [r.track_id for r in tracks.seed_tracks(dets.unionByName(dets.withColumn("h", F.lit(None).cast("double"))), 640.0).collect()] == [0] * 4


def test_slopes_of_a_camera_are_found_in_one_pass():
    """Errors of many vectors at once are those of each by itself."""
    import numpy as np

    from touchline.operators import pitch

    rng = np.random.default_rng(1)
    for shares in (None, rng.random((8, 2))):
        p = pitch.PoseProblem(np.repeat([3, 7], 4), rng.random((8, 2)) * 60, rng.random((8, 2)) * 300, (320.0, 180.0), shares)
        many = p.start(1.4, 0.2) + rng.random((5, len(p.low)))
        assert np.allclose(p.errors(many), [p.errors(v) for v in many], rtol=1e-12)


def test_a_period_is_added_in_one_pass(spark):
    """Each copy of the ranges that is joined again costs a sort, and the sorts of a task add up."""
    ranges = spark.createDataFrame([(1, 0.0, 100.0), (1, 150.0, 200.0), (2, 0.0, 200.0), (3, 0.0, 200.0), (3, 0.0, 200.0), (4, 180.0, 190.0), (5, 0.0, 30.0), (5, 35.0, 200.0)], "match_id long, start_sec double, end_sec double")
    out = intervals.add_period(ranges, 200.0)
    assert "join" not in _plan(out)
    rows = {m: sorted((r.start_sec, r.end_sec) for r in out.collect() if r.match_id == m) for m in range(1, 6)}
    assert rows == {1: [(0, 100), (110, 140), (150, 200)], 2: [(0, 80), (120, 200)], 3: [(0, 80), (0, 200), (120, 200)], 4: [(54, 126), (180, 190)], 5: [(0, 30), (35, 101), (134, 200)]}


def test_two_groups_leave_a_match_in_its_parts(spark):
    """No row is sent to the task of its match, so a match of half the table is spread as well."""
    from touchline.operators import clustering, folds

    items = spark.range(6).selectExpr("1L AS match_id", "id AS item", "CAST(id % 2 * 90 AS DOUBLE) AS h", "200.0D AS s", "200.0D AS v")
    vectors = spark.range(6).selectExpr("1L AS match_id", "id AS item", "array(CAST(id % 2 AS DOUBLE), 1.0D) AS vector")
    for out in (clustering.two_kits(items), folds.two_means(vectors)):
        plan = _plan(out)
        assert "window" not in plan and plan.count("strategy=broadcast") >= 6
        sides = [r.side for r in out.orderBy("item").collect()]
        assert sides == sides[:2] * 3 and sides[0] != sides[1]
    assert {r.split for r in clustering.two_kits(items).collect()} == {True} and {r.split for r in clustering.two_kits(items.limit(2)).collect()} == {False}


def test_a_task_sorts_no_more_pixels_of_a_larger_table(spark, monkeypatch):
    from touchline.operators import colour

    px = spark.range(6000).selectExpr("id % 50 AS crop_id", "CAST(id * 7919 % 13 + id DIV 50 % 2 * 80 AS DOUBLE) AS h", "CAST(100 + id % 97 AS DOUBLE) AS s", "CAST(100 + id % 89 AS DOUBLE) AS v")
    px = px.union(px.limit(100).selectExpr("CAST(NULL AS BIGINT)", "h", "s", "v"))
    rows = lambda df: {(r.crop_id, r.place): pytest.approx((r.h, r.s, r.v)) for r in df.collect()}
    whole = rows(colour.shirt_colours(px, "crop_id"))
    monkeypatch.setattr(colour, "TASK_PIXELS", 100, raising=False)
    small = colour.shirt_colours(px, "crop_id")
    assert small.rdd.getNumPartitions() == 60
    assert {(r.crop_id, r.place): (r.h, r.s, r.v) for r in small.collect()} == whole and whole.keys() == {(k, p) for k in range(50) for p in (1, 2)}
