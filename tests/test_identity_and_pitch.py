"""Pitch maps against known cameras."""

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import pitch


def test_map_of_a_known_camera_is_recovered():
    h = np.array([[6.0, 0.4, 30.0], [0.2, -3.0, 300.0], [0.001, 0.004, 1.0]])
    src = np.array([[0, 0], [105, 0], [0, 68], [105, 68], [52.5, 34], [16.5, 13.84]], float)
    q = np.hstack([src, np.ones((6, 1))]) @ h.T
    got = pitch.solve(src, q[:, :2] / q[:, 2:])
    assert np.allclose(got / got[2, 2], h, atol=1e-6)
    rng = np.random.default_rng(0)
    noisy = pitch.solve(src, q[:, :2] / q[:, 2:] + rng.normal(0, 0.5, (6, 2)))
    back = np.hstack([src, np.ones((6, 1))]) @ noisy.T
    assert np.abs(back[:, :2] / back[:, 2:] - q[:, :2] / q[:, 2:]).max() < 3


def test_inverse_map_and_fit_in_frames(spark):
    h = [6.0, 0.4, 30.0, 0.2, -3.0, 300.0, 0.001, 0.004, 1.0]
    df = spark.createDataFrame([(h, 20.0, 30.0)], "h array<double>, x double, y double")
    u, v = pitch.apply_map(F.col("h"), F.col("x"), F.col("y"))
    df = df.withColumns({"u": u, "v": v, "inv": pitch.inverse(F.col("h"))})
    bx, by = pitch.apply_map(F.col("inv"), F.col("u"), F.col("v"))
    row = df.select(bx.alias("bx"), by.alias("by")).first()
    assert abs(row.bx - 20) < 1e-6 and abs(row.by - 30) < 1e-6
    few = spark.createDataFrame([(1, 1, "centre_spot", 1.0, 2.0), (1, 1, "nowhere", 1.0, 2.0)], "match_id long, frame_index long, landmark string, x double, y double")
    assert pitch.fit_homographies(pitch.place(few)).count() == 0


def test_letterbox_round_trip(spark):
    gain, top = 640 / 1280, (640 - 360) / 2
    box = spark.createDataFrame([(100 * gain, 50 * gain + top, 300 * gain, 5000.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(pitch.unletterbox(box, 1280, 720, 640).first()) == (100.0, 50.0, 300.0, 720.0)


def test_camera_axes():
    h = pitch.camera_map(np.array([50.0, -12.0, 8.0, np.pi / 2, np.radians(12), 700.0, 0.0]), (320.0, 180.0))
    left, right, near, far = (h @ [x, y, 1.0] for x, y in ((40, 30), (60, 30), (50, 10), (50, 50)))
    place = lambda q: q[:2] / q[2]
    assert place(left)[0] < 320 < place(right)[0] and place(near)[1] > place(far)[1] and min(left[2], far[2]) > 0


def test_pose_of_a_known_camera_is_found():
    rng = np.random.default_rng(3)
    spots = np.array([(l * pitch.LENGTH + dx, w * pitch.WIDTH + dy) for _, l, w, dx, dy in pitch.LANDMARKS])
    frames, metres, pixels = [], [], []
    for f, pan in enumerate((82.0, 97.0)):
        q = np.column_stack([spots, np.ones(len(spots))]) @ pitch.camera_map(np.array([52.0, -15.0, 9.0, np.radians(pan), np.radians(14.0), 640.0, 0.0]), (320.0, 180.0)).T
        uv = q[:, :2] / q[:, 2:]
        seen = (q[:, 2] > 0) & (uv[:, 0] > 0) & (uv[:, 0] < 640) & (uv[:, 1] > 0) & (uv[:, 1] < 360)
        frames += [f] * seen.sum()
        metres.append(spots[seen])
        pixels.append(uv[seen] + rng.normal(0, 0.3, (seen.sum(), 2)))
    p = pitch.PoseProblem(np.array(frames), np.concatenate(metres), np.concatenate(pixels), (320.0, 180.0))
    assert min(p.solve(p.start(np.radians(pan), np.radians(10)), 80)[1] for pan in (60, 90, 120)) < 1.5


def _clicks(length, width, pose):
    rows = []
    for f, turn in enumerate((0.0, 15.0)):
        h = pitch.camera_map(np.array([*pose[:3], np.radians(82 + turn), np.radians(14.0), pose[3], pose[4]]), (320.0, 180.0))
        for name, l, w, dx, dy in pitch.LANDMARKS:
            u, v, depth = h @ [l * length + dx, w * width + dy, 1.0]
            if depth > 0 and 0 < u / depth < 640 and 0 < v / depth < 360:
                rows.append((f, name, float(u / depth), float(v / depth)))
    return rows


def test_errors_equal_the_map_of_each_frame_and_rise_smoothly_behind_the_camera():
    spots = np.array([(l * pitch.LENGTH + dx, w * pitch.WIDTH + dy) for _, l, w, dx, dy in pitch.LANDMARKS])
    of = np.arange(len(spots)) % 2
    p = pitch.PoseProblem(of, spots, np.zeros_like(spots), (320.0, 180.0))
    v = np.array([52.0, -15.0, 9.0, 640.0, 0.05, 1.3, 0.25, 1.7, 0.3])
    for k in (0, 1):
        q = np.column_stack([spots, np.ones(len(spots))]) @ pitch.camera_map(np.array([*v[:3], v[5 + 2 * k], v[6 + 2 * k], v[3], v[4]]), (320.0, 180.0)).T
        assert np.allclose(p.errors(v)[of == k], np.clip(q[:, :2] / q[:, 2:], -p.FAR, p.FAR)[of == k])
    one = lambda depth: pitch.PoseProblem(np.zeros(1), np.array([[50.0, -15.0 + depth]]), np.zeros((1, 2)), (0.0, 0.0)).errors(np.array([50.0, -15.0, 0.0, 1.0, 0.0, np.pi / 2, 0.0]))[0, 1]
    depths = np.arange(0.8, -1.0, -0.001)
    lows = np.array([one(d) for d in depths])
    assert (np.diff(lows) >= -1e-9).all() and np.abs(np.diff(lows[:400])).max() < 0.01 and one(-1.0) > 10 and one(-300.0) == 1e4


def test_seeds_and_free_sizes(spark):
    pose = [52.0, -15.0, 9.0, 640.0, 0.0]
    schema = "match_id long, frame_index long, landmark string, x double, y double"
    usual = _clicks(pitch.LENGTH, pitch.WIDTH, pose)
    clicks = pitch.place(spark.createDataFrame([(m, *r) for m in (1, 2, 3) for r in usual], schema))
    near = [51.0, -14.0, 9.5, 620.0, 0.01, np.radians(80.0), np.radians(13.0), np.radians(95.0), np.radians(13.0)]
    seeds = spark.createDataFrame([(1, [float(v) for v in near]), (2, [float(v) for v in near[:4]])], "match_id long, pose array<double>")
    got = {r.match_id: r for r in pitch.fit_poses(clicks, seeds=seeds).collect()}
    assert {m: r.seeded for m, r in got.items()} == {1: True, 2: False, 3: False} and all(r.median_px < 0.1 for r in got.values())
    assert np.allclose(got[1].pose[:4], pose[:4], rtol=0.02)
    small = pitch.place(spark.createDataFrame([(1, *r) for r in _clicks(90.0, 58.0, pose)], schema))
    free = pitch.fit_poses(small, seeds=spark.createDataFrame([(1, [float(v) for v in near] + [96.0, 62.0])], "match_id long, pose array<double>"), free_size=True).first()
    assert free.median_px < 0.2 and abs(free.pose[-2] - 90) < 3 and abs(free.pose[-1] - 58) < 3
    assert pitch.fit_poses(small, seeds=seeds.filter("match_id = 1")).first().median_px > free.median_px
