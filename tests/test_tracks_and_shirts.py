"""Tracks under a moving camera, chains and clips against plain replays, and the halves of a crop's hues against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.columns import colour_gap
from touchline.operators import colour, tracks

BOX = "match_id long, shot_id long, frame_index long, det_id long, t_ms long, x1 double, y1 double, x2 double, y2 double"
CAM = "match_id long, frame_index long, shot_id long, matrix array<double>"


def _pan(dx):
    return [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def _box(match, frame, det, x, y, t_ms=None):
    return (match, 0, frame, det, frame * 130 if t_ms is None else t_ms, x, y, x + 12, y + 26)


def test_a_pan_keeps_ids_and_a_cut_does_not(spark):
    dets, cam = [], []
    for f in range(6):
        dets += [_box(m, f, 0, 100.0 + 60 * f, 200.0) for m in (1, 2, 3)] + [_box(4, f, 0, 100.0, 200.0)]
        cam += [(1, f, 0, _pan(60.0 * f)), (2, f, int(f > 2), _pan(60.0 * f)), (4, f, int(f > 2), _pan(0.0))]
    boxes = spark.createDataFrame(dets, BOX)
    tracked = tracks.track_players(boxes, spark.createDataFrame(cam, CAM))
    n = {r.match_id: r.n for r in tracked.groupBy("match_id").agg(F.countDistinct("track_id").alias("n")).collect()}
    assert n == {1: 1, 2: 2, 3: 6, 4: 2}  # a pan; a pan with a cut; no camera rows: nothing can be related; a cut in a picture that stays
    plain = {r.match_id: r.n for r in tracks.track_players(boxes).groupBy("match_id").agg(F.countDistinct("track_id").alias("n")).collect()}
    assert plain == {1: 6, 2: 6, 3: 6, 4: 1}


def test_a_map_without_inverse_links_nothing(spark):
    cam = spark.createDataFrame([(1, 0, 0, _pan(0.0)), (1, 1, 0, [0.0] * 9), (1, 2, 0, None), (1, 3, 0, _pan(0.0))], CAM)
    boxes = spark.createDataFrame([_box(1, f, 0, 100.0, 50.0) for f in range(4)], BOX)
    got = [r.track_id for r in tracks.track_players(boxes, cam).orderBy("frame_index").collect()]
    assert got[0] == got[3] and len(set(got)) == 3
    assert tracks.track_players(boxes.filter("false"), cam).count() == 0


def _replay(dets, cam):
    """Frame by frame over pairs of frames: the place of a track's last box is carried by the map from its picture to this one."""
    shots = {f: s for _, f, s, _ in cam}
    maps = {f: np.array(m).reshape(3, 3) for _, f, _, m in cam}
    live, out, n = [], {}, 0
    for f in sorted({d[2] for d in dets}):
        own = sorted(d for d in dets if d[2] == f)
        live = [t for t in live if own[0][4] - t[1] <= 2000]
        pairs = []
        for k, (tid, at, last, place) in enumerate(live):
            if shots[last] != shots[f]:
                continue
            v = maps[f] @ np.linalg.inv(maps[last]) @ [*place, 1.0]
            for j, d in enumerate(own):
                gap = math.hypot((d[5] + d[7]) / 2 - v[0] / v[2], (d[6] + d[8]) / 2 - v[1] / v[2])
                if gap <= (1.2 + 11.0 * (d[4] - at) / 1000) * (d[8] - d[6]) / 1.75:
                    pairs.append((gap, k, j))
        taken = {}
        for gap, k, j in sorted(pairs):
            if k not in {v for v in taken.values()} and j not in taken:
                taken[j] = k
        for j, d in enumerate(own):
            place = ((d[5] + d[7]) / 2, (d[6] + d[8]) / 2)
            if j in taken:
                live[taken[j]] = (live[taken[j]][0], d[4], f, place)
                out[f, d[3]] = live[taken[j]][0]
            else:
                live.append((n, d[4], f, place))
                out[f, d[3]] = n
                n += 1
    return out


def test_many_bodies_under_a_camera_equal_a_plain_replay(spark):
    rng = random.Random(4)
    dets, cam = [], []
    for f in range(60):
        zoom, dx = 1 + 0.2 * math.sin(f / 5), 150 * math.sin(f / 3)
        cam.append((1, f, f // 25, [zoom, 0.01, dx, -0.01, zoom, 3.0 * f % 20, 1e-5, 0.0, 1.0]))
        for k in range(rng.randint(0, 9)):
            dets.append(_box(1, f, k, rng.uniform(0, 600), rng.uniform(0, 300), f * 320))
    got = tracks.track_players(spark.createDataFrame(dets, BOX), spark.createDataFrame(cam, CAM)).collect()
    want = _replay(dets, cam)
    groups = lambda pairs: {frozenset(k for k, t in pairs if t == own) for own in {t for _, t in pairs}}
    assert len(got) == len(dets) and groups([((r.frame_index, r.det_id), r.track_id) for r in got]) == groups(list(want.items()))


@pytest.mark.parametrize("part_rows", [1, 512])
def test_chains_equal_a_plain_replay(spark, monkeypatch, part_rows):
    monkeypatch.setattr(tracks, "PART_ROWS", part_rows)
    rng = random.Random(9)
    rows = []
    for m in range(4):
        t = 0.0
        for k in range(120):
            t += rng.choice((0.0, 0.1, 0.2, 0.3, 1.5))
            kit = (rng.choice((10.0, 100.0)), 150.0, rng.uniform(100, 140)) if rng.random() < 0.8 else (None,) * 3
            rows.append((m, k, t, t + rng.uniform(0.1, 0.9), *(rng.uniform(0, 120) for _ in range(4)), *kit))
    names = "match_id long, track_id long, start_sec double, end_sec double, x0 double, y0 double, x1 double, y1 double, h double, s double, v double"
    want = {}
    for m in range(4):
        chains = []
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            fitting = []
            for k, c in enumerate(chains):
                gap, d = r[2] - c[-1][3], math.dist(r[4:6], c[-1][6:8])
                kits = [x[8:] for x in c if x[8] is not None]
                like = r[8] is None or not kits or colour_gap(r[8:], tuple(np.median(kits, axis=0))) <= 60
                if 0 < gap <= 0.5 and like and d <= 0.08 * 640 * (1 + gap / 0.5):
                    fitting.append((d, k))
            k = min(fitting)[1] if fitting else len(chains)
            if not fitting:
                chains.append([])
            chains[k].append(r)
            want[m, r[1]] = k
    got = {(r.match_id, r.track_id): r.chain_id for r in tracks.chain_broken(spark.createDataFrame(rows, names), 640.0).collect()}
    assert got == want and len(set(want.values())) < 120


def test_middle_is_the_median():
    rng = random.Random(1)
    m, seen = tracks.Middle(), []
    for _ in range(60):
        seen.append(tuple(rng.choice((rng.uniform(0, 9), 3.0)) for _ in range(3)))
        m.add(seen[-1])
        assert m.middle() == pytest.approx(tuple(np.median(seen, axis=0)))


def test_halves_of_hues_equal_a_plain_search(spark):
    rng = random.Random(2)
    crops = {k: [rng.choice((rng.gauss(c, 4), rng.gauss(c + 70, 6), rng.uniform(0, 180))) % 180 for _ in range(90)] for k, c in enumerate((3, 60, 120, 175))}
    crops[9] = [5.0] * 60
    got = {r.crop_id: r.cut for r in colour.hue_halves(spark.createDataFrame([(k, h) for k, hs in crops.items() for h in hs], "crop_id long, h double"), "crop_id").collect()}
    want = {}
    for k, hs in crops.items():
        best = []
        for cut in sorted({int(h) for h in hs}):
            sides = [[h for h in hs if ((int(h) - cut) % 180 < 90) == own] for own in (True, False)]
            if all(sides):
                best.append((-round(sum(abs(sum(np.exp(2j * math.pi * int(h) / 180) for h in side)) for side in sides), 6), cut))
        if best:
            want[k] = min(best)[1]
    assert got == want and 9 not in got


def test_shirts_at_the_edges(spark):
    schema = "crop_id long, h double, s double, v double"
    few = [(1, 178.0, 200.0, 200.0)] * 20 + [(1, 60.0, 200.0, 200.0)] * 20
    dull = [(2, 178.0, 60.0, 200.0)] * 40 + [(2, 60.0, 60.0, 200.0)] * 30
    even = [(3, 170.0, 200.0, 200.0)] * 40 + [(3, 80.0, 200.0, 200.0)] * 40
    grey = [(4, 20.0, 10.0, 200.0)] * 9
    found = colour.shirt_colours(spark.createDataFrame(few + dull + even + grey, schema), "crop_id").collect()
    places = {k: sorted(r.place for r in found if r.crop_id == k) for k in (1, 2, 3, 4)}
    assert places == {1: [1], 2: [1], 3: [1, 2], 4: [1]}
    assert next(r for r in found if r.crop_id == 2).h == pytest.approx(178.0) and next(r for r in found if r.crop_id == 4).h == pytest.approx(20.0)
    assert colour.shirt_colours(spark.createDataFrame([], schema), "crop_id").count() == 0
