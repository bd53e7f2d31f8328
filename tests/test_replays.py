"""Merging of parallel tracks, the review log, counters and job folders against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import review, services, tracks
from touchline.sources import documents

POINTS = "match_id long, track_id long, t_ms long, x double, y double, h double, s double, v double"


def _middle_hue(hues):
    a = np.radians(np.array(hues) * 2)
    mean = np.arctan2(np.sin(a).mean(), np.cos(a).mean())
    return float(np.degrees(mean + np.median((a - mean + np.pi) % (2 * np.pi) - np.pi)) / 2 % 180)


def _kit(colours):
    voting = [c for c in colours if c[1] >= 40 and c[2] >= 50]
    return None if not colours else (_middle_hue([c[0] for c in (voting if len(voting) >= 4 else colours)]), float(np.median([c[1] for c in colours])), float(np.median([c[2] for c in colours])))


def _gap(a, b):
    raw = abs(a[0] - b[0])
    return float(np.sqrt(4 * min(raw, 180 - raw) ** 2 + (a[1] - b[1]) ** 2 + 0.25 * (a[2] - b[2]) ** 2))


def _plain_merge(rows, width):
    """{(track, t): (player, kept)} of one match: the first pair is merged until there is none."""
    tracks_, owner = {}, {}
    for _, k, t, x, y, *hsv in sorted(rows, key=lambda r: r[1]):
        one = tracks_.setdefault(k, {"points": {}, "colours": []})
        one["points"][t] = (x, y)
        owner[k, t] = [k, True]
        if hsv[0] is not None:
            one["colours"].append(tuple(hsv))
    while True:
        names = sorted(tracks_)
        found = None
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                p, q = tracks_[a], tracks_[b]
                shared = sorted(np.hypot(*np.subtract(p["points"][t], q["points"][t])) for t in p["points"].keys() & q["points"].keys())
                if len(shared) < 3 or shared[len(shared) // 2] > 0.035 * width:
                    continue
                ka, kb = _kit(p["colours"]), _kit(q["colours"])
                if ka and kb and _gap(ka, kb) > 60:
                    continue
                found = (a, b) if len(p["points"]) >= len(q["points"]) else (b, a)
                break
            if found:
                break
        if not found:
            return {k: tuple(v) for k, v in owner.items()}
        keep, drop = found
        for key, own in owner.items():
            if own[0] == drop:
                own[0] = keep
                own[1] = own[1] and key[1] not in tracks_[keep]["points"]
        gone = tracks_.pop(drop)
        tracks_[keep]["points"] = {**gone["points"], **tracks_[keep]["points"]}
        tracks_[keep]["colours"] += gone["colours"]


def _clip(rng, match):
    rows = []
    for player in range(4):
        at, kit = (rng.uniform(0, 600), rng.uniform(0, 300)), (rng.choice([5.0, 60.0, 120.0]), 180.0, 160.0)
        for copy in range(rng.choice([1, 2, 3, 4])):
            first, last = rng.randint(0, 10), rng.randint(11, 30)
            for t in range(first, last):
                hsv = (None, None, None) if rng.random() < 0.2 else ((kit[0] + rng.uniform(-4, 4)) % 180, kit[1] + rng.uniform(-9, 9), kit[2])
                rows.append((match, player * 10 + copy, 120 * t, at[0] + 6 * t + rng.uniform(-9, 9) * copy, at[1] + rng.uniform(-9, 9) * copy, *hsv))
    return rows


def test_parallel_tracks_as_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [r for m in range(5) for r in _clip(rng, m)]
    got = {(r.match_id, r.track_id, r.t_ms): (r.player, r.kept) for r in tracks.merge_parallel(spark.createDataFrame(rows, POINTS), 640.0).collect()}
    want = {(m, *k): v for m in range(5) for k, v in _plain_merge([r for r in rows if r[0] == m], 640.0).items()}
    assert got == want and any(k[1] != v[0] for k, v in got.items()) and any(not v[1] for v in got.values())


def test_literal_pairs(spark):
    track = lambda m, k, xs, kit: [(m, k, 120 * i, float(x), 250.0, *kit) for i, x in enumerate(xs)]
    yellow, black = (27.0, 200.0, 200.0), (0.0, 30.0, 40.0)
    rows = track(1, 0, [100, 300, 500, 700, 900], yellow) + track(1, 1, [900, 700, 500, 300, 100], yellow)  # only cross
    rows += track(2, 0, [200] * 5, yellow) + track(2, 1, [200] * 5, black)  # other kits
    rows += track(3, 0, [200] * 5, yellow) + track(3, 1, [203] * 7, yellow)  # one player, the longer takes
    rows += track(4, 0, [200] * 5, (None,) * 3) + track(4, 1, [203] * 5, black)  # colour unknown
    got = {(r.match_id, r.track_id): r.player for r in tracks.merge_parallel(spark.createDataFrame(rows, POINTS), 1000.0).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 1, (3, 0): 1, (3, 1): 1, (4, 0): 0, (4, 1): 0}
    assert tracks.merge_parallel(spark.createDataFrame([], POINTS), 640.0).count() == 0


ITEMS = "match_id long, rank int, crowded boolean, is_other_team boolean, kit_group int, appearance_group int, decision string"


def _plain_replay(items, choices):
    queue, decided, by, last = [dict(i) for i in sorted(items, key=lambda i: i["rank"]) if i["decision"] is None], {i["rank"]: i["decision"] for i in items}, {}, []
    for choice in choices:
        if choice == "undo":
            for q in last:
                decided[q["rank"]] = None
                by.pop(q["rank"])
            queue, last = last + queue, []
        elif queue:
            it, rest = queue[0], queue[1:]
            decided[it["rank"]] = choice
            same = lambda q: not it["crowded"] and not q["crowded"] and ((choice == "not_me" and it["is_other_team"] and q["is_other_team"] and q["kit_group"] >= 0 and q["kit_group"] == it["kit_group"]) or (not it["is_other_team"] and not q["is_other_team"] and it["appearance_group"] >= 0 and q["appearance_group"] == it["appearance_group"]))  # noqa: E731, B023
            last = [q for q in rest if same(q)]
            queue = [q for q in rest if not same(q)]
            for q in last:
                decided[q["rank"]], by[q["rank"]] = choice, it["rank"]
    return {r: (d, by.get(r)) for r, d in decided.items()}


def test_random_logs_as_a_plain_replay(spark):
    rng, items, log = random.Random(8), [], []
    for m in range(25):
        items += [(m, k, rng.random() < 0.1, rng.random() < 0.4, rng.randint(-1, 2), rng.randint(-1, 2), rng.choice([None] * 6 + ["me"])) for k in range(rng.randint(0, 40))]
        log += [(m, s, rng.choice(["me", "not_me", "not_me", "undo"])) for s in range(rng.randint(0, 30))]
    got = {}
    for r in review.replayed(spark.createDataFrame(items, ITEMS), spark.createDataFrame(log, "match_id long, seq long, choice string")).collect():
        got.setdefault(r.match_id, {})[r.rank] = (r.decision, r.settled_by)
    names = [c.split()[0] for c in ITEMS.split(", ")]
    for m in range(25):
        own = [dict(zip(names, i)) for i in items if i[0] == m]
        assert got.get(m, {}) == _plain_replay(own, [c for k, _, c in log if k == m]), m
    assert any(by is not None for d in got.values() for _, by in d.values())


def test_counters_come_with_the_action(spark):
    seen = [True, True, False, False, False, False, False, False, False, False, True]
    rows = [(1, 0, k, 1.0 if s or k == 2 else None, s) for k, s in enumerate(seen)]
    out, counters = services.counted_scans(spark.createDataFrame(rows, "match_id long, shot_id long, frame_index long, x double, detected boolean"))
    plan = [(r.frame_index, r.scanned, r.hit) for r in out.collect()]
    assert counters.get == {"frames": 11, "roi_hits": 1, "roi_misses": 2, "full_scans": sum(s and not h for _, s, h in plan), "skipped_full_scans": sum(not s for _, s, _ in plan)}
    assert counters.get["skipped_full_scans"] == 2


def test_job_folders_after_a_restart(spark, tmp_path):
    states = {"a": {"job_id": "a", "state": "running", "stage": "inference", "started_at": 5.5, "more": {"x": 1}}, "b": {"state": "done", "token": "t"}, "c": {"job_id": "c", "state": "queued"}, "d": {"job_id": "d"}}
    for name, state in states.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "job_state.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "c" / "job_state.json").write_text(json.dumps(states["c"], indent=2)[:-9])  # cut off
    (tmp_path / "a" / "result.json").write_text("{}")
    (tmp_path / "e").mkdir()
    jobs, broken = documents.hydrate(spark, str(tmp_path))
    got = {r.job_id: r for r in jobs.collect()}
    assert set(got) == {"a", "b"} and got["b"].state == "done" and got["b"].token == "t"
    assert (got["a"].state, got["a"].stage, got["a"].started_at) == ("interrupted", "error", 5.5) and got["a"].status == documents.INTERRUPTED["status"]
    assert sorted(r.file.split("/")[-2] for r in broken.collect()) == ["c", "d"]


@pytest.mark.parametrize("lines", [["{\"job_id\": \"1\", \"state\": \"done\"}", "{\"job_id\": \"2\", \"sta", "", "{\"job_id\": \"3\", \"state\": \"running\"}"]])
def test_job_lines(spark, tmp_path, lines):
    (tmp_path / "x.json").write_text("\n".join(lines))
    jobs, broken = documents.hydrate(spark, str(tmp_path), lines=True)
    assert {r.job_id: r.state for r in jobs.collect()} == {"1": "done", "3": "interrupted"} and broken.filter(F.col("text").isNotNull()).count() == 1
