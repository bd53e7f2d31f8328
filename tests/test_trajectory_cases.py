"""Literal trajectories, and plain replays of holds, scans and merging over a whole table."""

import pytest

from touchline.config import DEFAULT
from touchline.operators import contacts, services
from touchline.sources.projections import SAMPLES, project

DATA = "/root/testdata/sf0.01"
SCHEMA = "match_id long, shot_id long, frame_index long, t_ms long, x double, y double, detected boolean, interpolated boolean"


def _track(spark, rows, shot=lambda k: 0):
    """Rows (t, x, y, seen); x None is a miss, placed and not seen is held."""
    return spark.createDataFrame([(1, shot(k), k, round(1000 * t), None if x is None else float(x), None if x is None else float(y), seen, x is not None and not seen) for k, (t, x, y, seen) in enumerate(rows)], SCHEMA)


def _found(spark, rows, **kw):
    return contacts.merge_contacts(contacts.candidates(_track(spark, rows, **kw))).orderBy("contact_id").collect()


def test_holds_between_detections_only(spark):
    rows = [(0.2, 105, 50, True), (0.4, 105, 50, False), (0.6, 105, 50, False), (0.8, 120, 80, True), (1.0, 120, 80, False), (1.2, None, 0, False), (1.4, 120, 80, False), (1.6, 130, 80, True), (1.8, 130, 80, False)]
    got = [(r.hx, r.hy) for r in contacts.hold_positions(_track(spark, rows)).orderBy("frame_index").collect()]
    assert got == [(105.0, 50.0), (110.0, 60.0), (115.0, 70.0), (120.0, 80.0), (120.0, 80.0), (None, None), (120.0, 80.0), (130.0, 80.0), (130.0, 80.0)]
    cut = contacts.hold_positions(_track(spark, rows[:4], shot=lambda k: k // 2)).orderBy("frame_index").collect()
    assert [r.hx for r in cut] == [105.0, 105.0, 105.0, 120.0]


def test_twelve_misses_are_seven_scans(spark):
    rows = _track(spark, [(k / 10, None, 0, False) for k in range(12)])
    got = [r.frame_index + 1 for r in services.scan_schedule(rows).orderBy("frame_index").collect() if r.scanned]
    assert got == [1, 2, 3, 4, 5, 8, 11]
    after = _track(spark, [(0.0, 1, 1, True)] + [(k / 10, None, 0, False) for k in range(1, 13)])
    assert [r.frame_index for r in services.scan_schedule(after).orderBy("frame_index").collect() if r.scanned] == [0, 1, 2, 3, 4, 5, 8, 11]


def test_literal_contacts(spark, monkeypatch):
    monkeypatch.setattr(contacts, "smooth", lambda nodes: nodes.withColumns({"sx": nodes.x, "sy": nodes.y}))  # a window of one
    right = [(0.0, 0, 0, True), (0.1, 20, 0, True), (0.2, 40, 0, True)]
    assert _found(spark, [(0.1 * k, 20 * k, 0, True) for k in range(6)]) == []
    (turn,) = _found(spark, right + [(0.3, 40, 20, True), (0.4, 40, 40, True)])
    assert turn.kinds == ["direction_change"] and not turn.from_gap
    (stop,) = _found(spark, [(0.0, 0, 0, True), (0.1, 30, 0, True), (0.2, 60, 0, True), (0.3, 61, 0, True), (0.4, 61, 0, True)])
    assert stop.kinds == ["stop"]
    assert any("kick" in r.kinds for r in _found(spark, [(0.0, 0, 0, True), (0.1, 0, 0, True), (0.2, 2, 0, True), (0.3, 40, 0, True), (0.4, 80, 0, True)]))
    assert _found(spark, [*right, (0.3, None, 0, False), (0.4, 40, 20, True), (0.5, 40, 40, True), (0.6, 40, 60, True)]) == []
    (gap,) = _found(spark, [(0.0, 0, 0, True), (0.1, 20, 0, True), *[(0.2 + 0.1 * k, 20, 0, False) for k in range(5)], (0.7, 20, 60, True)])
    assert gap.from_gap and gap.strength <= 0.25
    (both,) = _found(spark, [(0.0, 0, 0, True), (0.1, 30, 0, True), (0.2, 60, 0, True), (0.3, 60, 30, True), (0.4, 60, 31, True), (0.5, 60, 31, True)])
    assert set(both.kinds) >= {"direction_change", "stop"} and both.n_merged == 2


def test_merging_goes_by_the_time_of_play(spark):
    """Two touches, one just before a cut and one just after it: twenty seconds of video apart, one contact of play."""
    found = spark.createDataFrame([(1, 0, 5, 4900, 4900, 1.0, 1.0, 0.5, ["stop"], False), (1, 1, 9, 25_000, 5100, 2.0, 2.0, 0.9, ["kick"], True)], "match_id long, shot_id long, frame_index long, t_ms long, clock_ms long, x double, y double, strength double, kinds array<string>, from_gap boolean")
    (one,) = contacts.merge_contacts(found).collect()
    assert (one.frame_index, one.t_ms, one.clock_ms, one.kinds, one.from_gap, one.n_merged) == (9, 25_000, 5100, ["stop", "kick"], True, 2)
    assert contacts.merge_contacts(found.drop("clock_ms")).count() == 2


def test_budgets_without_a_duration(spark):
    found = spark.range(700).selectExpr("1L AS match_id", "id AS contact_id", "id AS frame_index", "id * 450 AS t_ms", "1.0D AS strength").unionByName(spark.range(5).selectExpr("2L AS match_id", "id AS contact_id", "id AS frame_index", "id AS t_ms", "1.0D AS strength"))
    none = spark.createDataFrame([(1, None)], "match_id long, duration_sec double")
    got = {r.match_id: r["count"] for r in contacts.cap_candidates(found, none).groupBy("match_id").count().collect()}
    assert got == {1: DEFAULT.max_candidates, 2: 5}
    assert contacts.cap_candidates(found.filter("match_id = 1"), spark.createDataFrame([(1, 0.0)], "match_id long, duration_sec double")).count() == DEFAULT.max_candidates


def test_fair_budget_keeps_the_weak_late_ones(spark):
    rows = [(1, k, k, k * 100, 1.0) for k in range(100)] + [(1, 100 + k, 100 + k, 60_000 + k * 400, 0.1) for k in range(10)]
    kept = {r.contact_id for r in contacts.fair_cap(spark.createDataFrame(rows, "match_id long, contact_id long, frame_index long, t_ms long, strength double"), 20).collect()}
    assert len(kept) == 20 and kept >= set(range(100, 110))


def test_alternating_detections_become_misses(spark):
    points = [(100, 100), (215, 100)] * 4
    out = contacts.without_rejected(_track(spark, [(0.1333 * k, *p, True) for k, p in enumerate(points)])).orderBy("frame_index").collect()
    assert len(out) == 8 and all(r.x is None and not r.detected for r in out)
    single = [(100, 100), (217, 100), (100, 100), (104, 102)]
    assert all(r.detected for r in contacts.without_rejected(_track(spark, [(0.1333 * k, *p, True) for k, p in enumerate(single)])).collect())


@pytest.fixture(scope="module")
def samples(spark):
    return project(spark, DATA, "events", SAMPLES)


@pytest.fixture(scope="module")
def shots(samples):
    out = {}
    for r in samples.orderBy("match_id", "frame_index").collect():
        out.setdefault((r.match_id, r.shot_id), []).append(r)
    return out


def test_holds_as_a_plain_replay(samples, shots):
    want = {}
    for rows in shots.values():
        k = 0
        while k < len(rows):
            end = k
            while end < len(rows) and rows[end].interpolated and not rows[end].detected and rows[end].x is not None:
                end += 1
            if end == k:
                want[rows[k].match_id, rows[k].frame_index] = (rows[k].x, rows[k].y)
                k += 1
                continue
            a, b = rows[k - 1] if k else None, rows[end] if end < len(rows) else None
            line = a and b and a.detected and b.detected
            for r in rows[k:end]:
                share = (r.t_ms - a.t_ms) / (b.t_ms - a.t_ms) if line else 0.0
                want[r.match_id, r.frame_index] = (a.x + share * (b.x - a.x), a.y + share * (b.y - a.y)) if line else (r.x, r.y)
            k = end
    got = {(r.match_id, r.frame_index): (r.hx, r.hy) for r in contacts.hold_positions(samples).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) if want[k][0] is not None else got[k] == (None, None) for k in want)


def test_scans_as_a_plain_replay(samples):
    want, misses = {}, {}
    for r in samples.orderBy("match_id", "frame_index").collect():
        n = misses.get(r.match_id, 0)
        want[r.match_id, r.frame_index] = r.detected or n < 4 or (n - 4) % 3 == 0
        misses[r.match_id] = 0 if r.detected else n + 1
    assert {(r.match_id, r.frame_index): r.scanned for r in services.scan_schedule(samples).collect()} == want
