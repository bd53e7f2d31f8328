"""Kit colours: literal crops, and the clusters and swatches against plain loops."""

import colorsys
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import swatches as W

PIXELS = "match_id long, crop_id long, r int, g int, b int"
RED, BLUE, WHITE, NAVY, TURF, DRAB = (210, 30, 35), (25, 45, 200), (240, 240, 238), (18, 24, 70), (62, 126, 52), (78, 72, 70)


def _mix(rng, *parts):
    """Pixels of colours with their numbers, jittered."""
    return [tuple(min(255, max(0, v + rng.randint(-5, 5))) for v in c) for c, n in parts for _ in range(n)]


def _frame(spark, crops):
    return spark.createDataFrame([(m, c, *p) for (m, c), px in crops.items() for p in px], PIXELS)


@pytest.fixture(scope="module")
def turf(spark):
    rng = random.Random(1)
    rows = [(m, f, *p) for m in range(4) for f in range(3) for p in _mix(rng, (TURF, 260), ((38, 88, 34), 120), ((120, 92, 62), 60))]
    return spark.createDataFrame(rows, "match_id long, frame_index long, r int, g int, b int")


@pytest.fixture(scope="module")
def palette(turf):
    return W.pitch_palette(turf)


def test_lab_of_known_colours(spark):
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20), (128, 128, 128): (137, 128, 128)}
    rows = spark.createDataFrame(list(known), "r int, g int, b int").select("r", "g", "b", X.rgb_to_lab(F.struct("r", "g", "b")).alias("c")).collect()
    assert {(r.r, r.g, r.b): (r.c.l, r.c.a, r.c.b) for r in rows} == known
    assert spark.range(1).select(X.rgb_to_lab(F.lit(None).cast("struct<r:int,g:int,b:int>")).alias("c")).first().c is None


def test_palette_shares(palette):
    rows = palette.collect()
    for m in range(4):
        own = sorted((r for r in rows if r.match_id == m), key=lambda r: r.place)
        assert len(own) == 3 and own[0].share > own[1].share > own[2].share > 0.08 and sum(r.share for r in own) == pytest.approx(1.0)
        assert own[0].a < 110 and own[2].a > own[0].a  # turf is green, dirt is not


def test_no_turf_tells_nothing(spark, turf):
    sky = spark.createDataFrame([(9, 0, 110, 160, 240)] * 300, "match_id long, frame_index long, r int, g int, b int")
    assert W.pitch_reference(sky).count() == 0
    refs = W.pitch_reference(turf).collect()
    assert len(refs) == 4 and all(r.a < 115 and r.l < 160 for r in refs)


def test_lloyd_by_plain_rounds():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3):
        points = np.unique(rng.integers(0, 256, (60, 3)), axis=0)
        counts = rng.integers(1, 9, len(points))
        order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], -counts))
        points, counts = points[order], counts[order]
        centres = [tuple(map(float, points[0]))]
        gap = lambda p, c: sum((float(a) - b) ** 2 for a, b in zip(p, c))
        while len(centres) < k:
            best = max(range(len(points)), key=lambda i: (counts[i] * min(gap(points[i], c) for c in centres), -i))
            centres.append(tuple(map(float, points[best])))
        for _ in range(W.ROUNDS + 1):
            label = [min(range(k), key=lambda j: (gap(p, centres[j]), j)) for p in points]
            for j in range(k):
                own = [i for i, v in enumerate(label) if v == j]
                if own:
                    centres[j] = tuple(sum(int(counts[i]) * int(points[i][c]) for i in own) / sum(int(counts[i]) for i in own) for c in range(3))
        assert W.lloyd(points, counts, k).tolist() == label
    assert W.lloyd(np.array([[1, 2, 3]]), np.array([7]), 3).tolist() == [0]


def _read(spark, palette, *parts, seed=2):
    rows = W.standout_colours(_frame(spark, {(0, 1): _mix(random.Random(seed), *parts)}), palette).orderBy("place").collect()
    return [(r.r, r.g, r.b) for r in rows]


def _near(colour, want, tolerance=25):
    return max(abs(a - b) for a, b in zip(colour, want)) <= tolerance


def test_the_shirt_stands_out_and_not_the_larger_drab_part(spark, palette):
    assert _near(_read(spark, palette, (TURF, 60), (DRAB, 90), (RED, 50))[0], RED)
    assert _near(_read(spark, palette, (TURF, 60), (DRAB, 60), (WHITE, 60))[0], WHITE)


def test_halved_kits_have_two_colours_and_shaded_ones_one(spark, palette):
    assert {min((RED, BLUE), key=lambda w: sum(abs(a - b) for a, b in zip(w, c))) for c in _read(spark, palette, (RED, 80), (BLUE, 80))} == {RED, BLUE}
    assert len(_read(spark, palette, (WHITE, 80), (NAVY, 80))) == 2
    shade = tuple(int(v * 0.62) for v in RED)
    assert len(_read(spark, palette, (RED, 80), (shade, 80))) == 1
    assert _read(spark, palette, (TURF, 200)) == [] and _read(spark, palette, (RED, 6)) == []


def test_without_a_palette_the_band_of_grass_is_left_out(spark, palette):
    rows = W.standout_colours(_frame(spark, {(77, 1): _mix(random.Random(3), ((70, 130, 40), 80), (BLUE, 70))}), palette).collect()
    assert len(rows) == 1 and _near((rows[0].r, rows[0].g, rows[0].b), BLUE)


def test_readings_do_not_read_the_pixels_again(spark, palette):
    """What uses readings several times (kits, swatches) must not count and cluster all pixels each time."""
    out = W.standout_colours(_frame(spark, {(0, 1): _mix(random.Random(5), (TURF, 60), (RED, 50))}), palette)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "logicalrdd" not in plan and "aggregate" not in plan and out.count() == 1


def test_medians_of_counted_values():
    rng = np.random.default_rng(8)
    for size in range(1, 30):
        values, counts = rng.integers(0, 9, size), rng.integers(1, 5, size)
        assert W.weighted_median(values, counts) == np.median(np.repeat(values, counts))


def _match(m, kits, rng, crops=9):
    out = {}
    for c in range(crops):
        kit = kits[c % len(kits)]
        out[m, 100 * m + c] = _mix(rng, (TURF, 50), (DRAB, 9), *[(colour, 90 // len(kit)) for colour in kit])
    return out


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(4)
    crops = _match(0, [(RED,), (BLUE,)], rng) | _match(1, [(WHITE,), (NAVY,)], rng) | _match(2, [(RED, BLUE), (WHITE,)], rng, 18) | _match(3, [(RED,)], rng, 3)
    crops |= {(0, 50 + k): _mix(rng, (TURF, 150)) for k in range(4)} | {(0, 60): _mix(rng, ((128, 128, 128), 120))}
    return _frame(spark, crops)


def test_two_kits_per_match(matches, palette):
    sides = {}
    for r in W.lab_kits(W.standout_colours(matches, palette)).collect():
        sides.setdefault(r.match_id, {})[r.crop_id] = r.team
    assert set(sides) == {0, 1, 2}
    for m in (0, 1):
        own = [sides[m][100 * m + c] for c in range(9)]
        assert own == [own[0], own[1]] * 4 + [own[0]] and own[0] != own[1]
    assert own[0] == 0  # the larger side first


def test_votes(matches, palette):
    rows = {(r.match_id, r.team): r for r in W.kit_vote(matches, palette).collect()}
    assert {m for m, _ in rows} == {0, 1, 2}
    rgb = lambda h: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5))
    for m, kits in ((0, (RED, BLUE)), (1, (WHITE, NAVY))):
        for team, kit in zip(("team_a", "team_b"), kits):
            assert _near(rgb(rows[m, team].hex), kit) and rows[m, team].hexes == [rows[m, team].hex]
        assert (rows[m, "team_a"].n_crops, rows[m, "team_b"].n_crops) == (5, 4)
    halved = max((rows[2, t] for t in ("team_a", "team_b")), key=lambda r: len(r.hexes))
    assert len(halved.hexes) == 2 and not set(rows[2, "team_a"].hexes) & set(rows[2, "team_b"].hexes)


def test_swatches_by_plain_rounds(spark):
    rng, rows, kits = random.Random(6), [], {}
    for kit in range(40):
        colours = rng.sample([RED, BLUE, WHITE, NAVY, (230, 200, 20), (20, 150, 160)], rng.choice([1, 2, 3]))
        n = rng.choice([1, 2, 5, 9, 14, 30])
        kits[kit] = [tuple(min(255, max(0, v + rng.randint(-12, 12))) for v in rng.choice(colours)) for _ in range(n)]
        rows += [(kit, *map(float, c)) for c in kits[kit]]
    got = {r.kit: r.hexes for r in W.swatches(spark.createDataFrame(rows, "kit long, r double, g double, b double"), "kit").collect()}
    lab = {tuple(r[:3]): r.c for r in spark.createDataFrame(sorted({tuple(int(v) for v in c) for c in _centres(kits)}), "r int, g int, b int").select("r", "g", "b", X.rgb_to_lab(F.struct("r", "g", "b")).alias("c")).collect()}
    assert got == {kit: _plain_swatches(px, lab) for kit, px in kits.items()}
    assert {len(h) for h in got.values()} == {1, 2, 3}


def _split(px, k):
    counted = sorted(((-px.count(c), c) for c in set(px)))
    points, counts = np.array([c for _, c in counted]), np.array([-n for n, _ in counted])
    label = W.lloyd(points, counts, k)
    groups = [[c for (_, c), v in zip(counted, label) for _ in range(px.count(c)) if v == j] for j in range(k)]
    return sorted((g for g in groups if g), key=lambda g: -len(g))


def _centres(kits):
    return [np.mean(g, axis=0) for px in kits.values() for k in (2, 3) for g in _split(px, k)]


def _hex(c):
    return "#" + "".join(f"{int(v):02x}" for v in c)


def _plain_swatches(px, lab):
    best = [_hex(np.median(px, axis=0))]
    if len(px) >= 8 and len(_split(px, 2)[0]) >= 4:
        best = [_hex(np.median(_split(px, 2)[0], axis=0))]
    for k in (2, 3):
        groups = _split(px, k)
        if len(px) < max(8, 4 * k) or len(groups) < k or min(map(len, groups)) < 0.18 * len(px):
            break
        centres = [np.mean(g, axis=0) for g in groups]
        pairs = [(a, b) for i, a in enumerate(centres) for b in centres[i + 1 :]]
        colour = lambda c: lab[tuple(int(v) for v in c)]
        if any(np.linalg.norm(a - b) < 60 for a, b in pairs):
            break
        if any(np.hypot(colour(a).a - colour(b).a, colour(a).b - colour(b).b) <= 60 and abs(colour(a).l - colour(b).l) <= 120 for a, b in pairs):
            break
        best = [_hex(np.median(g, axis=0)) for g in groups]
    return best


def test_hues_of_literal_kits_stay_apart():
    """The colours of these tests are unlike in hue, so a wrong swatch can't pass as the right one."""
    hues = [colorsys.rgb_to_hsv(*[v / 255 for v in c])[0] for c in (RED, BLUE, TURF)]
    assert min(abs(a - b) for i, a in enumerate(hues) for b in hues[i + 1 :]) > 0.2
