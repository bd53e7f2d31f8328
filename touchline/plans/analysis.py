"""Queries over players, review, valuation, catalogue and service data, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import attribution as A
from touchline.operators import appearance as AP
from touchline.operators import folds, pitch
from touchline.operators import review as R
from touchline.operators import services as V_
from touchline.operators import valuation as V
from touchline.sources.projections import ACTIONS, BOXES, SAMPLES, duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def boxes(spark, sf_dir):
    return project(spark, sf_dir, "lineitem", BOXES)


def balls(spark, sf_dir):
    """One ball point per frame, from the orders."""
    return project(spark, sf_dir, "orders", ("o_orderkey AS frame_index", "CAST(o_custkey * 13 % 600 AS DOUBLE) AS x", "CAST(o_orderkey * 29 % 340 AS DOUBLE) AS y"))


_B = f"b AS {duck('lineitem', BOXES)}"
_BALL = "ball AS (SELECT o_orderkey AS frame_index, CAST(o_custkey * 13 % 600 AS DOUBLE) AS x, CAST(o_orderkey * 29 % 340 AS DOUBLE) AS y FROM orders)"
_DBOX = "sqrt(pow(greatest(x1 - x, 0.0, x - x2), 2) + pow(greatest(y1 - y, 0.0, y - y2), 2))"
_ELIGIBLE = f"""{_B}, {_BALL}, e0 AS (SELECT frame_index, x, y, det_id AS player, conf, x1, y1, x2, y2, y2 - y1 AS h, (y2 - y1) / greatest(x2 - x1, 1e-6) AS asp,
greatest(0.0, least(x2, x + 8) - greatest(x1, x - 8)) * greatest(0.0, least(y2, y + 8) - greatest(y1, y - 8)) AS i, (x2 - x1) * (y2 - y1) + 256 AS s FROM ball JOIN b USING (frame_index) WHERE class_id IN (1, 2)),
el AS (SELECT *, {_DBOX} AS d_box, sqrt((x - (x1 + x2) / 2) * (x - (x1 + x2) / 2) + (y - (y1 + (y2 - y1) * 5 / 6)) * (y - (y1 + (y2 - y1) * 5 / 6))) AS d_feet, greatest(1.0, (x2 - x1) * (y2 - y1)) AS area, greatest(1.0, h) AS height FROM e0
WHERE NOT (CASE WHEN (CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END) >= 0.25::DOUBLE THEN h < 16 OR asp < 1.8::DOUBLE ELSE h < 16 AND asp < 1.8::DOUBLE END) AND h >= 16 AND asp >= 1.3::DOUBLE AND asp <= 5.5::DOUBLE)"""
_RANKED = f"""{_ELIGIBLE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY d_feet, area, conf DESC, player) AS place FROM el WHERE d_box <= 80)"""


@query(f"WITH {_B} SELECT frame_index, first(det_id ORDER BY conf DESC, det_id) AS det_id, max(conf) AS conf FROM b WHERE class_id = 0 GROUP BY frame_index")
def q_best_ball(spark, sf_dir):
    return A.best_ball(boxes(spark, sf_dir)).select("frame_index", "det_id", "conf")


@query(f"WITH {_B} SELECT frame_index, det_id, (y2 - y1) >= 16 AND (y2 - y1) / greatest(x2 - x1, 1e-6) >= 1.3::DOUBLE AND (y2 - y1) / greatest(x2 - x1, 1e-6) <= 5.5::DOUBLE AS is_person FROM b")
def q_person_boxes(spark, sf_dir):
    return A.looks_like_person(boxes(spark, sf_dir)).select("frame_index", "det_id", "is_person")


@query(f"WITH {_B}, t AS (SELECT *, max(CASE WHEN class_id <> 0 THEN y2 - y1 END) OVER (PARTITION BY frame_index) AS tallest FROM b) SELECT frame_index, det_id FROM t WHERE class_id = 0 AND (tallest IS NULL OR x2 - x1 <= 0.45::DOUBLE * tallest)")
def q_plausible_balls(spark, sf_dir):
    return A.plausible_balls(boxes(spark, sf_dir)).select("frame_index", "det_id")


@query(f"WITH {_RANKED} SELECT frame_index, player, floor(d_feet * 10000 + 0.5) / 10000 AS d_feet FROM ranked WHERE place = 1")
def q_nearest_player(spark, sf_dir):
    return A.contesting(balls(spark, sf_dir), boxes(spark, sf_dir), 80.0).filter("place = 1").select("frame_index", "player", X.rounded(F.col("d_feet")).alias("d_feet"))


@query(
    f"""WITH {_RANKED}, a AS (SELECT * FROM ranked WHERE place = 1), c AS (SELECT * FROM ranked WHERE place = 2)
SELECT ball.frame_index, a.player, a.player IS NULL OR coalesce(c.d_box - a.d_box < 0.8::DOUBLE * a.height, false) AS ambiguous FROM ball LEFT JOIN a USING (frame_index) LEFT JOIN c ON c.frame_index = ball.frame_index"""
)
def q_contest_ambiguity(spark, sf_dir):
    return A.ambiguity(balls(spark, sf_dir), A.contesting(balls(spark, sf_dir), boxes(spark, sf_dir), 80.0))


@query(f"WITH {_ELIGIBLE}, n AS (SELECT frame_index, count(*) AS n FROM el WHERE d_box <= 90 GROUP BY frame_index) SELECT frame_index, coalesce(n, 0) AS n_near FROM ball LEFT JOIN n USING (frame_index)")
def q_crowd_count(spark, sf_dir):
    return A.crowd(balls(spark, sf_dir), boxes(spark, sf_dir))


@query(
    f"""WITH {_RANKED}, a AS (SELECT * FROM ranked WHERE place = 1), c AS (SELECT * FROM ranked WHERE place = 2), n AS (SELECT frame_index, count(*) AS n FROM el WHERE d_box <= 90 GROUP BY frame_index),
am AS (SELECT ball.frame_index, coalesce(n, 0) AS n_near, a.player IS NULL OR coalesce(c.d_box - a.d_box < 0.8::DOUBLE * a.height, false) AS ambiguous FROM ball LEFT JOIN a USING (frame_index) LEFT JOIN c ON c.frame_index = ball.frame_index LEFT JOIN n ON n.frame_index = ball.frame_index)
SELECT o_custkey AS contact_id, max(n_near) AS n_near, bool_or(ambiguous) AS ambiguous, max(n_near) >= 4 AND bool_or(ambiguous) AS crowded FROM am JOIN orders ON o_orderkey = frame_index GROUP BY o_custkey"""
)
def q_crowded_contacts(spark, sf_dir):
    """Each customer's orders are the sampled frames of one contact."""
    b, x = balls(spark, sf_dir), boxes(spark, sf_dir)
    seen = A.crowd(b, x).join(A.ambiguity(b, A.contesting(b, x, 80.0)), "frame_index")
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("frame_index"))
    return A.crowded_contacts(seen, frames)


@query(
    f"""WITH {_ELIGIBLE}, g AS (SELECT *, CASE WHEN player % 3 = 0 THEN NULL ELSE ((frame_index * 7 + player * 5) % 20)::DOUBLE END AS dist_m FROM el WHERE d_box <= 90),
n AS (SELECT frame_index, count(*) AS n FROM g WHERE coalesce(d_box <= 25 OR dist_m <= 8, true) GROUP BY frame_index) SELECT frame_index, coalesce(n, 0) AS n_near FROM ball LEFT JOIN n USING (frame_index)"""
)
def q_metric_crowd(spark, sf_dir):
    """The same where the distance on the pitch is known for two players in three."""
    metres = F.when(F.col("det_id") % 3 != 0, ((F.col("frame_index") * 7 + F.col("det_id") * 5) % 20).cast("double"))
    return A.crowd(balls(spark, sf_dir), boxes(spark, sf_dir).withColumn("dist_m", metres))


@query(f"WITH {_B} SELECT frame_index, det_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY conf DESC, det_id) AS k FROM b) WHERE k <= 3")
def q_most_confident(spark, sf_dir):
    """At most three boxes a frame; the limit of the detector itself is 300."""
    return folds.most_confident(boxes(spark, sf_dir), 3).select("frame_index", "det_id")


_CLIP = lambda c, off, most, gain: f"floor(least({most}.0, greatest(0.0, ({c} - {off}) / ({gain}))) * 10000 + 0.5) / 10000 AS {c}"


@query(f"WITH {_B} SELECT frame_index, det_id, {_CLIP('x1', '0.0', 1280, '640 / 1280.0::DOUBLE')}, {_CLIP('y1', '140.0', 720, '640 / 1280.0::DOUBLE')}, {_CLIP('x2', '0.0', 1280, '640 / 1280.0::DOUBLE')}, {_CLIP('y2', '140.0', 720, '640 / 1280.0::DOUBLE')} FROM b")
def q_unletterbox(spark, sf_dir):
    out = pitch.unletterbox(boxes(spark, sf_dir), 1280, 720, 640)
    return out.select("frame_index", "det_id", *[X.rounded(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH {_BALL}, e AS (SELECT frame_index, greatest(0, least(639, round_even(x * 1.1::DOUBLE - 90.5::DOUBLE, 0)))::INT AS l, greatest(0, least(359, round_even(y * 1.1::DOUBLE - 90.5::DOUBLE, 0)))::INT AS t, round_even(x * 1.1::DOUBLE + 90.5::DOUBLE, 0)::INT AS r, round_even(y * 1.1::DOUBLE + 90.5::DOUBLE, 0)::INT AS b FROM ball)
SELECT frame_index, l || ',' || t || ',' || greatest(l + 1, least(640, r)) || ',' || greatest(t + 1, least(360, b)) AS roi FROM e"""
)
def q_roi(spark, sf_dir):
    """The region around the last place of the ball, some of it beyond the frame."""
    return balls(spark, sf_dir).select("frame_index", F.array_join(X.roi(F.col("x") * 1.1, F.col("y") * 1.1, 90.5, 640, 360), ",").alias("roi"))


@query(
    f"""WITH {_B}, p AS (SELECT a.frame_index, a.det_id AS a, c.det_id AS c, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s
FROM b a JOIN b c ON a.frame_index = c.frame_index AND a.det_id < c.det_id) SELECT frame_index, a, c, floor(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0.0 END * 10000 + 0.5) / 10000 AS iou FROM p WHERE i > 0"""
)
def q_pair_iou(spark, sf_dir):
    b = boxes(spark, sf_dir).select("frame_index", "det_id", "x1", "y1", "x2", "y2")
    other = b.select("frame_index", *[F.col(c).alias(f"o_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    pairs = b.join(other, "frame_index").filter("det_id < o_det_id")
    value = X.iou(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    return pairs.withColumn("iou0", value).filter("iou0 > 0").select("frame_index", F.col("det_id").alias("a"), F.col("o_det_id").alias("c"), X.rounded(F.col("iou0")).alias("iou"))


_KIT = ("p_partkey", "CAST(p_partkey * 37 % 180 AS DOUBLE) AS h", "CAST(p_size * 5 AS DOUBLE) AS s", "CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey * 13 % 256 AS DOUBLE) END AS v")
_HSV = lambda h, s, v: f"sqrt(4 * pow(CASE WHEN abs(h - {h}) > 90 THEN 180 - abs(h - {h}) ELSE abs(h - {h}) END, 2) + pow(s - {s}, 2) + 0.25 * pow(v - {v}, 2))"


@query(f"WITH k AS {duck('part', _KIT)} SELECT p_partkey, floor({_HSV(110, 180, 120)} * 10000 + 0.5) / 10000 AS d FROM k")
def q_hsv_distance(spark, sf_dir):
    k = project(spark, sf_dir, "part", _KIT)
    return k.select("p_partkey", X.rounded(X.hsv_distance((F.col("h"), F.col("s"), F.col("v")), (F.lit(110.0), F.lit(180.0), F.lit(120.0)))).alias("d"))


_MINE, _OTHER = [(110.0, 180.0, 120.0), (8.0, 200.0, 160.0)], [(62.0, 160.0, 200.0)]
_NEAR = {"d": "least(" + ", ".join(_HSV(*map(int, c)) for c in _MINE) + ")", "e": _HSV(*map(int, _OTHER[0]))}
_TEAM = f"""k AS {duck('part', _KIT)}, d AS (SELECT *, CASE WHEN v IS NOT NULL THEN {_NEAR['d']} END AS d, CASE WHEN v IS NOT NULL THEN {_NEAR['e']} END AS e FROM k),
o AS (SELECT *, coalesce(((s < 55 AND v < 100) OR (s > 110 AND v > 130 AND h BETWEEN 20 AND 55)) AND NOT (d <= 60 OR e <= 60), false) AS official FROM d),
t AS (SELECT *, CASE WHEN d IS NULL THEN 'unknown' WHEN official THEN 'official' WHEN e + 20 < d THEN 'opponent' WHEN d + 20 < e THEN 'my_team' WHEN d > 115 THEN 'opponent' WHEN d <= 60 THEN 'my_team' ELSE 'unknown' END AS team FROM o)"""


@query(f"WITH {_TEAM} SELECT p_partkey, team, CASE WHEN team <> 'unknown' THEN team = 'my_team' END AS is_mine FROM t")
def q_team_classify(spark, sf_dir):
    return A.classify_team(project(spark, sf_dir, "part", _KIT), _MINE, _OTHER).select("p_partkey", "team", "is_mine")


@query(f"WITH {_TEAM} SELECT p_partkey, coalesce(CASE WHEN team <> 'unknown' THEN team = 'my_team' END, true) OR (p_partkey % 4 = 0 AND team NOT IN ('official', 'sideline')) AS kept FROM t")
def q_team_gate(spark, sf_dir):
    """The gate over classified kits: own and undecided contacts stay, crowded ones unless an official's."""
    kits = A.classify_team(project(spark, sf_dir, "part", _KIT), _MINE, _OTHER).withColumn("crowded", F.col("p_partkey") % 4 == 0)
    return kits.select("p_partkey", A.passes_gate().alias("kept"))


_SC = (
    "user_id % 64 AS match_id", "event_id AS contact_id", "event_id * 5 AS t_ms", "CAST(event_id * 7919 % 400 AS DOUBLE) AS dist", "CAST(event_id * 31 % 100 AS DOUBLE) / 10.0D AS dt",
    "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id * 17 % 101 AS DOUBLE) / 100.0D END AS app", "event_id % 5 = 0 AS crowded", "event_id % 3 <> 0 AS linked", "CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_mine",
)
_SCORED = f"""c AS {duck('events', _SC)},
c1 AS (SELECT *, CASE WHEN dt > 8 OR dist <= 80 + 60 * greatest(0.0, dt) THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 - 0.5::DOUBLE * ((dist - (80 + 60 * greatest(0.0, dt))) / greatest(80 + 60 * greatest(0.0, dt), 1e-6))) END AS prior FROM c),
c2 AS (SELECT *, greatest(0.0, least(1.0, coalesce(app, 0.5::DOUBLE) * prior)) AS product, list_filter([CASE WHEN app < 0.35::DOUBLE THEN 'appearance_mismatch' END, CASE WHEN linked AND prior <= 0.5 + 1e-9 AND dt <= 8 THEN 'outside_orbital' END, CASE WHEN NOT is_mine THEN 'other_team' END], lambda z: z IS NOT NULL) AS evidence FROM c1),
scored AS (SELECT *, CASE WHEN linked AND prior >= 1 AND (app IS NULL OR app < 0.6::DOUBLE) THEN greatest(product, 0.7::DOUBLE) ELSE product END AS conf FROM c2)"""
_MONT = f"""{_SCORED},
st AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY conf DESC, t_ms, contact_id) - 1 AS rank, CASE WHEN conf >= 0.85::DOUBLE AND linked THEN 'auto_accept' WHEN conf <= 0.15::DOUBLE OR len(evidence) > 0 THEN 'auto_hide' ELSE 'review' END AS own FROM scored),
mont AS (SELECT *, CASE WHEN crowded THEN 'review' ELSE own END AS status, CASE own WHEN 'auto_accept' THEN 'me' WHEN 'auto_hide' THEN 'not_me' END AS decision FROM st)"""
_BUDG = f"""{_MONT},
bud0 AS (SELECT *, status = 'review' AND sum(CASE WHEN status = 'review' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, crowded ORDER BY rank) > CASE WHEN crowded THEN 4 ELSE 8 END AS ov FROM mont),
bud AS (SELECT match_id, rank, contact_id, CASE WHEN ov AND crowded AND own <> 'review' THEN own WHEN ov THEN 'auto_hide' ELSE status END AS status, CASE WHEN ov AND crowded AND own <> 'review' THEN decision WHEN ov THEN 'not_me' ELSE decision END AS decision FROM bud0)"""


def scored(spark, sf_dir):
    c = project(spark, sf_dir, "events", _SC)
    c = c.withColumn("prior", X.orbital_prior(F.col("dist"), F.col("dt")))
    c = c.withColumn("evidence", R.negative_evidence(F.col("app"), F.col("prior"), F.col("linked"), F.col("dt"), F.col("is_mine")))
    return c.withColumn("conf", R.confidence(F.col("app"), F.col("prior"), F.col("linked")))


@query(f"WITH {_SCORED} SELECT contact_id, floor(prior * 10000 + 0.5) / 10000 AS prior, floor(conf * 10000 + 0.5) / 10000 AS conf FROM scored")
def q_orbital_prior(spark, sf_dir):
    return scored(spark, sf_dir).select("contact_id", X.rounded(F.col("prior")).alias("prior"), X.rounded(F.col("conf")).alias("conf"))


@query(f"WITH {_SCORED} SELECT contact_id, array_to_string(evidence, ',') AS evidence FROM scored")
def q_negative_evidence(spark, sf_dir):
    return scored(spark, sf_dir).select("contact_id", F.array_join("evidence", ",").alias("evidence"))


@query(f"WITH {_MONT} SELECT match_id, contact_id, rank, status, decision, greatest(0.0, t_ms / 1000.0::DOUBLE - 1) AS clip_start_sec, t_ms / 1000.0::DOUBLE + 1 AS clip_end_sec FROM mont")
def q_montage_rank(spark, sf_dir):
    return R.montage(scored(spark, sf_dir)).select("match_id", "contact_id", "rank", "status", "decision", "clip_start_sec", "clip_end_sec")


@query(f"WITH {_BUDG} SELECT * FROM bud")
def q_review_budget(spark, sf_dir):
    return R.budgets(R.montage(scored(spark, sf_dir)), 8, 4).select("match_id", "rank", "contact_id", "status", "decision")


_CH = "ch AS (SELECT user_id % 64 AS match_id, event_id % 50 AS rank, arg_max(CASE event_type WHEN 'click' THEN 'me' ELSE 'not_me' END, event_id) AS choice FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)"
_CHOICES = ("user_id % 64 AS match_id", "CAST(event_id % 50 AS INT) AS rank", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'me' WHEN 'view' THEN 'not_me' ELSE 'maybe' END AS choice")


def _items(spark, sf_dir):
    return R.budgets(R.montage(scored(spark, sf_dir)), 8, 4)


@query(f"""WITH {_BUDG}, {_CH} SELECT match_id, rank, contact_id, status, coalesce(choice, decision) AS decision FROM bud LEFT JOIN ch USING (match_id, rank)""")
def q_decisions(spark, sf_dir):
    return R.apply_decisions(_items(spark, sf_dir).select("match_id", "rank", "contact_id", "status", "decision"), project(spark, sf_dir, "events", _CHOICES))


_DUR = "d AS (SELECT user_id % 64 AS match_id, max(event_id) * 5 / 1000.0::DOUBLE AS duration_sec FROM events GROUP BY ALL)"


def durations(spark, sf_dir):
    return project(spark, sf_dir, "events", ("user_id % 64 AS match_id", "event_id")).groupBy("match_id").agg((F.max("event_id") * 5 / 1000.0).alias("duration_sec"))


@query(
    f"""WITH {_BUDG}, {_CH}, {_DUR}, s AS {duck('events', SAMPLES)}, me AS (SELECT match_id, contact_id, contact_id * 5 AS t_ms FROM bud LEFT JOIN ch USING (match_id, rank) WHERE coalesce(choice, decision) = 'me'),
o AS (SELECT *, CASE WHEN t_ms - 2000 - (lag(t_ms) OVER w + 2000) <= 5000 THEN 0 ELSE 1 END AS opens FROM me WINDOW w AS (PARTITION BY match_id ORDER BY t_ms, contact_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY match_id ORDER BY t_ms, contact_id) AS hotspot_id FROM o),
z AS (SELECT match_id, hotspot_id, min(t_ms) - 2000 AS a, max(t_ms) + 2000 AS b, count(*) AS n_contacts, max(t_ms) AS last_ms FROM g GROUP BY ALL),
near AS (SELECT z.match_id, z.hotspot_id, s.t_ms AS s_ms, s.frame_index, s.x, s.y FROM z JOIN s ON s.match_id = z.match_id AND s.x IS NOT NULL AND s.t_ms BETWEEN z.last_ms AND z.last_ms + 6000),
og AS (SELECT *, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM near WINDOW w AS (PARTITION BY match_id, hotspot_id ORDER BY s_ms, frame_index)),
gone AS (SELECT match_id, hotspot_id, min(s_ms) FILTER (WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) > 120) + 2000 AS gone FROM og GROUP BY ALL),
r AS (SELECT z.*, greatest(b, coalesce(gone, b)) AS e FROM z LEFT JOIN gone USING (match_id, hotspot_id))
SELECT match_id, hotspot_id, n_contacts, greatest(0.0, a - greatest(0.0, (3000 - (e - a)) / 2.0)) / 1000.0::DOUBLE AS start_sec, least((e + greatest(0.0, (3000 - (e - a)) / 2.0)) / 1000.0::DOUBLE, duration_sec) AS end_sec FROM r JOIN d USING (match_id)"""
)
def q_decided_hotspots(spark, sf_dir):
    """From the review queue through the user's decisions to hotspots that last until the ball leaves."""
    out = R.decided_hotspots(_items(spark, sf_dir), project(spark, sf_dir, "events", _CHOICES), project(spark, sf_dir, "events", SAMPLES), durations(spark, sf_dir))
    return out.select("match_id", "hotspot_id", "n_contacts", "start_sec", "end_sec")


# threat-point coefficients in tenths, made up for these tables; a real run supplies its own table
_COEFFS = [(m, p, a, int((len(a) * (3 + i) + 7 * j) % 23) - 8) for i, m in enumerate("MRH") for j, p in enumerate(("FW", "MF")) for a in ("Shot Taken", "Key Pass", "Goal", "Interception", "Dispossessed")]
_CO = "co(model, position, action, tp) AS (VALUES " + ", ".join(map(str, _COEFFS)) + ")"
_ACT = f"a0 AS {duck('events', ACTIONS)}"
# goals are folded in order by the engine, here by recursion over the goals of a match
_FREE = "list_filter(shots, lambda s: s.t <= g.t AND g.t - s.t <= 12 AND NOT list_contains(used, -s.k))"
_SUPP = f"""{_ACT},
g AS (SELECT match_id, seq, seconds AS t, row_number() OVER (PARTITION BY match_id ORDER BY seq) AS k FROM a0 WHERE action = 'Goal'),
sh AS (SELECT match_id, list({{'t': seconds, 'k': -seq}} ORDER BY seconds, -seq) AS shots FROM a0 WHERE action = 'Shot Taken' GROUP BY match_id),
rec AS (SELECT match_id, 0::BIGINT AS k, []::BIGINT[] AS used FROM sh UNION ALL
  SELECT r.match_id, g.k, CASE WHEN len({_FREE}) > 0 THEN list_append(used, -({_FREE}[-1].k)) ELSE used END
  FROM rec r JOIN g ON g.match_id = r.match_id AND g.k = r.k + 1 JOIN sh ON sh.match_id = r.match_id),
supp AS (SELECT match_id, unnest(used) AS seq FROM (SELECT match_id, arg_max(used, k) AS used FROM rec GROUP BY match_id))"""
_SUPP = _SUPP.replace("a0 AS", "a0 AS MATERIALIZED", 1)
_VAL = f"""{_SUPP}, {_CO},
act AS (SELECT a0.match_id, a0.seq, action, seconds, CASE WHEN position IN (SELECT position FROM co) THEN position ELSE 'MF' END AS position FROM a0 ANTI JOIN supp ON supp.match_id = a0.match_id AND supp.seq = a0.seq WHERE NOT (seconds BETWEEN 300 AND 600)),
w AS (SELECT position, action, sum(CASE WHEN model = 'M' THEN tp ELSE 0 END) AS m, sum(CASE WHEN model = 'R' THEN tp ELSE 0 END) AS r, sum(CASE WHEN model = 'H' THEN tp ELSE 0 END) AS h FROM co GROUP BY ALL),
v AS (SELECT act.*, coalesce(m, 0) AS m, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM act LEFT JOIN w USING (position, action))"""


def _valued(spark, sf_dir):
    actions = project(spark, sf_dir, "events", ACTIONS)
    bench = actions.select("match_id").distinct().select("match_id", F.lit(300.0).alias("start_sec"), F.lit(600.0).alias("end_sec"))
    return V.valued(V.counted(actions, bench), spark.createDataFrame(_COEFFS, "model string, position string, action string, tp long"))


@query(f"WITH RECURSIVE {_SUPP} SELECT * FROM supp")
def q_goal_shot_asof(spark, sf_dir):
    return V.suppressed_shots(project(spark, sf_dir, "events", ACTIONS))


@query(
    f"""WITH RECURSIVE {_VAL} SELECT match_id, sum(h) / 10.0::DOUBLE AS net, sum(CASE WHEN action IN {V.OFFENSIVE} THEN m ELSE 0 END) / 10.0::DOUBLE AS off_m, sum(CASE WHEN action IN {V.OFFENSIVE} THEN r ELSE 0 END) / 10.0::DOUBLE AS off_r,
sum(CASE WHEN action IN {V.DEFENSIVE} THEN m ELSE 0 END) / 10.0::DOUBLE AS def_m, sum(CASE WHEN action IN {V.DEFENSIVE} THEN r ELSE 0 END) / 10.0::DOUBLE AS def_r FROM v GROUP BY match_id"""
)
def q_valuation(spark, sf_dir):
    return V.performance(_valued(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_VAL} SELECT match_id, seq, seconds AS x, sum(h) OVER (PARTITION BY match_id ORDER BY seq) / 10.0::DOUBLE AS y FROM v UNION ALL SELECT DISTINCT match_id, -1, 0.0, 0.0 FROM v
UNION ALL SELECT match_id, 4611686018427387904, match_id % 3 * 1800.0, sum(h) / 10.0::DOUBLE FROM v WHERE match_id % 3 > 0 GROUP BY match_id"""
)
def q_wpa_chart(spark, sf_dir):
    v = _valued(spark, sf_dir)
    return V.chart(v, v.select("match_id").distinct().withColumn("duration_sec", F.col("match_id") % 3 * 1800.0))


@query(
    f"""WITH {_CO}, q AS (SELECT model, position, list(abs(tp) ORDER BY abs(tp)) AS a FROM co GROUP BY ALL) SELECT co.model, co.position, action,
(CASE WHEN tp < 0 THEN '-' ELSE '+' END) || CASE WHEN abs(tp) >= a[floor(0.66::DOUBLE * (len(a) - 1))::INT + 1] THEN 'high' WHEN abs(tp) >= a[floor(0.33::DOUBLE * (len(a) - 1))::INT + 1] THEN 'medium' ELSE 'low' END AS label FROM co JOIN q USING (model, position)"""
)
def q_coeff_labels(spark, sf_dir):
    return V.relative_labels(spark.createDataFrame(_COEFFS, "model string, position string, action string, tp long"))


@query(f"WITH {_ACT} SELECT match_id, action, count(*) AS n FROM a0 GROUP BY ALL")
def q_action_counts(spark, sf_dir):
    return project(spark, sf_dir, "events", ACTIONS).groupBy("match_id", "action").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ACT}, c AS (SELECT *, floor(seconds)::BIGINT AS t FROM a0) SELECT match_id, string_agg('[' || CASE WHEN t // 60 < 10 THEN '0' ELSE '' END || (t // 60)::VARCHAR || ':' || lpad((t % 60)::VARCHAR, 2, '0') || '] ' || action, ', ' ORDER BY seq) AS timeline FROM c GROUP BY match_id"""
)
def q_timeline(spark, sf_dir):
    return V.timeline(project(spark, sf_dir, "events", ACTIONS))


@query(
    """WITH srv AS (SELECT o_custkey AS entry, max(o_totalprice) AS price, max(o_orderdate) AS d, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'note' END AS note FROM orders GROUP BY o_custkey), loc AS (SELECT c_custkey AS entry, c_acctbal AS price, c_name AS name, 'own' AS note FROM customer)
SELECT coalesce(srv.entry, loc.entry) AS entry, CASE WHEN srv.entry IS NOT NULL THEN srv.price ELSE loc.price END AS price, CASE WHEN srv.entry IS NOT NULL THEN srv.note ELSE loc.note END AS note, name, srv.entry IS NOT NULL AS on_server FROM srv FULL JOIN loc ON srv.entry = loc.entry"""
)
def q_catalogue_merge(spark, sf_dir):
    """Whole tables: customers without orders are on the local side only, and what the server has wins, nulls included."""
    note = F.when(F.max("o_orderkey") % 2 == 0, "note")
    server = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("entry")).agg(F.max("o_totalprice").alias("price"), note.alias("note"))
    local = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("entry"), F.col("c_acctbal").alias("price"), F.col("c_name").alias("name"), F.lit("own").alias("note"))
    return V_.merge_catalogue(server, local, "entry")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'")
def q_catalogue_list(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'")
    return V_.newest_first(done, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "place")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 3 AS limited FROM events")
def q_rate_limit(spark, sf_dir):
    return V_.rate_limited(spark.read.parquet(f"{sf_dir}/events.parquet"), 3).select("event_id", "user_id", "limited")


@query(
    """WITH e AS (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM events)
SELECT event_id, coalesce(ts < failed + INTERVAL 2 HOUR, false) AS blocked FROM e"""
)
def q_circuit_breaker(spark, sf_dir):
    return V_.broken_circuit(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type") == "error").select("event_id", "blocked")


@query(
    f"""WITH s AS {duck('events', SAMPLES)}, m AS (SELECT *, sum(CASE WHEN detected THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS run FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, run ORDER BY frame_index) - CASE WHEN run = 0 THEN 1 ELSE 2 END AS miss FROM m) SELECT match_id, frame_index, detected OR miss < 4 OR (miss - 4) % 3 = 0 AS scanned FROM k"""
)
def q_backoff(spark, sf_dir):
    return V_.scan_schedule(project(spark, sf_dir, "events", SAMPLES)).select("match_id", "frame_index", "scanned")


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n, sum(length(coalesce(text, ''))) OVER w AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'invalid role' WHEN text IS NULL OR trim(text) = '' THEN 'empty content' WHEN chars > 2400 THEN 'too long' END AS err FROM t)
SELECT conv_id, CASE WHEN max(n) > 40 THEN 'too many messages' ELSE arg_min(err, n) FILTER (WHERE err IS NOT NULL) END AS error, max(n) AS n_messages FROM e GROUP BY conv_id"""
)
def q_chat_caps(spark, sf_dir):
    return V_.chat_errors(spark.read.parquet(f"{sf_dir}/conversations.parquet"), max_chars=2400)


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def q_html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query("SELECT event_id, CASE WHEN floor(event_id * 7 / 60) >= 60 THEN floor(event_id * 7 / 3600)::BIGINT || ':' || lpad((floor(event_id * 7 / 60)::BIGINT % 60)::VARCHAR, 2, '0') ELSE (floor(event_id * 7 / 60)::BIGINT)::VARCHAR END || ':' || lpad((event_id * 7 % 60)::VARCHAR, 2, '0') AS clock FROM events")
def q_clock_format(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.clock(F.col("event_id") * 7).alias("clock"))


@query(
    """WITH v AS (SELECT p_partkey, 'v' || (p_partkey % 4) || '.' || (p_size % 12) || CASE WHEN p_partkey % 9 = 0 THEN '-beta' WHEN p_partkey % 7 = 0 THEN '.x.5' ELSE '.1' END AS ver FROM part UNION ALL SELECT -p_partkey, p_name FROM part),
n AS (SELECT p_partkey, list_transform(string_split(regexp_extract(ver, '^v?(\\d+([.+-]\\d+)*)([.+-]|$)', 1), '.'), lambda z: TRY_CAST(z AS INT)) AS n FROM v) SELECT p_partkey, coalesce(n[1] IS NOT NULL AND n > [2, 3], false) AS newer FROM n"""
)
def q_version_cmp(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("v"), (F.col("p_partkey") % 4).cast("string"), F.lit("."), (F.col("p_size") % 12).cast("string"), F.when(F.col("p_partkey") % 9 == 0, "-beta").when(F.col("p_partkey") % 7 == 0, ".x.5").otherwise(".1"))
    both = p.select("p_partkey", text.alias("ver")).unionByName(p.select((-F.col("p_partkey")).alias("p_partkey"), F.col("p_name").alias("ver")))
    return both.select("p_partkey", X.is_newer(F.col("ver"), F.lit("2.3")).alias("newer"))


@query(
    """WITH o AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://localhost:' || page_id WHEN 1 THEN 'https://127.0.0.1/x' WHEN 2 THEN 'null' WHEN 3 THEN 'ftp://localhost' ELSE url END AS origin FROM pages)
SELECT page_id, coalesce(lower(regexp_extract(origin, '^https?://([^/?#:]*)', 1)) IN ('127.0.0.1', 'localhost', '::1'), false) AS allowed FROM o"""
)
def q_origin_allow(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://localhost:"), F.col("page_id").cast("string"))).when(F.col("page_id") % 5 == 1, "https://127.0.0.1/x").when(F.col("page_id") % 5 == 2, "null").when(F.col("page_id") % 5 == 3, "ftp://localhost").otherwise(F.col("url"))
    return p.select("page_id", V_.origin_allowed(own).alias("allowed"))


_CORR = """list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - list_avg(e)) * (g[i] - list_avg(g)))) / sqrt(list_sum(list_transform(e, lambda x: (x - list_avg(e)) * (x - list_avg(e)))) * list_sum(list_transform(g, lambda x: (x - list_avg(g)) * (x - list_avg(g)))))"""


@query(
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT label, min(vec_id) AS vec_id FROM v GROUP BY label), g AS (SELECT v.label, v.e AS g FROM v JOIN f USING (vec_id))
SELECT v.vec_id, floor(greatest(0.0, least(1.0, {_CORR})) * 10000 + 0.5) / 10000 AS app FROM v JOIN g ON g.label = v.label"""
)
def q_hist_corr(spark, sf_dir):
    """Correlation of each descriptor with its match's gallery of one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label is not null").select(F.col("label").alias("match_id"), "vec_id", F.col("embedding").cast("array<double>").alias("descriptor"))
    first = v.groupBy("match_id").agg(F.min_by("descriptor", "vec_id").alias("descriptor"))
    return AP.gallery_score(v, first).select("vec_id", X.rounded(F.col("app")).alias("app"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM v), g AS (SELECT label, e AS g FROM k WHERE n <= 3 AND label % 2 = 0)
SELECT v.vec_id, floor(max(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * g[i]))) * 10000 + 0.5) / 10000 AS score FROM v LEFT JOIN g ON g.label = v.label GROUP BY v.vec_id"""
)
def q_gallery_score(spark, sf_dir):
    """Best product with the gallery of a match, of one to three descriptors; odd matches have no gallery and no score."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("match_id"), "vec_id", F.col("embedding").cast("array<double>").alias("descriptor"))
    few = v.withColumn("k", F.row_number().over(Window.partitionBy("match_id").orderBy("vec_id"))).filter("k <= 3 and match_id % 2 = 0")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return AP.gallery_score(v, few, dot).select("vec_id", X.rounded(F.col("app")).alias("score"))


@query("WITH h AS (SELECT user_id, CAST(least(11, floor(value / 25)) AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, bin, floor(n::DOUBLE / max(n) OVER (PARTITION BY user_id) * 10000 + 0.5) / 10000 AS level FROM h")
def q_histogram(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null").groupBy("user_id", F.least(F.lit(11), F.floor(F.col("value") / 25)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return h.select("user_id", "bin", X.rounded(F.col("n").cast("double") / F.max("n").over(Window.partitionBy("user_id"))).alias("level"))


@query("WITH a AS (SELECT user_id, avg(sin(radians(2 * (event_id % 180)::DOUBLE))) AS s, avg(cos(radians(2 * (event_id % 180)::DOUBLE))) AS c FROM events GROUP BY user_id) SELECT user_id, floor(sqrt(s * s + c * c) * 10000 + 0.5) / 10000 AS concentration FROM a")
def q_hue_concentration(spark, sf_dir):
    angle = F.radians(2 * (F.col("event_id") % 180).cast("double"))
    a = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    return a.select("user_id", X.rounded(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))).alias("concentration"))
