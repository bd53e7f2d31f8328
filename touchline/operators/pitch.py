"""Pitch geometry: landmarks as a table, homographies fitted per frame, and projection as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.grouped import fold_groups
from touchline.tables import Stage

# The 33 spots of a pitch as (name, share of the length, share of the width, metres added along, metres added across).
LANDMARKS = (
    ("corner_near_left", 0.0, 0.0, 0.0, 0.0),
    ("corner_far_left", 0.0, 1.0, 0.0, 0.0),
    ("corner_near_right", 1.0, 0.0, 0.0, 0.0),
    ("corner_far_right", 1.0, 1.0, 0.0, 0.0),
    ("penarea_L_goalline_near", 0.0, 0.5, 0.0, -20.16),
    ("penarea_L_goalline_far", 0.0, 0.5, 0.0, 20.16),
    ("penarea_L_outer_near", 0.0, 0.5, 16.5, -20.16),
    ("penarea_L_outer_far", 0.0, 0.5, 16.5, 20.16),
    ("goalarea_L_goalline_near", 0.0, 0.5, 0.0, -9.16),
    ("goalarea_L_goalline_far", 0.0, 0.5, 0.0, 9.16),
    ("goalarea_L_outer_near", 0.0, 0.5, 5.5, -9.16),
    ("goalarea_L_outer_far", 0.0, 0.5, 5.5, 9.16),
    ("penspot_L", 0.0, 0.5, 11.0, 0.0),
    ("post_L_near", 0.0, 0.5, 0.0, -3.66),
    ("post_L_far", 0.0, 0.5, 0.0, 3.66),
    ("halfway_near", 0.5, 0.0, 0.0, 0.0),
    ("halfway_far", 0.5, 1.0, 0.0, 0.0),
    ("centre_spot", 0.5, 0.5, 0.0, 0.0),
    ("circle_near", 0.5, 0.5, 0.0, -9.15),
    ("circle_far", 0.5, 0.5, 0.0, 9.15),
    ("circle_left", 0.5, 0.5, -9.15, 0.0),
    ("circle_right", 0.5, 0.5, 9.15, 0.0),
    ("penarea_R_goalline_near", 1.0, 0.5, 0.0, -20.16),
    ("penarea_R_goalline_far", 1.0, 0.5, 0.0, 20.16),
    ("penarea_R_outer_near", 1.0, 0.5, -16.5, -20.16),
    ("penarea_R_outer_far", 1.0, 0.5, -16.5, 20.16),
    ("goalarea_R_goalline_near", 1.0, 0.5, 0.0, -9.16),
    ("goalarea_R_goalline_far", 1.0, 0.5, 0.0, 9.16),
    ("goalarea_R_outer_near", 1.0, 0.5, -5.5, -9.16),
    ("goalarea_R_outer_far", 1.0, 0.5, -5.5, 9.16),
    ("penspot_R", 1.0, 0.5, -11.0, 0.0),
    ("post_R_near", 1.0, 0.5, 0.0, -3.66),
    ("post_R_far", 1.0, 0.5, 0.0, 3.66),
)
LENGTH, WIDTH, MAX_MEDIAN_PX = 100.0, 64.0, 6.0


def landmarks(spark: SparkSession) -> DataFrame:
    """``landmark, l, w, dx, dy``: the spot is (l * length + dx, w * width + dy)."""
    return spark.createDataFrame(list(LANDMARKS), "landmark string, l double, w double, dx double, dy double")


def place(clicks: DataFrame, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Clicks (match_id, frame_index, landmark, x, y) with the spot (px, py) of their landmark and its parts; unknown landmarks drop out."""
    spots = landmarks(clicks.sparkSession).select("*", (F.col("l") * length + F.col("dx")).alias("px"), (F.col("w") * width + F.col("dy")).alias("py"))
    return clicks.join(F.broadcast(spots), "landmark")  # 33 rows, always


def solve(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The projective map of points onto points in the least-squares sense, on normalised coordinates."""

    def scaled(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = scaled(src), scaled(dst)
    one = np.ones((len(src), 1))
    p, q = np.hstack([src, one]) @ a.T, np.hstack([dst, one]) @ b.T
    zero = np.zeros_like(p)
    rows = np.vstack([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-12:
        return None
    w = np.hstack([src, one]) @ h[2]
    return -h if (w < 0).sum() > (w > 0).sum() else h


def fit_homographies(placed: DataFrame) -> DataFrame:
    """``match_id, frame_index, h, residual``: pitch metres to pixels and the median error; frames of four distinct spots or more."""

    def fit(key: tuple, c: dict[str, np.ndarray]) -> tuple:
        empty = ([], [], [], [])
        if len(set(c["landmark"])) < 4:
            return empty
        src, dst = np.column_stack([c["px"], c["py"]]).astype(float), np.column_stack([c["x"], c["y"]]).astype(float)
        h = solve(src, dst)
        if h is None:
            return empty
        q = np.hstack([src, np.ones((len(src), 1))]) @ h.T
        error = np.sqrt(((q[:, :2] / q[:, 2:] - dst) ** 2).sum(axis=1))
        return [key[0]], [key[1]], [h.ravel().tolist()], [float(np.median(error))]

    rows = placed.select("match_id", "frame_index", "landmark", "px", "py", "x", "y")
    return fold_groups(rows, ("match_id", "frame_index"), ("landmark", "x", "y"), fit, "match_id long, frame_index long, h array<double>, residual double")


def apply_map(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3x3 map given as nine numbers; null beyond the horizon."""
    u, v, w = (h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2] for i in range(3))
    return F.when(w > 1e-9, u / w), F.when(w > 1e-9, v / w)


def inverse(h: Column) -> Column:
    """The inverse of a 3x3 map up to scale with the sign of the determinant: its adjugate."""
    m = lambda a, b, c, d: h[a] * h[b] - h[c] * h[d]
    det = h[0] * m(4, 8, 5, 7) - h[1] * m(3, 8, 5, 6) + h[2] * m(3, 7, 4, 6)
    adj = (m(4, 8, 5, 7), m(2, 7, 1, 8), m(1, 5, 2, 4), m(5, 6, 3, 8), m(0, 8, 2, 6), m(2, 3, 0, 5), m(3, 7, 4, 6), m(1, 6, 0, 7), m(0, 4, 1, 3))
    return F.array(*[F.when(F.abs(det) > 1e-12, a / det) for a in adj])


def unletterbox(boxes: DataFrame, width: float, height: float, size: float) -> DataFrame:
    """Boxes of a square, padded picture back in the pixels of the original, clipped to it."""
    gain = min(size / height, size / width)
    left, top = (size - round(width * gain)) / 2.0, (size - round(height * gain)) / 2.0
    back = lambda c, off, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col(c) - off) / gain))
    return boxes.withColumns({"x1": back("x1", left, width), "y1": back("y1", top, height), "x2": back("x2", left, width), "y2": back("y2", top, height)})


def multiply(a: Column, b: Column) -> Column:
    """The product of two 3x3 maps given as nine numbers each."""
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def to_pitch(h: Column, x: Column, y: Column) -> Column:
    """Metres (x, y) of a pixel under a map from metres to pixels; null at or beyond the horizon."""
    px, py = apply_map(inverse(h), x, y)
    return F.when(px.isNotNull(), F.struct(px.alias("x"), py.alias("y")))


def ground_distance(h: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres between two pixels on the ground; null if either can't be placed."""
    a, b = to_pitch(h, ax, ay), to_pitch(h, bx, by)
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def duplicate_clicks(clicks: DataFrame) -> DataFrame:
    """``match_id, frame_index, landmark, n`` of landmarks that were clicked twice in a frame."""
    return clicks.groupBy("match_id", "frame_index", "landmark").agg(F.count("*").alias("n")).filter("n > 1")


def fit_quality(errors: DataFrame, n_shared: int = 5) -> DataFrame:
    """``match_id, median_px, rms_px, dof`` of click errors (match_id, frame_index, landmark, error_px): two equations a distinct spot, two unknowns a frame and some shared."""
    g = errors.groupBy("match_id").agg(F.median("error_px").alias("median_px"), F.sqrt(F.avg(F.col("error_px") * F.col("error_px"))).alias("rms_px"), F.countDistinct("landmark").alias("k"), F.countDistinct("frame_index").alias("f"))
    return g.select("match_id", "median_px", "rms_px", (2 * F.col("k") - n_shared - 2 * F.col("f")).alias("dof"))


def calibration_status(given: Column, readable: Column, median_px: Column, has_track: Column, mapped: Column, most: float = MAX_MEDIAN_PX) -> Column:
    """Why a calibration is or isn't used, in the order in which it is looked at."""
    return F.when(~given, "not_supplied").when(~readable, "unreadable").when(F.lit(most > 0) & (median_px > most), "quality_rejected").when(~has_track, "no_camera_track").when(~mapped, "mapper_failed").otherwise("ok")


def coverage(contacts: DataFrame) -> DataFrame:
    """``match_id, contacts_metric, contacts_pixel, metric_coverage`` of contacts (match_id, measured)."""
    g = contacts.groupBy("match_id").agg(F.count_if("measured").alias("contacts_metric"), F.count_if(~F.col("measured")).alias("contacts_pixel"))
    return g.withColumn("metric_coverage", F.floor(F.col("contacts_metric") / (F.col("contacts_metric") + F.col("contacts_pixel")) * 10000 + 0.5) / 10000)


def camera_map(pose: np.ndarray, centre: tuple[float, float]) -> np.ndarray:
    """The map from pitch metres to pixels of a camera at (x, y, height) that looks along pan and below the horizon by tilt.

    ``pose``: x, y, height, pan, tilt, focal length, roll. Axes of the camera: right, down, forward."""
    x, y, height, pan, tilt, focal, roll = pose
    right = np.array([np.sin(pan), -np.cos(pan), 0.0])
    forward = np.array([np.cos(tilt) * np.cos(pan), np.cos(tilt) * np.sin(pan), -np.sin(tilt)])
    down = np.cross(forward, right)
    turn = np.array([[np.cos(roll), np.sin(roll)], [-np.sin(roll), np.cos(roll)]]) @ np.stack([right, down])
    axes = np.vstack([turn, forward])
    lens = np.array([[focal, 0.0, centre[0]], [0.0, focal, centre[1]], [0.0, 0.0, 1.0]])
    return lens @ np.column_stack([axes[:, 0], axes[:, 1], -axes @ np.array([x, y, height])])


def look_from(turns: np.ndarray, roll: float) -> np.ndarray:
    """The axes right, down and forward (..., n, 3, 3) of cameras by pan and tilt (..., n, 2) and a shared roll."""
    sp, st, cp, ct = np.sin(turns[..., 0]), np.sin(turns[..., 1]), np.cos(turns[..., 0]), np.cos(turns[..., 1])
    roll = np.asarray(roll)[..., None, None]
    flat = np.zeros_like(sp)
    right, down, forward = np.stack([sp, -cp, flat], -1), np.stack([-cp * st, -sp * st, -ct], -1), np.stack([cp * ct, sp * ct, -st], -1)
    return np.stack([np.cos(roll) * right + np.sin(roll) * down, np.cos(roll) * down - np.sin(roll) * right, forward], -2)


class PoseProblem:
    """Clicks of one match against one camera whose place, height, focal length and roll are shared, with pan and tilt per frame.

    The vector of unknowns is x, y, height, focal length, roll, then pan and tilt of each frame and, with ``shares``, the length and
    width of the pitch at the end: a spot is then its shares (l, w) of these plus the metres of its landmark (given in ``metres``)."""

    LOW, HIGH = (-40.0, -60.0, 1.2, 150.0, np.radians(-12.0)), (160.0, -0.5, 45.0, 6000.0, np.radians(12.0))
    SIZES = ((60.0, 40.0), (125.0, 90.0))
    FAR, NEAR_M, SOFT = 1e4, 0.5, 6.0

    def __init__(self, frame: np.ndarray, metres: np.ndarray, pixels: np.ndarray, centre: tuple[float, float], shares: np.ndarray | None = None) -> None:
        self.frames, self.of = np.unique(frame, return_inverse=True)
        self.metres, self.pixels, self.centre, self.shares = metres, pixels, centre, shares
        n = len(self.frames)
        sizes = self.SIZES if shares is not None else ((), ())
        self.low = np.concatenate([self.LOW, np.tile([-np.pi, np.radians(1.0)], n), sizes[0]])
        self.high = np.concatenate([self.HIGH, np.tile([np.pi, np.radians(85.0)], n), sizes[1]])

    def start(self, pan: float, tilt: float, length: float = LENGTH, width: float = WIDTH) -> np.ndarray:
        size = [length, width] if self.shares is not None else []
        return np.clip(np.concatenate([[length / 2, -12.0, 8.0, 800.0, 0.0], np.tile([pan, tilt], len(self.frames)), size]), self.low, self.high)

    def errors(self, v: np.ndarray) -> np.ndarray:
        """Differences in pixels, two a click, at most ``FAR``: all clicks at once, each along the axes of its frame, and for any number of vectors ``v``.

        Depths below ``NEAR_M`` go on as an exponential, and what they lack is added downwards squared. So a point behind the camera
        lies ever further below the picture, value and slope change without a jump, and the fit can climb back from there."""
        k = len(self.frames)
        spots = self.metres if self.shares is None else self.metres + self.shares * v[..., None, -2:]
        rays = np.concatenate([spots, np.zeros((*spots.shape[:-1], 1))], axis=-1) - v[..., None, :3]
        axes = look_from(v[..., 5 : 5 + 2 * k].reshape(*v.shape[:-1], k, 2), v[..., 4])[..., self.of, :, :]
        right, down, depth = np.moveaxis(np.einsum("...nij,...nj->...ni", axes, rays), -1, 0)
        lack = np.maximum(self.NEAR_M - depth, 0.0)
        depth = np.where(lack > 0, self.NEAR_M * np.exp(-np.minimum(lack / self.NEAR_M, 60.0)), depth)
        seen = np.stack([right, down + lack**2], axis=-1) * (v[..., None, 3] / depth)[..., None] + self.centre
        return np.clip(seen - self.pixels, -self.FAR, self.FAR)

    def solve(self, v: np.ndarray, rounds: int) -> tuple[np.ndarray, float, float]:
        """Damped least squares on errors that count less the larger they are; the unknowns, the median and the root mean square."""
        damp = 1e-2
        loss = lambda e: (np.sqrt(1 + (e / self.SOFT) ** 2) - 1).sum()
        e = self.errors(v)
        best = loss(e)
        for _ in range(rounds):
            step = 1e-6 * np.maximum(np.abs(v), 1e-2)
            jac = (self.errors(v + np.diag(step)) - e).reshape(len(v), -1).T / step
            weight = 1 / np.sqrt(1 + (e.ravel() / self.SOFT) ** 2)
            normal, slope = (jac * weight[:, None]).T @ jac, (jac * weight[:, None]).T @ e.ravel()
            for _ in range(8):
                new = np.clip(v - np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope, rcond=None)[0], self.low, self.high)
                e_new = self.errors(new)
                if loss(e_new) < best:
                    break
                damp *= 4
            else:
                break
            gain, v, e, best, damp = best - loss(e_new), new, e_new, loss(e_new), max(damp / 6, 1e-9)
            if gain < 1e-10 * (1 + best):
                break
        d = np.sqrt((e**2).sum(axis=1))
        return v, float(np.median(d)), float(np.sqrt((d**2).mean()))


PANS, TILTS, COARSE_ROUNDS, FINE_ROUNDS, FINALISTS = 12, (10.0, 28.0), 12, 120, 3


GOOD_SEED_PX = 12.0  # fixed value: a seed that ends above this median is not trusted


def fit_poses(placed: DataFrame, centre: tuple[float, float] = (320.0, 180.0), seeds: DataFrame | None = None, free_size: bool = False, stage: Stage | None = None) -> DataFrame:
    """``match_id, pose, frames, median_px, rms_px, seeded``: the camera of each match from placed clicks (match_id, frame_index, x, y, px, py).

    Twelve pans and two tilts are rows of their own: each match and start is solved coarsely by itself, the three best starts are
    solved to the end, and the best of those stands. A match has a few dozen clicks. ``seeds`` (match_id, pose; one a match) are
    solved first: matches whose seed ends well are done, those whose seed doesn't, or is null or not of the right length, are
    searched as if they had none, and the better of the two stands. With ``free_size`` (clicks as from ``place``, with l, w, dx, dy) the
    length and width of the pitch are the last two unknowns of ``pose``."""
    stage = stage or Stage(placed.sparkSession)
    starts = F.explode(F.array(*[F.struct(F.lit(k * len(TILTS) + j).alias("start"), F.lit(float(np.radians(30.0 * k - 150))).alias("pan"), F.lit(float(np.radians(t))).alias("tilt")) for k in range(PANS) for j, t in enumerate(TILTS)]))
    usable = placed.groupBy("match_id").agg(F.count("*").alias("n")).filter("n >= 4").select("match_id")
    parts = ("dx", "dy", "l", "w") if free_size else ("px", "py")
    clicks = placed.join(usable, "match_id").select("match_id", "frame_index", "x", "y", *parts)

    def solved(key: tuple, c: dict[str, np.ndarray], rounds: int) -> tuple:
        pairs = lambda a, b: np.column_stack([c[a], c[b]]).astype(float)
        p = PoseProblem(c["frame_index"], pairs(*parts[:2]), pairs("x", "y"), centre, pairs("l", "w") if free_size else None)
        if "begin" in c:
            begin = np.array([] if c["begin"][0] is None else c["begin"][0], float)
            if len(begin) != len(p.low) or not np.isfinite(begin).all():
                return ([],) * 6
            begin = np.clip(begin, p.low, p.high)
        else:
            begin = p.start(c["pan"][0], c["tilt"][0])
        v, median, rms = p.solve(begin, rounds)
        return [key[0]], [key[1]], [v.tolist()], [p.frames.tolist()], [median], [rms]

    schema = "match_id long, start int, pose array<double>, frames array<long>, median_px double, rms_px double"

    def fit(rows: DataFrame, rounds: int) -> DataFrame:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much to solve: not to be put together
        return fold_groups(rows, ("match_id", "start"), ("frame_index", *parts, "x", "y"), lambda key, c: solved(key, c, rounds), schema, tasks)

    polished = None
    if seeds is not None:
        given = clicks.join(seeds.select("match_id", F.col("pose").alias("begin")), "match_id").withColumn("start", F.lit(-1))
        polished = stage.write(fit(given, FINE_ROUNDS))
        clicks = clicks.join(polished.filter(F.col("median_px") <= GOOD_SEED_PX).select("match_id"), "match_id", "left_anti")
    coarse = fit(clicks.select("*", starts.alias("o")).select("*", "o.*").drop("o"), COARSE_ROUNDS)
    ranked = coarse.withColumn("k", F.row_number().over(Window.partitionBy("match_id").orderBy("median_px", "start"))).filter(F.col("k") <= FINALISTS)
    fine = fit(clicks.join(ranked.select("match_id", "start", F.col("pose").alias("begin")), "match_id"), FINE_ROUNDS)
    fine = fine if polished is None else fine.unionByName(polished)
    best = fine.groupBy("match_id").agg(F.min_by(F.struct("pose", "frames", "median_px", "rms_px", (F.col("start") < 0).alias("seeded")), F.struct("median_px", "start")).alias("b"))
    return best.select("match_id", "b.*")
