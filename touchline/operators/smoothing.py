"""Order-dependent smoothing of the ball: a table of transitions, folded over the frames of each shot.

What a frame does is decided by how far its sight lies from the trusted place:

| sight | effect |
|-|-|
| none | hold |
| any, nothing trusted | trust it |
| near (``MAX_STEP``) | trust it |
| far (up to ``MAX_JUMP``), borne out by the rumour | trust it |
| far, not borne out | becomes the rumour; hold |
| wild (beyond ``MAX_JUMP``) | the rumour is dropped; hold |

Trusting ends a rumour. Holding repeats the trusted place at ``FADE`` of its own confidence, for up to ``HOLD`` frames in a row;
after that nothing is trusted any more and nothing comes out. A missing sight leaves the rumour alone."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.grouped import fold_groups

# fixed values, in pixels of a frame 640 wide, degrees and frames
MAX_STEP, MAX_JUMP, TURN, RATIO, HOLD, FADE = 120.0, 500.0, 45.0, 1.6, 10, 0.6


class Track(NamedTuple):
    """What is known between two frames; ``age`` counts the frames since the trusted sight."""

    trusted: tuple[float, float] | None = None
    conf: float = 0.0
    rumour: tuple[float, float] | None = None
    age: int = 0


LOST = Track()


def borne_out(track: Track, sight: tuple[float, float]) -> bool:
    """A far sight agrees with the rumour: beside it, or going on from it the same way and not much faster."""
    if track.rumour is None:
        return False
    if math.dist(sight, track.rumour) <= MAX_STEP:
        return True
    legs = [(b[0] - a[0], b[1] - a[1]) for a, b in ((track.trusted, track.rumour), (track.rumour, sight))]
    first, second = (math.hypot(*leg) for leg in legs)
    if min(first, second) <= 0 or second > RATIO * first:
        return False
    cosine = sum(a * b for a, b in zip(*legs)) / (first * second)
    return math.degrees(math.acos(min(1.0, max(-1.0, cosine)))) <= TURN


def advance(track: Track, sight: tuple[float, float] | None, conf: float) -> tuple[Track, tuple[float, float, float, bool] | None]:
    """The state after a frame, and its place, confidence and whether it was seen there (or nothing)."""
    jump = None if sight is None or track.trusted is None else math.dist(sight, track.trusted)
    if sight is not None and (jump is None or jump <= MAX_STEP or (jump <= MAX_JUMP and borne_out(track, sight))):
        return Track(sight, conf), (*sight, conf, True)
    rumour = track.rumour if sight is None else sight if jump <= MAX_JUMP else None
    held = track._replace(rumour=rumour, age=track.age + 1)
    if held.trusted is None or held.age > HOLD:
        return LOST, None
    return held, (*held.trusted, FADE * held.conf, False)


def smooth_ball(samples: DataFrame) -> DataFrame:
    """``match_id, shot_id, frame_index, x, y, conf, seen`` after smoothing; one fold per match and shot, where the state begins anew."""

    def fold(key: tuple, c: dict[str, np.ndarray]) -> tuple:
        track, rows = LOST, []
        for x, y, conf in zip(c["x"].tolist(), c["y"].tolist(), c["conf"].tolist()):
            track, out = advance(track, None if x is None or y is None or x != x or y != y else (x, y), conf)
            rows.append(out or (None, None, 0.0, False))
        return *([k] * len(rows) for k in key), c["frame_index"], *zip(*rows)

    schema = "match_id long, shot_id long, frame_index long, x double, y double, conf double, seen boolean"
    keyed = samples.select("match_id", "shot_id", "frame_index", "x", "y", F.coalesce("conf", F.lit(0.0)).alias("conf"))
    return fold_groups(keyed, ("match_id", "shot_id"), ("frame_index",), fold, schema)
