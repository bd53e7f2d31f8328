"""The ball smoother on a stream: one keyed state per match and shot, with the transitions of ``operators.smoothing``.

Samples may come in any order within the watermark. Each waits in a map until the watermark passes its time; then the samples that are
due go through the smoother in order of their frames, and what is known between two frames stays in the state store. A timer wakes a
shot when its next sample is due, and a last one, ``SILENCE_MS`` after its latest sample, removes the shot's state. A sample that comes
after later frames of its shot have gone out is too late for the fold; it goes out marked ``late`` and changes nothing, and those that
Spark itself drops behind the watermark are in the query's progress (``numRowsDroppedByWatermark``).

The state store must keep large states outside the heap; ``smooth_stream`` sets RocksDB for the session unless another store is set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from touchline.operators.smoothing import LOST, Track, advance

DELAY = "10 seconds"
START_MS = 86_400_000  # times of a match begin at 0, where a watermark begins too; event times begin a day later
SILENCE_MS = 60_000  # a shot without samples for so long is over
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_struct = lambda **kinds: StructType([StructField(n, t) for n, t in kinds.items()])
_NUMBER, _REAL, _FLAG = LongType(), DoubleType(), BooleanType()
OUTPUT = _struct(match_id=_NUMBER, shot_id=_NUMBER, frame_index=_NUMBER, x=_REAL, y=_REAL, conf=_REAL, seen=_FLAG, late=_FLAG)


def _place(x: float | None, y: float | None) -> tuple[float, float] | None:
    return None if x is None or y is None or pd.isna(x) or pd.isna(y) else (float(x), float(y))


class BallSmoother(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _struct(frame_index=_NUMBER), _struct(t_ms=_NUMBER, x=_REAL, y=_REAL, conf=_REAL))
        self.track = handle.getValueState("track", _struct(x=_REAL, y=_REAL, conf=_REAL, rx=_REAL, ry=_REAL, age=_NUMBER))
        self.seen = handle.getValueState("seen", _struct(out_frame=_NUMBER, last_ms=_NUMBER))  # the last frame that went out, and the latest time seen

    def _track(self) -> Track:
        if not self.track.exists():
            return LOST
        x, y, conf, rx, ry, age = self.track.get()
        return Track(_place(x, y), conf, _place(rx, ry), age)

    def _store(self, track: Track) -> None:
        self.track.update((*(track.trusted or (None, None)), track.conf, *(track.rumour or (None, None)), track.age))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out_frame, last_ms = self.seen.get() if self.seen.exists() else (-1, 0)
        first = not self.waiting.exists()
        late = []
        for pdf in rows:
            for frame, t_ms, x, y, conf in pdf[["frame_index", "t_ms", "x", "y", "conf"]].itertuples(index=False):
                last_ms = max(last_ms, int(t_ms))
                if frame <= out_frame:
                    late.append((*key, frame, None, None, None, None, True))
                else:
                    self.waiting.updateValue((int(frame),), (int(t_ms), *(_place(x, y) or (None, None)), 0.0 if pd.isna(conf) else float(conf)))
        self.seen.update((out_frame, last_ms))
        self._wake(first)
        if late:
            yield self._frame(late)

    def _wake(self, anew: bool = True) -> None:
        """A timer for the earliest waiting sample, or else for the end of the shot."""
        due = min((v[0] for v in self.waiting.values()), default=None)
        _, last_ms = self.seen.get()
        for at in list(self.handle.listTimers()):
            if at != due:
                self.handle.deleteTimer(at)
        self.handle.registerTimer(last_ms + SILENCE_MS if due is None else due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((frame[0], value) for frame, value in self.waiting.iterator() if value[0] <= now)
        out_frame, last_ms = self.seen.get()
        track, out = self._track(), []
        for frame, (_, x, y, conf) in ready:
            self.waiting.removeKey((frame,))
            if frame <= out_frame:
                out.append((*key, frame, None, None, None, None, True))
                continue
            track, said = advance(track, _place(x, y), conf)
            out.append((*key, frame, *(said or (None, None, 0.0, False)), False))
            out_frame = frame
        self._store(track)
        self.seen.update((out_frame, last_ms))
        if not ready and last_ms + SILENCE_MS <= now and not self.waiting.exists():
            for state in (self.waiting, self.track, self.seen):
                state.clear()
        else:
            self._wake()
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def smooth_stream(samples: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream of ``match_id, shot_id, frame_index, x, y, conf, seen, late`` of a stream of samples (match_id, shot_id, frame_index, t_ms, x, y, conf).

    For samples that are not late the rows are those of ``smooth_ball``, whatever the micro-batches."""
    conf = samples.sparkSession.conf
    if conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
    keyed = samples.select("match_id", "shot_id", "frame_index", (F.col("t_ms") + START_MS).cast("long").alias("t_ms"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("conf").cast("double").alias("conf"), F.timestamp_millis(F.col("t_ms") + START_MS).alias("ts"))
    return keyed.withWatermark("ts", delay).groupBy("match_id", "shot_id").transformWithStateInPandas(statefulProcessor=BallSmoother(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
