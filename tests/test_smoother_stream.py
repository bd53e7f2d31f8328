"""The smoother on a stream gives the rows of the batch, whatever the micro-batches and the order within the watermark."""

import random
import uuid

import pytest

from touchline.operators.smoothing import smooth_ball
from touchline.streaming import smoother

SCHEMA = "match_id long, shot_id long, frame_index long, t_ms long, x double, y double, conf double"


def _samples(seed, matches=3, frames=160):
    rng, rows = random.Random(seed), []
    for m in range(matches):
        x, y = 300.0, 200.0
        for f in range(frames):
            x, y = x + rng.uniform(-40, 40), y + rng.uniform(-20, 20)
            sight = rng.random()
            jump = rng.choice([0.0, 0.0, 0.0, 200.0, 900.0])
            rows.append((m, f // 60, f, 100 * f + 7 * m, None if sight < 0.25 else x + jump, None if sight < 0.25 else y, None if sight > 0.95 else round(sight, 3)))
    return rows


def _run(spark, folder, batches, delay):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    name = f"smoothed_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = smoother.smooth_stream(stream, delay).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    return spark.table(name).collect(), progress


def _key(rows):
    return sorted((r.match_id, r.shot_id, r.frame_index, r.x, r.y, r.conf, r.seen) for r in rows)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_batches_equal_the_batch_fold(spark, tmp_path):
    rows, rng = _samples(1), random.Random(2)
    near = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 3000))  # out of order by up to three seconds
    closing = [(99, 0, 0, 10_000_000, 1.0, 1.0, 0.5)]  # moves the watermark past the end
    batches = [near[k : k + 90] for k in range(0, len(near), 90)] + [closing]
    got, _ = _run(spark, str(tmp_path), batches, "5 seconds")
    got = [r for r in got if r.match_id != 99]
    assert not any(r.late for r in got)
    assert _key(got) == _key(smooth_ball(spark.createDataFrame(rows, SCHEMA)).collect())


def test_late_samples_are_counted_and_change_nothing(spark, tmp_path):
    rows = _samples(3, matches=1, frames=50)
    late, rest = [r for r in rows if r[2] in (4, 9)], [r for r in rows if r[2] not in (4, 9)]
    closing = [(99, 0, 0, 10_000_000, 1.0, 1.0, 0.5)]
    got, progress = _run(spark, str(tmp_path), [rest, [(98, 0, 0, 20_000, 1.0, 1.0, 0.5)], late, closing], "1 second")
    own = [r for r in got if r.match_id == 0]
    assert _key([r for r in own if not r.late]) == _key(smooth_ball(spark.createDataFrame(rest, SCHEMA)).collect())
    dropped = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    assert dropped + sum(r.late for r in own) == 2


def test_the_state_of_a_silent_shot_goes(spark, tmp_path):
    rows = _samples(4, matches=2, frames=30)
    got, progress = _run(spark, str(tmp_path), [rows, [(97, 0, 0, 10_000_000, 1.0, 1.0, 0.5)], [(96, 0, 0, 20_000_000, 1.0, 1.0, 0.5)], [(95, 0, 0, 20_000_100, 1.0, 1.0, 0.5)]], "1 second")
    assert {r.match_id for r in got} >= {0, 1, 97}
    last = [op.customMetrics for op in progress[-1].stateOperators][0]
    assert progress[-1].stateOperators[0].numRowsTotal < progress[0].stateOperators[0].numRowsTotal, last
