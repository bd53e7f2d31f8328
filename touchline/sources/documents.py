"""Frames, result documents, job states and settings as tables in files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_BYTES = 10_000  # a smaller upload is incomplete
RESULT = "match_id long, version int, step string, items array<struct<contact_id:long,t_sec:double,strength:double,kinds:array<string>>>"


def sampled_frames(frames: DataFrame, every: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Every n-th frame by absolute index, between bounds; the bounds reach the scan."""
    bounds = [F.col("frame_index") >= first] if first is not None else []
    bounds += [F.col("frame_index") <= last] if last is not None else []
    return frames.filter(reduce(lambda a, b: a & b, [F.col("frame_index") % every == 0, *bounds]))


def probe(frames: DataFrame) -> DataFrame:
    """``match_id, n_frames, duration_sec, fps`` of the frames of each video, and whether their count agrees with their numbers."""
    g = frames.groupBy("match_id").agg(F.count("*").alias("n_frames"), (F.max("t_ms") - F.min("t_ms")).alias("ms"), (F.max("frame_index") - F.min("frame_index") + 1).alias("span"))
    return g.select("match_id", "n_frames", (F.col("ms") / 1000.0).alias("duration_sec"), F.when(F.col("ms") > 0, (F.col("n_frames") - 1) * 1000.0 / F.col("ms")).alias("fps"), (F.col("n_frames") == F.col("span")).alias("complete"))


def upload_error(exists: Column, n_bytes: Column, readable: Column, n_frames: Column) -> Column:
    """What is wrong with an upload, in the order in which it is looked at; null if nothing is."""
    return F.when(~exists, "missing").when(n_bytes < LEAST_BYTES, "incomplete").when(~readable, "unreadable").when(F.coalesce(n_frames, F.lit(0)) < 1, "no frames")


def trajectory_warnings(summary: DataFrame, least_ratio: float = 0.2) -> DataFrame:
    """Adds ``warnings`` to trajectory summaries (n, detected_ratio)."""
    cases = ((F.col("n") == 0, "empty trajectory"), ((F.col("n") > 0) & (F.col("detected_ratio") < least_ratio), "low ball-detection recall"))
    return summary.withColumn("warnings", F.array_compact(F.array(*[F.when(c, t) for c, t in cases])))


def footage_warnings(videos: DataFrame, most_width: int = 1280, long_sec: float = 1800.0) -> DataFrame:
    """Adds ``warnings`` to videos (width, height, duration_sec)."""
    low, wide = (F.col("height") > 0) & (F.col("height") < 540), F.col("width") > most_width
    cases = ((low, "low resolution"), (~F.coalesce(low, F.lit(False)) & wide, "analysed at a smaller width"), (F.col("duration_sec") >= long_sec, "long footage"))
    return videos.withColumn("warnings", F.array_compact(F.array(*[F.when(c, t) for c, t in cases])))


def result_documents(contacts: DataFrame, step: str, version: int = 1) -> DataFrame:
    """One JSON document for the contacts of each match (capped before, so a document is small)."""
    item = F.struct(F.col("contact_id"), (F.col("t_ms") / 1000.0).alias("t_sec"), F.floor(F.col("strength") * 10000 + 0.5).cast("long").alias("strength_1e4"), "kinds")
    docs = contacts.groupBy("match_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
    return docs.select("match_id", F.to_json(F.struct("match_id", F.lit(version).alias("version"), F.lit(step).alias("step"), "n", "items")).alias("doc"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (match_id, doc) as lines of text below ``path``."""
    docs.select("doc").write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of written documents; unknown keys are ignored, missing ones get a default, lines that are no document are left out."""
    schema = "match_id long, version int, step string, items array<struct<contact_id:long,t_sec:double,strength_1e4:long,kinds:array<string>>>"
    doc = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d")).filter("d.match_id is not null")
    rows = doc.select("d.match_id", F.coalesce("d.version", F.lit(1)).alias("version"), F.explode("d.items").alias("i"))
    return rows.select("match_id", "version", "i.contact_id", F.coalesce("i.t_sec", F.lit(0.0)).alias("t_sec"), (F.coalesce("i.strength_1e4", F.lit(0)) / 10000.0).alias("strength"), F.coalesce("i.kinds", F.array().cast("array<string>")).alias("kinds"))


def reloaded_jobs(jobs: DataFrame) -> DataFrame:
    """Job states after a restart: the latest document of each job, where one that was running is interrupted."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    last = jobs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    was = F.col("state") == "running"
    return last.withColumns({"state": F.when(was, "interrupted").otherwise(F.col("state")), "stage": F.when(was, "error").otherwise(F.col("stage"))})


INTERRUPTED = {"state": "interrupted", "stage": "error", "status": "Analysis was interrupted (server restarted)", "error": "The analysis stopped when the server restarted. Start a new run."}


def hydrate(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Job states found below a folder after a restart, and what could not be read there (``file, text``).

    Each job has a folder of its own with one document ``job_state.json``; with ``lines`` the files hold one document a line instead.
    Jobs that were running are interrupted, with a status that says so. A document without a job_id belongs to the job that its folder
    is named after; one that is cut off or no JSON is set aside, and so is one without a state. Unknown keys are ignored."""
    fields = "job_id string, token string, state string, stage string, status string, error string, started_at double, finished_at double, _broken string"
    reader = spark.read
    if not lines:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "job_state.json")
    text = reader.text(folder, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    read = text.withColumn("d", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).select("file", "value", "d.*")
    whole = F.col("_broken").isNull() & F.col("state").isNotNull()
    was = F.col("state") == "running"
    own = F.coalesce("job_id", F.lit(None) if lines else F.regexp_extract("file", "([^/]+)/[^/]+$", 1))
    states = read.filter(whole).withColumns({"job_id": own, **{c: F.when(was, v).otherwise(F.col(c)) for c, v in INTERRUPTED.items()}})
    return states.drop("_broken", "file", "value"), read.filter(~whole).select("file", F.col("value").alias("text"))


def running_job(jobs: DataFrame) -> DataFrame:
    """``token, job_id``: the first running job of each upload."""
    return jobs.filter("state = 'running'").groupBy("token").agg(F.min("job_id").alias("job_id"))


def merged_settings(saved: DataFrame, updates: DataFrame) -> DataFrame:
    """Settings (user_id, key, value) with later values in place of earlier ones."""
    both = saved.select("user_id", "key", "value", F.lit(-1).cast("long").alias("seq")).unionByName(updates.select("user_id", "key", "value", "seq"))
    return both.groupBy("user_id", "key").agg(F.max_by("value", "seq").alias("value"))


def save_settings(spark: SparkSession, path: str, updates: DataFrame) -> str:
    """Merge updates into the settings below ``path``: a new version is written whole, then the pointer moves to it, so a broken write leaves the old one."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    versions = sorted(int(n[1:]) for n in done if n.startswith("v") and n[1:].isdigit() and files.exists(fs.Path(f"{path}/{n}/_SUCCESS")))
    saved = spark.read.parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], "user_id long, key string, value string")
    at = f"{path}/v{versions[-1] + 1 if versions else 0}"
    merged_settings(saved, updates).write.mode("overwrite").parquet(at)
    return at


def ball_patrol(n: int, spark: SparkSession) -> DataFrame:
    """``i, x, y``: a made-up ball that turns every 18 frames and bounces off the edges (fixed values: 320, 180, 0.3, 1.9 and 30 a frame).

    The path is one running state, folded inside the JVM; a demonstration source of some thousand frames."""
    state = F.struct(F.lit(320.0).alias("x"), F.lit(180.0).alias("y"), F.lit(0.3).alias("a"), F.array().cast("array<struct<x:double,y:double>>").alias("path"))

    def move(s: Column, i: Column) -> Column:
        turned = s["a"] + F.when((i > 0) & (i % 18 == 0), 1.9).otherwise(0.0)
        x, y = s["x"] + 30 * F.cos(turned), s["y"] + 30 * F.sin(turned)
        out_x, out_y = (x <= 30) | (x >= 610), (y <= 30) | (y >= 330)
        after_x = F.when(out_x, F.lit(3.141592653589793) - turned).otherwise(turned)
        after = F.when(out_y, -after_x).otherwise(after_x)
        nx, ny = F.least(F.lit(610.0), F.greatest(F.lit(30.0), x)), F.least(F.lit(330.0), F.greatest(F.lit(30.0), y))
        return F.struct(nx.alias("x"), ny.alias("y"), after.alias("a"), F.concat(s["path"], F.array(F.struct(nx.alias("x"), ny.alias("y")))).alias("path"))

    path = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), state, move)["path"]
    return spark.range(1).select(F.posexplode(path).alias("i", "p")).select("i", "p.x", "p.y")
