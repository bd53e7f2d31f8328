"""Catalogue, limits and guards of the service around the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# fixed values
HOURLY_LIMIT, MAX_MESSAGES, MAX_CHARS, MAX_IMAGES = 20, 40, 24_000, 5
ROLES = ("system", "user", "assistant")
EFFORTS = ("none", "default", "low", "medium", "high")
LOCAL_HOSTS = ("127.0.0.1", "localhost", "::1")
TOKEN, CLIP_NAME = "^[a-f0-9]{12}$", r"^clip_(?:all|[a-f0-9]{8})_\d+_\d+\.mp4$"
LETTERS = "ABCDEFGH"


def merge_catalogue(server: DataFrame, local: DataFrame, key: str = "job_id") -> DataFrame:
    """Entries of both sides by key, newest first by ``analysed_at``; what the server has wins, a null of its own included.

    ``place`` numbers the entries of an owner (``owner``)."""
    fields = [c for c in dict.fromkeys([*server.columns, *local.columns]) if c != key]
    s, l = server.withColumn("on_server", F.lit(True)).alias("s"), local.withColumn("on_local", F.lit(True)).alias("l")
    both = s.join(l, F.col(f"s.{key}") == F.col(f"l.{key}"), "full_outer")

    def pick(c: str) -> Column:
        if c not in server.columns:
            return F.col(f"l.{c}")
        return F.col(f"s.{c}") if c not in local.columns else F.when(F.col("s.on_server"), F.col(f"s.{c}")).otherwise(F.col(f"l.{c}"))

    return both.select(F.coalesce(f"s.{key}", f"l.{key}").alias(key), *[pick(c).alias(c) for c in fields], F.coalesce("s.on_server", F.lit(False)).alias("on_server"))


def newest_first(entries: DataFrame, owner: str, time: str, tie: str) -> DataFrame:
    """Adds ``place`` of each entry among its owner's, newest first."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc_nulls_last(time), tie)))


def session_summary(sessions: DataFrame) -> DataFrame:
    """``job_id, has_session, n_actions`` of session documents (job_id, doc); one that can't be read has no session."""
    parsed = F.from_json("doc", "session struct<matchStats:array<string>,benchBlocks:array<string>,hybridResults:string>, matchStats array<string>, benchBlocks array<string>, hybridResults string", {"mode": "PERMISSIVE"})
    d = sessions.withColumn("d", parsed)
    at = lambda c: F.when(F.col("d.session").isNotNull(), F.col(f"d.session.{c}")).otherwise(F.col(f"d.{c}"))
    n = F.coalesce(F.size(at("matchStats")), F.lit(0))
    has = (n > 0) | (F.coalesce(F.size(at("benchBlocks")), F.lit(0)) > 0) | at("hybridResults").isNotNull()
    return d.select("job_id", has.alias("has_session"), F.greatest(n, F.lit(0)).alias("n_actions"))


def catalogue_entries(jobs: DataFrame, sessions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Finished jobs with their session and whether their video (token) is still there."""
    video = uploads.select("token").distinct().withColumn("video_available", F.lit(True))
    done = jobs.filter("state = 'done'").join(session_summary(sessions), "job_id", "left").join(video, "token", "left")
    fill = {"has_session": F.lit(False), "n_actions": F.lit(0), "video_available": F.lit(False), "opponent": F.lit("")}
    return done.withColumns({c: F.coalesce(c, v) for c, v in fill.items()}).withColumn("analysed_at", F.coalesce("finished_at", "started_at"))


def rate_limited(events: DataFrame, limit: int = HOURLY_LIMIT) -> DataFrame:
    """Adds ``limited``: whether the caller's allowance of that hour was used up before."""
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events.withColumn("limited", F.row_number().over(w) > limit)


def broken_circuit(events: DataFrame, failed: Column, cooldown: str = "INTERVAL 2 HOURS") -> DataFrame:
    """Adds ``blocked``: whether a failure before still keeps the circuit open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(failed, F.col("ts") + F.expr(cooldown))).over(w)
    return events.withColumn("blocked", F.coalesce(F.col("ts") < until, F.lit(False)))


def scan_schedule(frames: DataFrame, after: int = 4, every: int = 3) -> DataFrame:
    """Adds ``scanned``: after some misses in a row only every n-th frame is scanned, until the ball is seen again.

    What counts are the misses before a frame: of twelve misses the frames 1 to 4, 5, 8 and 11 are scanned."""
    runs = frames.withColumn("run", F.sum(F.when(F.col("detected"), 1).otherwise(0)).over(Window.partitionBy("match_id").orderBy("frame_index")))
    miss = F.row_number().over(Window.partitionBy("match_id", "run").orderBy("frame_index")) - F.when(F.col("run") == 0, 1).otherwise(2)
    return runs.withColumn("miss", miss).withColumn("scanned", F.col("detected") | (F.col("miss") < after) | ((F.col("miss") - after) % every == 0)).drop("run", "miss")


def counted_scans(frames: DataFrame) -> tuple[DataFrame, Observation]:
    """The schedule of ``scan_schedule`` with ``roi`` and ``hit``, and counters of it that any action on it fills.

    A frame is first searched around the ball's place in the frame before (``roi``), if the shot has one; ``hit`` is the ball found there."""
    known = F.lag("x").over(Window.partitionBy("match_id", "shot_id").orderBy("frame_index")).isNotNull()
    out = scan_schedule(frames).withColumn("roi", F.coalesce(known, F.lit(False))).withColumn("hit", F.col("roi") & F.col("detected"))
    counters = Observation()
    counts = {"roi_hits": F.col("hit"), "roi_misses": F.col("roi") & ~F.col("hit"), "full_scans": ~F.col("hit") & F.col("scanned"), "skipped_full_scans": ~F.col("hit") & ~F.col("scanned")}
    return out.observe(counters, F.count("*").alias("frames"), *[F.count_if(c).alias(n) for n, c in counts.items()]), counters


def chat_errors(messages: DataFrame, max_messages: int = MAX_MESSAGES, max_chars: int = MAX_CHARS, max_images: int = MAX_IMAGES) -> DataFrame:
    """``conv_id, error, n_messages``: the first thing wrong with each conversation (conv_id, turn, role, text, and n_images if known)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    images = F.col("n_images") if "n_images" in messages.columns else F.lit(0)
    t = messages.withColumns({"n": F.row_number().over(w), "chars": F.sum(F.length(F.coalesce("text", F.lit("")))).over(upto), "images": F.sum(images).over(upto)})
    err = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "invalid role")
        .when((images > 0) & (F.col("images") > max_images), "too many images")
        .when((images == 0) & (F.col("text").isNull() | (F.trim("text") == "")), "empty content")
        .when(F.col("chars") > max_chars, "too long")
    )
    out = t.withColumn("err", err).groupBy("conv_id").agg(F.min_by(F.col("err"), F.when(F.col("err").isNotNull(), F.col("n"))).alias("e"), F.max("n").alias("n_messages"))
    return out.select("conv_id", F.when(F.col("n_messages") > max_messages, "too many messages").otherwise(F.col("e")).alias("error"), "n_messages")


def content_error(kind: Column, value: Column, max_chars: int = MAX_CHARS, max_bytes: int = 4 << 20) -> Column:
    """What is wrong with a part of a message: text must not be empty or long, images must be inline."""
    text = F.when(F.coalesce(F.trim(value), F.lit("")) == "", "text part needs text").when(F.length(value) > max_chars, "text part too long")
    image = F.when(~F.coalesce(F.startswith(value, F.lit("data:image/")), F.lit(False)), "image must be inline").when(F.length(value) > max_bytes, "image too large")
    return F.when(kind == "text", text).when(kind == "image_url", image).otherwise("unsupported part")


def response_options(format_: Column, effort: Column) -> Column:
    """Only known values of the two options pass."""
    return F.struct(F.when(format_ == "json_object", format_).alias("response_format"), F.when(effort.isin(*EFFORTS), effort).alias("reasoning_effort"))


def origin_allowed(origin: Column, allow_files: bool = False) -> Column:
    """Pages of this machine only, by scheme and host; pages opened from files if allowed."""
    host = F.lower(F.regexp_extract(origin, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return F.when(origin == "null", allow_files).otherwise(F.coalesce(F.regexp_replace(host, r"[\[\]]", "").isin(*LOCAL_HOSTS), F.lit(False)))


def parse_stage(status: Column) -> Column:
    """The stage that a status line speaks of."""
    s = F.lower(F.coalesce(status, F.lit("")))
    has = lambda *words: s.rlike("|".join(words))
    return (
        F.when(has("stage 1", "stage 2"), "shot_filter")
        .when(has("stage 3", "deadtime"), "deadtime")
        .when(has("stage [4-7]", r"(shot|chunk)\s+\d+/\d+"), "inference")
        .when(has("stage 8", "possession"), "possession")
        .when(has("stage 9", "timestamp"), "timestamps")
        .when(has("done"), "done")
        .otherwise("running")
    )


def parse_progress(status: Column) -> Column:
    """``done, total, unit`` of a status line: shots of shots, steps of steps, or a number of live shots."""
    s = F.coalesce(status, F.lit(""))
    forms = ((r"(?i)shot\s*(\d+)\s*/\s*(\d+)", "shots"), (r"(\d+)\s*/\s*(\d+)", "steps"))
    number = lambda p, k: F.regexp_extract(s, p, k).cast("int")
    live = r"(?i)(\d+)\s+live\s+shot"
    out = F.when(s.rlike(live), F.struct(F.lit(0).alias("done"), number(live, 1).alias("total"), F.lit("shots").alias("unit"))).otherwise(F.struct(F.lit(None).cast("int").alias("done"), F.lit(None).cast("int").alias("total"), F.lit("").alias("unit")))
    for pattern, unit in reversed(forms):
        out = F.when(s.rlike(pattern), F.struct(number(pattern, 1).alias("done"), number(pattern, 2).alias("total"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def parse_choice(reply: Column, n_offered: int) -> Column:
    """The two letters (numbers from 0) that a model's reply picks, or null: a thought or fence around the JSON is left out,
    and an answer that isn't confident, is cut off in a thought, names what wasn't offered or names one twice is none."""
    raw = F.trim(reply)
    thought = F.contains(raw, F.lit("<think>"))
    after = F.when(thought, F.trim(F.regexp_extract(raw, r"(?s)^.*?</think>(.*)$", 1))).otherwise(raw)
    body = F.regexp_extract(after, r"(?s)(\{.*\})", 1)
    named = [F.trim(F.get_json_object(body, f"$.{k}")) for k in ("team_one", "team_two")]
    a, b = (F.when(v != "", F.position(F.upper(F.substring(v, 1, 1)), F.lit(LETTERS)) - 1) for v in named)
    sure = F.coalesce(F.get_json_object(body, "$.confident") != "false", F.lit(True))
    most = min(n_offered, len(LETTERS))
    return F.when(sure & a.between(0, most - 1) & b.between(0, most - 1) & (a != b), F.array(a, b))


def hex_list(field: Column) -> Column:
    """The colours (# and six more characters) of a JSON list; anything else gives none."""
    items = F.from_json(field, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(items, lambda v: F.coalesce(F.startswith(v, F.lit("#")) & (F.length(v) == 7), F.lit(False))), F.array().cast("array<string>"))


def filled_sections(sections: Column) -> Column:
    """The entries of a map of texts that aren't blank."""
    return F.map_filter(sections, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike(TOKEN), F.lit(False))


def valid_clip_name(name: Column) -> Column:
    return F.coalesce(name.rlike(CLIP_NAME), F.lit(False))


def request_classes(*classes: Column) -> Column:
    """Class ids in order, each once, those not set left out."""
    return F.array_distinct(F.array_compact(F.array(*classes)))
