"""Queries over jobs, sessions, settings, replies and uploads, with their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions import columns as X
from touchline.operators import review as R
from touchline.operators import services as S
from touchline.operators import valuation as V
from touchline.sources import documents as D
from touchline.session import shared_folder
from touchline.sources.projections import SAMPLES, duck, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


JOBS = ("o_custkey AS job_id", "concat('t', CAST(o_custkey % 300 AS STRING)) AS token", "o_orderkey AS seq", "CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'done' END AS state", "CASE o_orderkey % 4 WHEN 0 THEN 'inference' ELSE 'done' END AS stage", "CAST(o_orderkey AS DOUBLE) AS started_at", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey + 5 AS DOUBLE) END AS finished_at", "CASE WHEN o_orderkey % 5 <> 0 THEN 'Rovers' END AS opponent")
_J = f"j AS {duck('orders', JOBS).replace('concat(', 'concat(').replace('AS STRING', 'AS VARCHAR')}"
_LAST = f"{_J}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM j) WHERE k = 1)"


@query(f"WITH {_LAST} SELECT job_id, CASE WHEN state = 'running' THEN 'interrupted' ELSE state END AS state, CASE WHEN state = 'running' THEN 'error' ELSE stage END AS stage FROM l")
def q_reloaded_jobs(spark, sf_dir):
    return D.reloaded_jobs(project(spark, sf_dir, "orders", JOBS)).select("job_id", "state", "stage")


@query(f"WITH {_J} SELECT token, min(job_id) AS job_id FROM j WHERE state = 'running' GROUP BY token")
def q_running_job(spark, sf_dir):
    return D.running_job(project(spark, sf_dir, "orders", JOBS))


SESSIONS = ("c_custkey AS job_id", "CASE c_custkey % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '{\"session\":{\"matchStats\":[{\"a\":1},{\"a\":2}],\"benchBlocks\":[]}}' WHEN 2 THEN '{\"matchStats\":[],\"benchBlocks\":[{\"id\":1}]}' WHEN 3 THEN '{\"session\":{\"hybridResults\":{\"x\":1}}}' ELSE '{}' END AS doc")
_SESS = "se AS (SELECT c_custkey AS job_id, c_custkey % 5 IN (1, 2, 3) AS has_session, CASE WHEN c_custkey % 5 = 1 THEN 2 ELSE 0 END AS n_actions FROM customer)"


@query(f"WITH {_SESS} SELECT * FROM se")
def q_session_summary(spark, sf_dir):
    return S.session_summary(project(spark, sf_dir, "customer", SESSIONS))


@query(
    f"""WITH {_LAST}, {_SESS} SELECT l.job_id, l.token, coalesce(opponent, '') AS opponent, coalesce(has_session, false) AS has_session, coalesce(n_actions, 0) AS n_actions, EXISTS (SELECT 1 FROM part WHERE 't' || (p_partkey % 450)::VARCHAR = l.token AND p_partkey % 2 = 0) AS video_available, coalesce(finished_at, started_at) AS analysed_at
FROM l LEFT JOIN se USING (job_id) WHERE state = 'done'"""
)
def q_catalogue_entries(spark, sf_dir):
    uploads = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0").select(F.concat(F.lit("t"), (F.col("p_partkey") % 450).cast("string")).alias("token"))
    jobs = project(spark, sf_dir, "orders", JOBS)
    last = jobs.join(jobs.groupBy("job_id").agg(F.max("seq").alias("seq")), ["job_id", "seq"])
    return S.catalogue_entries(last, project(spark, sf_dir, "customer", SESSIONS), uploads).select("job_id", "token", "opponent", "has_session", "n_actions", "video_available", "analysed_at")


_SET = "SELECT user_id, 'k' || (event_id % 7)::VARCHAR AS key, event_type AS value, event_id AS seq FROM events"


@query(f"WITH s AS ({_SET}), a AS (SELECT c_custkey AS user_id, 'k1' AS key, c_name AS value, -1 AS seq FROM customer UNION ALL SELECT * FROM s) SELECT user_id, key, arg_max(value, seq) AS value FROM a GROUP BY ALL")
def q_settings_merge(spark, sf_dir):
    saved = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit("k1").alias("key"), F.col("c_name").alias("value"))
    updates = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return D.merged_settings(saved, updates)


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_size * 900 < 10000 THEN 'incomplete' WHEN p_partkey % 7 = 0 THEN 'unreadable' WHEN p_partkey % 5 = 0 THEN 'no frames' END AS error FROM part")
def q_upload_check(spark, sf_dir):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", D.upload_error(k % 9 != 0, F.col("p_size") * 900, k % 7 != 0, F.when(k % 5 != 0, F.col("p_size"))).alias("error"))


@query(f"WITH s AS {duck('events', SAMPLES)}, g AS (SELECT match_id, count(*) AS n, max(t_ms) - min(t_ms) AS ms, max(frame_index) - min(frame_index) + 1 AS span FROM s GROUP BY match_id) SELECT match_id, n AS n_frames, ms / 1000.0::DOUBLE AS duration_sec, CASE WHEN ms > 0 THEN floor((n - 1) * 1000.0::DOUBLE / ms * 10000 + 0.5) / 10000 END AS fps, n = span AS complete FROM g")
def q_video_probe(spark, sf_dir):
    return D.probe(project(spark, sf_dir, "events", SAMPLES)).withColumn("fps", X.rounded(F.col("fps")))


_SIZES = ("p_partkey", "CAST(p_size % 3 AS INT) * 400 AS height", "CAST(p_partkey % 5 * 500 AS INT) AS width", "CAST(p_partkey * 31 % 4000 AS DOUBLE) AS duration_sec")


@query(f"WITH v AS {duck('part', _SIZES)} SELECT p_partkey, array_to_string(list_filter([CASE WHEN height > 0 AND height < 540 THEN 'low resolution' END, CASE WHEN NOT (height > 0 AND height < 540) AND width > 1280 THEN 'analysed at a smaller width' END, CASE WHEN duration_sec >= 1800 THEN 'long footage' END], lambda z: z IS NOT NULL), ';') AS warnings FROM v")
def q_footage_warnings(spark, sf_dir):
    return D.footage_warnings(project(spark, sf_dir, "part", _SIZES)).select("p_partkey", F.array_join("warnings", ";").alias("warnings"))


@query(f"WITH s AS {duck('events', SAMPLES)}, g AS (SELECT match_id, count(*) AS n, avg((detected AND frame_index % 3 = 0)::INT::DOUBLE) AS r FROM s GROUP BY match_id) SELECT match_id, CASE WHEN n = 0 THEN 'empty trajectory' WHEN r < 0.2::DOUBLE THEN 'low ball-detection recall' ELSE '' END AS warnings FROM g")
def q_trajectory_warnings(spark, sf_dir):
    s = project(spark, sf_dir, "events", SAMPLES).groupBy("match_id").agg(F.count("*").alias("n"), F.avg((F.col("detected") & (F.col("frame_index") % 3 == 0)).cast("double")).alias("detected_ratio"))
    return D.trajectory_warnings(s).select("match_id", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT user_id % 64 AS match_id, event_id AS contact_id, event_id * 5 / 1000.0::DOUBLE AS t_sec, (event_id % 10000) / 10000.0::DOUBLE AS strength, CASE WHEN event_type = 'click' THEN 'kick,stop' ELSE '' END AS kinds FROM events")
def q_document_round_trip(spark, sf_dir):
    """Contacts written as one JSON document a match and read again."""
    kinds = F.when(F.col("event_type") == "click", F.array(F.lit("kick"), F.lit("stop"))).otherwise(F.array().cast("array<string>"))
    contacts = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 64).alias("match_id"), F.col("event_id").alias("contact_id"), (F.col("event_id") * 5).alias("t_ms"), (F.col("event_id") % 10000 / 10000.0).alias("strength"), kinds.alias("kinds"))
    at = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    D.write_documents(D.result_documents(contacts, "contacts"), at)
    return D.read_documents(spark, at).select("match_id", "contact_id", "t_sec", "strength", F.array_join("kinds", ",").alias("kinds"))


QUEUE = ("user_id % 64 AS match_id", "CAST(event_id AS INT) AS rank", "event_id % 7 = 0 AS crowded", "event_id % 3 = 0 AS is_other_team", "CAST(event_id % 4 - 1 AS INT) AS kit_group", "CAST(event_id % 5 - 1 AS INT) AS appearance_group", "CASE WHEN event_id % 13 = 0 THEN 'me' END AS decision")
_QU = f"q AS {duck('events', QUEUE)}"
_SETTLE = f"""{_QU}, g AS (SELECT * FROM q WHERE rank = 33), a AS (SELECT q.*, coalesce(q.rank > 33 AND q.decision IS NULL AND NOT q.crowded AND NOT g.crowded AND ((g.is_other_team AND q.is_other_team AND q.kit_group >= 0 AND q.kit_group = g.kit_group)
OR (NOT g.is_other_team AND NOT q.is_other_team AND q.appearance_group >= 0 AND q.appearance_group = g.appearance_group)), false) AS auto FROM q LEFT JOIN g USING (match_id))"""


@query(f"WITH {_SETTLE} SELECT match_id, rank, CASE WHEN rank = 33 OR auto THEN 'not_me' ELSE decision END AS decision, auto FROM a")
def q_settled(spark, sf_dir):
    return R.settled_by(project(spark, sf_dir, "events", QUEUE), 33, "not_me").select("match_id", "rank", "decision", "auto")


@query(f"WITH {_QU} SELECT match_id, rank, CASE WHEN rank = 33 THEN 'not_me' ELSE decision END AS decision FROM q")
def q_undone(spark, sf_dir):
    """One decision and what it settled, taken back: only the decision itself stays."""
    return R.undone(R.settled_by(project(spark, sf_dir, "events", QUEUE), 33, "not_me")).select("match_id", "rank", "decision")


CHOICES = ("o_custkey % 64 AS match_id", "o_orderkey AS seq", "CASE o_orderkey % 5 WHEN 0 THEN 'undo' WHEN 1 THEN 'me' WHEN 2 THEN 'me' ELSE 'not_me' END AS choice")


@query()
def q_review_replay(spark, sf_dir):
    """A log of choices and undos, replayed over the review queue of each match."""
    return R.replayed(project(spark, sf_dir, "events", QUEUE), project(spark, sf_dir, "orders", CHOICES))


_COUNTED = f"""s AS {duck('events', SAMPLES)}, m AS (SELECT *, sum(CASE WHEN detected THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_index) AS run, coalesce(lag(x) OVER (PARTITION BY match_id, shot_id ORDER BY frame_index) IS NOT NULL, false) AS roi FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, run ORDER BY frame_index) - CASE WHEN run = 0 THEN 1 ELSE 2 END AS miss FROM m), c AS (SELECT *, detected OR miss < 4 OR (miss - 4) % 3 = 0 AS scanned, roi AND detected AS hit FROM k)"""


@query(f"WITH {_COUNTED} SELECT count(*) AS frames, count(*) FILTER (WHERE hit) AS roi_hits, count(*) FILTER (WHERE roi AND NOT hit) AS roi_misses, count(*) FILTER (WHERE NOT hit AND scanned) AS full_scans, count(*) FILTER (WHERE NOT hit AND NOT scanned) AS skipped_full_scans FROM c")
def q_detector_counters(spark, sf_dir):
    """Counters that come with the writing of the schedule, without a second scan."""
    counted, counters = S.counted_scans(project(spark, sf_dir, "events", SAMPLES))
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counters.get], "frames long, roi_hits long, roi_misses long, full_scans long, skipped_full_scans long")


_STATES = "SELECT o_orderkey AS job_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'queued' END AS state, 'job ' || o_orderkey AS status FROM orders"


@query(f"SELECT job_id::VARCHAR AS job_id, CASE WHEN state = 'running' THEN 'interrupted' ELSE state END AS state, CASE WHEN state = 'running' THEN 'Analysis was interrupted (server restarted)' ELSE status END AS status FROM ({_STATES}) WHERE job_id % 11 <> 0")
def q_hydrated_jobs(spark, sf_dir):
    """Job states written as JSON, every eleventh cut off in the middle, and read again; what can't be read is set aside."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    doc = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("job_id"), state.alias("state"), F.concat(F.lit("job "), F.col("o_orderkey").cast("string")).alias("status")))
    text = o.select(F.when(F.col("o_orderkey") % 11 == 0, F.substring(doc, 1, 25)).otherwise(doc).alias("value"))
    at = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    text.write.text(at)
    states, _ = D.hydrate(spark, at, lines=True)
    return states.select("job_id", "state", "status")


_REPLY = "CASE doc_id % 8 WHEN 0 THEN '{\"team_one\":\"A\",\"team_two\":\"c\",\"confident\":true}' WHEN 1 THEN '<think>{\"team_one\":\"B\"}</think> {\"team_one\":\"B\",\"team_two\":\"A\"}' WHEN 2 THEN '<think>cut off {\"team_one\":\"B\",\"team_two\":\"A\"}' WHEN 3 THEN '```json {\"team_one\":\"D\",\"team_two\":\"B\"} ```' WHEN 4 THEN '{\"team_one\":\"A\",\"team_two\":\"A\"}' WHEN 5 THEN '{\"team_one\":\"A\",\"team_two\":\"Z\"}' WHEN 6 THEN '{\"team_one\":\"A\",\"team_two\":\"B\",\"confident\":false}' ELSE text END"


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '0,2' WHEN 1 THEN '1,0' WHEN 3 THEN '3,1' END AS picked FROM documents")
def q_choice_parse(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{_REPLY} AS reply")
    return d.select("doc_id", F.array_join(S.parse_choice(F.col("reply"), 4), ",").alias("picked"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '#aabbcc' WHEN 1 THEN '#112233,#zzzzzz' ELSE '' END AS hexes FROM documents")
def q_hex_list(spark, sf_dir):
    field = "CASE doc_id % 4 WHEN 0 THEN '[\"#aabbcc\", \"red\", \"#abc\", 5]' WHEN 1 THEN '[\"#112233\", \"#zzzzzz\"]' WHEN 2 THEN text END"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{field} AS field")
    return d.select("doc_id", F.array_join(S.hex_list(F.col("field")), ",").alias("hexes"))


@query("SELECT conv_id, turn, coalesce(regexp_full_match(substr(md5(text), 1, 10 + turn % 3 * 1), '[a-f0-9]{12}'), false) AS token_ok, coalesce(regexp_full_match('clip_' || substr(md5(text), 1, 8) || '_' || turn || '_1.mp4', 'clip_(?:all|[a-f0-9]{8})_\\d+_\\d+\\.mp4'), false) AS name_ok FROM conversations")
def q_path_guards(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    token, name = F.substring(F.md5("text"), 1, F.col("turn") % 3 + 10), F.concat(F.lit("clip_"), F.substring(F.md5("text"), 1, 8), F.lit("_"), F.col("turn").cast("string"), F.lit("_1.mp4"))
    return c.select("conv_id", "turn", S.valid_token(token).alias("token_ok"), S.valid_clip_name(name).alias("name_ok"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'json_object' END AS response_format, CASE turn % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'high' END AS reasoning_effort FROM conversations")
def q_response_options(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("turn")
    o = S.response_options(F.when(t % 3 == 0, "json_object").otherwise("schema"), F.when(t % 4 == 0, "none").when(t % 4 == 1, "high").otherwise(F.col("role")))
    return c.select("conv_id", "turn", o["response_format"].alias("response_format"), o["reasoning_effort"].alias("reasoning_effort"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN trim(coalesce(text, '')) = '' THEN 'text part needs text' WHEN length(text) > 200 THEN 'text part too long' END WHEN turn % 3 = 1 THEN CASE WHEN turn % 2 = 0 THEN 'image must be inline' END ELSE 'unsupported part' END AS error FROM conversations")
def q_content_check(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("turn")
    kind = F.when(t % 3 == 0, "text").when(t % 3 == 1, "image_url").otherwise("audio")
    value = F.when(t % 3 == 1, F.when(t % 2 == 0, "http://x/y.png").otherwise("data:image/png;base64,AA")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", S.content_error(kind, value, 200).alias("error"))


@query("SELECT p_partkey, CASE WHEN p_size * p_partkey >= 1048576 THEN format('{:.1f} MB', floor(p_size * p_partkey / 1048576.0 * 10 + 0.5) / 10) WHEN p_size * p_partkey >= 1024 THEN floor(p_size * p_partkey / 1024.0 + 0.5)::BIGINT || ' KB' ELSE p_size * p_partkey || ' B' END AS size FROM part")
def q_file_size(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.file_size(F.col("p_size") * F.col("p_partkey")).alias("size"))


@query("SELECT c_custkey, len(list_filter([c_name, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE 'x' END, CASE WHEN c_custkey % 2 = 0 THEN 'y' END], lambda z: trim(coalesce(z, '')) <> '')) AS n FROM customer")
def q_filled_sections(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    m = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise("x"), F.lit("c"), F.when(F.col("c_custkey") % 2 == 0, "y"))
    return c.select("c_custkey", F.size(S.filled_sections(m)).cast("long").alias("n"))


@query("SELECT c_custkey AS match_id, (c_custkey % 50)::DOUBLE / 100 * 5400.0 AS start_sec, (c_custkey % 50 + 10)::DOUBLE / 100 * 5400.0 AS end_sec FROM customer")
def q_bench_ranges(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    blocks = c.select(F.col("c_custkey").alias("match_id"), (F.col("c_custkey") % 50).cast("double").alias("start_pct"), (F.col("c_custkey") % 50 + 10).cast("double").alias("end_pct"))
    return V.bench_ranges(blocks, c.select(F.col("c_custkey").alias("match_id"), F.lit(5400.0).alias("duration_sec")))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_distinct(list_filter([1, CASE WHEN l_linenumber % 2 = 0 THEN 2 END, CASE WHEN l_linenumber % 3 = 0 THEN 1 END], lambda z: z IS NOT NULL)), ',') = '1' AS one_class FROM lineitem")
def q_request_classes(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    c = S.request_classes(F.lit(1), F.when(n % 2 == 0, 2), F.when(n % 3 == 0, 1))
    return l.select("l_orderkey", "l_linenumber", (F.array_join(F.transform(c, lambda x: x.cast("string")), ",") == "1").alias("one_class"))


@query()
def q_ball_patrol(spark, sf_dir):
    """A made-up ball, 540 frames of it."""
    return D.ball_patrol(540, spark).select("i", X.rounded(F.col("x")).alias("x"), X.rounded(F.col("y")).alias("y"))
