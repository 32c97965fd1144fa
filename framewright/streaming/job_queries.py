"""Queries of the job store and event folds; changes are read off the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import read_table
from framewright.sources import parsers as P
from framewright.streaming import jobs as J


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("at_ms"), F.round(F.col("value") * 100).cast("long").alias("c"))


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    op = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "state").when(F.col("event_type") == "error", "finish").when(F.col("event_type") == "purchase", "plan")
    return _events(spark, sf_dir).filter("event_type <> 'signup'").select(
        k.alias("seq"), "at_ms", F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("id"), op.alias("op"), F.concat(F.lit("/in/"), k.cast("string")).alias("input"),
        F.when(k % 2 == 0, F.concat(F.lit("/out/"), k.cast("string"))).alias("output"), F.when(k % 3 == 0, "preview").otherwise("deterministic").alias("profile"),
        F.when(k % 5 == 0, "odd").when(k % 5 < 3, "running").otherwise("completed").alias("state"), F.when(k % 4 > 0, F.concat(F.lit("m"), k.cast("string"))).alias("message"), (F.col("c") * 3).alias("elapsed_ms"), F.concat(F.lit("{"), k.cast("string"), F.lit("}")).alias("plan_json"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs view of the change log."""
    return J.jobs(_job_log(spark, sf_dir))


def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest jobs."""
    return J.list_jobs(J.jobs(_job_log(spark, sf_dir)), 20).select("id", "created_ms", "state")


def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs left running."""
    return J.interrupted(J.jobs(_job_log(spark, sf_dir))).select("id", "updated_ms")


def _stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in (*J.STAGE_STATES, "odd")]), (F.col("c") % 7 + 1).cast("int"))
    return _events(spark, sf_dir).select(
        k.alias("seq"), "at_ms", F.concat(F.lit("job"), (F.col("user_id") % 40).cast("string")).alias("job_id"), F.concat(F.lit("stage"), (k % 13).cast("string")).alias("stage"), status.alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("note"), F.when(status == "done", F.concat(F.lit("{"), k.cast("string"), F.lit("}"))).alias("result"),
    )


def _chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf_dir).select(
        k.alias("seq"), "at_ms", F.concat(F.lit("job"), (F.col("user_id") % 40).cast("string")).alias("job_id"), F.when(k % 4 == 0, "mux").otherwise("encode").alias("stage"), (k % 17).alias("chunk_index"),
        F.when(F.col("c") % 3 == 0, "pending").otherwise("committed").alias("status"), F.when(k % 5 > 0, F.concat(F.lit("/c/"), k.cast("string"))).alias("artifact"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest stage rows."""
    return J.stage_rows(_stage_log(spark, sf_dir))


def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, incomplete and degraded stages, committed chunks."""
    s = J.stage_rows(_stage_log(spark, sf_dir))
    return J.resume_points(s, J.chunk_rows(_chunk_log(spark, sf_dir))).join(J.degraded_stages(s), "job_id", "left")


def job_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest chunk rows."""
    return J.chunk_rows(_chunk_log(spark, sf_dir))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    level = F.element_at(F.array(*[F.lit(x) for x in (*J.LEVELS, "odd")]), (F.col("c") % 6 + 1).cast("int"))
    return _events(spark, sf_dir).select(k.alias("seq"), "at_ms", (F.col("user_id") % 9).alias("job_id"), level.alias("level"), F.when(k % 3 > 0, "probe").alias("stage"), F.col("event_type").alias("message"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 rows per job, then warnings and errors, as text."""
    t = J.tail(_logs(spark, sf_dir), 100, "WARN")
    return t.select("job_id", "seq", P.log_line(F.col("at_ms"), F.col("level"), F.col("stage"), F.col("message")).alias("line"), F.upper(P.enum(F.col("level"), [x.lower() for x in J.LEVELS], "info")).alias("level"))


def log_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows and removed counts of a trim to 300, visible lines of a ring of 200."""
    kept, removed = J.trim(_logs(spark, sf_dir), 300)
    t = kept.groupBy("job_id").agg(F.count("*").alias("kept"), F.min("seq").alias("oldest"))
    return t.join(removed, "job_id").join(J.ring(_logs(spark, sf_dir), 200, "INFO"), "job_id")


def stderr_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head bytes and last lines per process."""
    lines = _logs(spark, sf_dir).select(F.col("job_id").alias("process"), F.col("seq").alias("line_no"), F.col("message").alias("line"))
    return J.bounded_stderr(lines, 5, 100)


def stage_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View fold and overall fraction."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "stage").when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "finished").otherwise("log")
    status = F.element_at(F.array(*[F.lit(s) for s in J.STAGE_STATES]), (F.col("c") % 6 + 1).cast("int"))
    e = e.select((F.col("user_id") % 60).alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("s"), (F.col("event_id") % 13).cast("string")).alias("stage"), status.alias("status"), (F.col("c") % 100 / 100).alias("fraction"))
    v = J.stage_view(e)
    return v.join(J.overall_fraction(v).withColumnRenamed("fraction", "overall"), "job_id").select("job_id", "stage", "status", "fraction", F.round("overall", 9).alias("overall"))


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress at most every ten minutes per user, ends always."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 25).alias("key"), "at_ms", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_end"))
    return J.throttle(e, 6_000_000)


_EV = "ev AS (SELECT event_id AS k, user_id, event_type, epoch_us(ts) // 1000 AS at_ms, CAST(round(value * 100) AS BIGINT) AS c FROM events)"
_JOBS = f"""WITH {_EV},
l AS (SELECT *, 'job' || user_id AS id, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'state' WHEN 'error' THEN 'finish' ELSE 'plan' END AS op, '/in/' || k AS input, CASE WHEN k % 2 = 0 THEN '/out/' || k END AS output,
  CASE WHEN k % 3 = 0 THEN 'preview' ELSE 'deterministic' END AS profile, CASE WHEN k % 5 = 0 THEN 'queued' WHEN k % 5 < 3 THEN 'running' ELSE 'completed' END AS state, CASE WHEN k % 4 > 0 THEN 'm' || k END AS message FROM ev WHERE event_type <> 'signup'),
a AS (SELECT id, max(k) FILTER (WHERE op = 'create') AS kc, min(k) FILTER (WHERE op = 'create') AS k0, max(k) AS ku, max(k) FILTER (WHERE op IN ('state', 'finish')) AS ks, max(k) FILTER (WHERE op = 'finish') AS kf, max(k) FILTER (WHERE op = 'plan') AS kp FROM l GROUP BY id),
j AS (SELECT a.id, c.input, c.output, c.profile, o.at_ms AS created_ms, u.at_ms AS updated_ms, coalesce(s.state, 'queued') AS state, s.message, f.c * 3 AS elapsed_ms, '{{' || kp || '}}' AS plan_json
  FROM a JOIN l c ON c.k = kc JOIN l o ON o.k = k0 JOIN l u ON u.k = ku LEFT JOIN l s ON s.k = ks LEFT JOIN l f ON f.k = kf)"""
_STAGES = f"""{_EV},
sl AS (SELECT *, 'job' || (user_id % 40) AS job_id, 'stage' || (k % 13) AS stage, ['pending', 'running', 'done', 'skipped', 'degraded', 'failed', 'pending'][(c % 7 + 1)::INT] AS status, c % 7 = 2 AS done FROM ev),
st AS (SELECT job_id, stage, arg_max(status, k) AS status, 'note ' || max(k) FILTER (WHERE k % 3 = 0) AS note, '{{' || max(k) FILTER (WHERE done) || '}}' AS result, arg_max(at_ms, k) AS updated_ms FROM sl GROUP BY ALL),
cl AS (SELECT *, 'job' || (user_id % 40) AS job_id, CASE WHEN k % 4 = 0 THEN 'mux' ELSE 'encode' END AS stage, k % 17 AS chunk_index FROM ev),
ck AS (SELECT job_id, stage, chunk_index, max(k) AS k FROM cl GROUP BY ALL),
cx AS (SELECT ck.job_id, ck.stage, ck.chunk_index, CASE WHEN c % 3 = 0 THEN 'pending' ELSE 'committed' END AS status, CASE WHEN k % 5 > 0 THEN '/c/' || k END AS artifact, at_ms FROM ck JOIN ev USING (k))"""
_LOGS = f"""{_EV}, lg AS (SELECT k AS seq, at_ms, user_id % 9 AS job_id, ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'odd'][(c % 6 + 1)::INT] AS level, [0, 1, 2, 3, 4, 2][(c % 6 + 1)::INT] AS rank, CASE WHEN k % 3 > 0 THEN 'probe' END AS stage, event_type AS message,
  row_number() OVER (PARTITION BY user_id % 9 ORDER BY k DESC) AS n FROM ev)"""
ORACLES = {
    "jobs": f"{_JOBS} SELECT * FROM j",
    "jobs_newest": f"{_JOBS} SELECT id, created_ms, state FROM j ORDER BY created_ms DESC, id LIMIT 20",
    "jobs_interrupted": f"{_JOBS} SELECT id, updated_ms FROM j WHERE state = 'running'",
    "job_stages": f"WITH {_STAGES} SELECT * FROM st",
    "job_resume": f"""WITH {_STAGES} SELECT job_id, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE status IN ('done', 'skipped')), '') AS completed, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE status IN ('running', 'degraded')), '') AS incomplete,
  (SELECT count(*) FROM cx WHERE cx.job_id = st.job_id AND cx.stage = 'encode' AND cx.status = 'committed' AND artifact IS NOT NULL) AS committed, string_agg(stage, ',' ORDER BY stage) FILTER (WHERE status = 'degraded') AS degraded FROM st GROUP BY job_id""",
    "job_chunks": f"WITH {_STAGES} SELECT * FROM cx",
    "log_tail": f"""WITH {_LOGS} SELECT job_id, seq, strftime(make_timestamp_ms(at_ms), '%H:%M:%S.%g') || ' ' || rpad(level, 5, ' ') || ' ' || CASE WHEN stage IS NULL THEN '' ELSE '[' || stage || '] ' END || message AS line, CASE level WHEN 'odd' THEN 'INFO' ELSE level END AS level
  FROM lg WHERE n <= 100 AND rank >= 3""",
    "log_trim": f"WITH {_LOGS} SELECT job_id, count(*) FILTER (WHERE n <= 300) AS kept, min(seq) FILTER (WHERE n <= 300) AS oldest, greatest(count(*) - 300, 0) AS removed, count(*) FILTER (WHERE n <= 200 AND rank >= 2) AS visible, greatest(count(*) - 200, 0) AS dropped FROM lg GROUP BY job_id",
    "stderr_tails": f"WITH {_LOGS} SELECT process, line_no, line FROM (SELECT job_id AS process, seq AS line_no, message AS line, n, sum(strlen(message) + 1) OVER (PARTITION BY job_id ORDER BY seq) AS upto FROM lg) WHERE upto <= 100 OR n <= 5",
    "stage_views": f"""WITH {_EV},
e AS (SELECT *, user_id % 60 AS job_id, 's' || (k % 13) AS stage, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN ['pending', 'running', 'done', 'skipped', 'degraded', 'failed'][(c % 6 + 1)::INT] END AS s FROM ev),
v AS (SELECT job_id, stage, arg_max(s, k) AS s, arg_max(c % 100 / 100, k) FILTER (WHERE event_type = 'view') AS fraction FROM e WHERE s IS NOT NULL GROUP BY ALL),
w AS (SELECT v.* REPLACE (CASE WHEN s = 'running' AND job_id IN (SELECT job_id FROM e WHERE event_type = 'error' AND user_id % 2 = 0) THEN 'failed' ELSE s END AS s) FROM v)
SELECT job_id, stage, s AS status, fraction, round(least(sum(CASE WHEN s IN ('done', 'skipped', 'degraded') THEN 1.0::DOUBLE WHEN s = 'running' THEN coalesce(fraction, 0) ELSE 0 END) OVER (PARTITION BY job_id) / 13, 1), 9) AS overall FROM w""",
    "throttled": f"""WITH RECURSIVE {_EV},
t AS MATERIALIZED (SELECT user_id % 25 AS key, at_ms, k AS seq, event_type = 'error' AS is_end, row_number() OVER (PARTITION BY user_id % 25 ORDER BY at_ms, k) AS n FROM ev),
r(key, n, last, passes) AS (SELECT key, n, at_ms, true FROM t WHERE n = 1
  UNION ALL SELECT t.key, t.n, CASE WHEN t.is_end OR t.at_ms - r.last >= 6000000 THEN t.at_ms ELSE r.last END, t.is_end OR t.at_ms - r.last >= 6000000 FROM r JOIN t ON t.key = r.key AND t.n = r.n + 1)
SELECT key, at_ms, seq, is_end FROM r JOIN t USING (key, n) WHERE passes""",
}
QUERIES = {
    "jobs": jobs, "jobs_newest": newest_jobs, "jobs_interrupted": interrupted_jobs, "job_stages": stages, "job_resume": resume_points, "job_chunks": job_chunks,
    "log_tail": log_tail, "log_trim": log_trim, "stderr_tails": stderr_tails, "stage_views": stage_views, "throttled": throttled,
}
