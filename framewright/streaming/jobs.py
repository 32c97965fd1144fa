"""The durable job store as an append-only change log with latest-wins views, and the event stream's folds.

A change row carries only what it sets; ``sets_*`` flags tell a NULL that overwrites from one that does
not. Views are aggregates by key over (seq, value) structs, so no key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")
JOB_STATES = ("queued", "running", "completed", "failed", "cancelled")
STAGE_STATES = ("pending", "running", "done", "skipped", "degraded", "failed")
STAGES, KEPT_LINES = 13, 2000


def _last(value: str, when: Column) -> Column:
    """The value of the last row (by seq) that meets a condition; NULLs count."""
    return F.max_by(F.when(when, F.struct(F.col(value).alias("v"))), F.when(when, F.col("seq")))["v"]


def jobs(log: DataFrame) -> DataFrame:
    """Jobs from change rows (seq, at_ms, id, op, ..): a later create changes input, output and profile
    only; state, message, plan and elapsed follow their own changes; updated_ms follows all."""
    create, state, finish, plan = (F.col("op") == x for x in ("create", "state", "finish", "plan"))
    t = log.groupBy("id").agg(
        _last("input", create).alias("input"), _last("output", create).alias("output"), _last("profile", create).alias("profile"), F.min(F.when(create, F.struct("seq", "at_ms")))["at_ms"].alias("created_ms"),
        F.max_by("at_ms", "seq").alias("updated_ms"), _last("state", state | finish).alias("state"), _last("message", finish | state).alias("message"), _last("elapsed_ms", finish).alias("elapsed_ms"), _last("plan_json", plan).alias("plan_json"),
        F.max(create.cast("int")).alias("made"),
    )
    return t.filter("made = 1").drop("made").withColumn("state", F.coalesce(F.when(F.col("state").isin(*JOB_STATES), F.col("state")), F.lit("queued")))


def job(view: DataFrame, ident: str) -> DataFrame:
    return view.filter(F.col("id") == ident)


def list_jobs(view: DataFrame, limit: int) -> DataFrame:
    """The newest jobs, ties by id."""
    return view.orderBy(F.desc("created_ms"), "id").limit(limit)


def interrupted(view: DataFrame) -> DataFrame:
    return view.filter("state = 'running'").orderBy(F.desc("updated_ms"), "id")


def stage_rows(log: DataFrame) -> DataFrame:
    """Latest status per (job, stage); a NULL note keeps the old one; results stay until replaced."""
    t = log.groupBy("job_id", "stage").agg(
        F.max_by("status", "seq").alias("status"), F.max_by(F.when(F.col("note").isNotNull(), F.col("note")), F.when(F.col("note").isNotNull(), F.col("seq"))).alias("note"),
        F.max_by(F.when(F.col("result").isNotNull(), F.col("result")), F.when(F.col("result").isNotNull(), F.col("seq"))).alias("result"), F.max_by("at_ms", "seq").alias("updated_ms"),
    )
    return t.withColumn("status", F.when(F.col("status").isin(*STAGE_STATES), F.col("status")).otherwise("pending"))


def stage_result(stages: DataFrame, job_id: str, stage: str) -> DataFrame:
    return stages.filter((F.col("job_id") == job_id) & (F.col("stage") == stage)).select("result")


def resume_points(stages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per job: completed (done, skipped) and incomplete (running, degraded) stages, committed chunks of encode."""
    names = lambda *s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("status").isin(*s), F.col("stage")))), ",")
    t = stages.groupBy("job_id").agg(names("done", "skipped").alias("completed"), names("running", "degraded").alias("incomplete"))
    done = chunks.filter("stage = 'encode' AND status = 'committed' AND artifact IS NOT NULL").groupBy("job_id").agg(F.count("*").alias("committed"))
    return t.join(done, "job_id", "left").withColumn("committed", F.coalesce("committed", F.lit(0).cast("long")))


def chunk_rows(log: DataFrame) -> DataFrame:
    """Latest row per (job, stage, chunk)."""
    fields = F.struct("status", "artifact", "at_ms")
    return log.groupBy("job_id", "stage", "chunk_index").agg(F.max_by(fields, F.col("seq")).alias("c")).select("job_id", "stage", "chunk_index", "c.*")


def level_rank(level: Column) -> Column:
    """TRACE 0 to ERROR 4; unknown levels count as INFO."""
    rank = F.lit(2)
    for i, name in enumerate(LEVELS):
        rank = F.when(F.upper(level) == name, i).otherwise(rank)
    return rank


def tail(logs: DataFrame, limit: int, least: str) -> DataFrame:
    """The newest ``limit`` rows per job by seq, then those of a level at least, oldest first."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    t = logs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit)
    return t.filter(level_rank(F.col("level")) >= LEVELS.index(least)).drop("k").orderBy("job_id", "seq")


def trim(logs: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed count per job): all but the newest ``keep`` per job go."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    t = logs.withColumn("k", F.row_number().over(w))
    return t.filter(F.col("k") <= keep).drop("k"), logs.groupBy("job_id").agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("removed"))


def ring(logs: DataFrame, size: int = KEPT_LINES, least: str = "TRACE") -> DataFrame:
    """Per job: visible lines of the newest ``size`` at a level, and how many were dropped."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    t = logs.withColumn("k", F.row_number().over(w))
    visible = (F.col("k") <= size) & (level_rank(F.col("level")) >= LEVELS.index(least))
    return t.groupBy("job_id").agg(F.count_if(visible).alias("visible"), F.greatest(F.count("*") - size, F.lit(0)).alias("dropped"))


def bounded_stderr(lines: DataFrame, last: int, head_bytes: int = 256 * 1024) -> DataFrame:
    """Lines within the first ``head_bytes`` of a process, or among its last ``last``."""
    up = Window.partitionBy("process").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("process").orderBy(F.desc("line_no"))
    t = lines.withColumns({"upto": F.sum(F.octet_length("line") + 1).over(up), "k": F.row_number().over(down)})
    return t.filter((F.col("upto") <= head_bytes) | (F.col("k") <= last)).drop("upto", "k")


def stage_view(events: DataFrame) -> DataFrame:
    """Folds events (job_id, seq, kind, stage, status, fraction): a progress event makes its stage running
    unless a stage event after it says otherwise; a finished job leaves no stage running."""
    status = F.when(F.col("kind") == "stage", F.col("status")).when(F.col("kind") == "progress", F.lit("running"))
    t = events.filter(F.col("stage").isNotNull() & status.isNotNull()).withColumn("s", status)
    last = t.groupBy("job_id", "stage").agg(F.max_by("s", "seq").alias("status"), F.max_by(F.when(F.col("kind") == "progress", F.col("fraction")), F.when(F.col("kind") == "progress", F.col("seq"))).alias("fraction"))
    over = events.filter("kind = 'finished'").select("job_id", F.lit(True).alias("over")).distinct()
    t = last.join(over, "job_id", "left")
    return t.select("job_id", "stage", F.when(F.col("over") & (F.col("status") == "running"), "failed").otherwise(F.col("status")).alias("status"), "fraction")


def overall_fraction(view: DataFrame) -> DataFrame:
    """(finished stages + the running one's fraction) / 13, clamped."""
    part = F.when(F.col("status").isin("done", "skipped", "degraded"), 1.0).when(F.col("status") == "running", F.coalesce(F.col("fraction"), F.lit(0.0))).otherwise(0.0)
    return view.groupBy("job_id").agg(F.least(F.greatest(F.sum(part) / STAGES, F.lit(0.0)), F.lit(1.0)).alias("fraction"))


def terminal_state(result: Column) -> Column:
    return F.when(result == "ok", "completed").when(result == "cancelled", "cancelled").otherwise("failed")


def degraded_stages(stages: DataFrame) -> DataFrame:
    """Degraded stages per job, from the stage table."""
    return stages.filter("status = 'degraded'").groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list("stage")), ",").alias("degraded"))


def throttle_rows(times: Iterator[tuple[int, bool]], gap_ms: int, last: int | None = None) -> Iterator[tuple[bool, int | None]]:
    """Whether each (time, is end) passes: gap_ms after the last that did; ends always pass."""
    for at, end in times:
        passes = end or last is None or at - last >= gap_ms
        last = at if passes else last
        yield passes, last


def throttle(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events (key, at_ms, seq, is_end) that pass the throttle; keys are dealt apart, rows stream in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = object(), None
        for pdf in batches:
            keep = []
            for k, at, end in zip(pdf["key"].tolist(), pdf["at_ms"].tolist(), pdf["is_end"].tolist()):
                if k != key:
                    key, last = k, None
                ((passes, last),) = throttle_rows([(at, end)], gap_ms, last)
                keep.append(passes)
            yield pdf[keep]

    t = events.select("key", "at_ms", "seq", "is_end").repartition("key").sortWithinPartitions("key", "at_ms", "seq")
    return t.mapInPandas(run, "key long, at_ms long, seq long, is_end boolean")


def throttle_stream(events: DataFrame, gap_ms: int) -> DataFrame:
    """The throttle over a stream: each key's last passed time is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"])
        passed = []
        for at, end in zip(rows["at_ms"].tolist(), rows["is_end"].tolist()):
            ((passes, last),) = throttle_rows([(at, bool(end))], gap_ms, last)
            passed.append(passes)
        state.update((last,))
        yield rows[passed][["key", "at_ms", "seq", "is_end"]]

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("key").applyInPandasWithState(run, "key long, at_ms long, seq long, is_end boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def levels_per_window(events: DataFrame, width: str = "400 milliseconds", hop: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """Sliding block means of a live series (ts, stream_id, value); rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, hop), "stream_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


class StageStore:
    """Stage results as an append-only Parquet table; a stage that is done isn't computed again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    _SCHEMA = "job_id string, stage string, seq long, status string, note string, result string, at_ms long"

    def rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._SCHEMA)
        return self.spark.read.schema(self._SCHEMA).parquet(self.path)

    def commit(self, job_id: str, stage: str, status: str, result: str | None = None, note: str | None = None) -> None:
        """One row carries status and result, so they are committed together."""
        import time

        at = time.time_ns()
        self.spark.createDataFrame([(job_id, stage, at, status, note, result, at // 1_000_000)], self._SCHEMA).write.mode("append").parquet(self.path)

    def run(self, job_id: str, stage: str, produce: Callable[[], str], decode: Callable[[str], Any]) -> Any:
        """The stored result of a stage that is done and decodes, else a new one."""
        found = stage_rows(self.rows()).filter((F.col("job_id") == job_id) & (F.col("stage") == stage) & (F.col("status") == "done")).select("result").head()
        if found is not None and found["result"] is not None:
            try:
                return decode(found["result"])
            except ValueError:
                pass
        result = produce()
        self.commit(job_id, stage, "done", result)
        return decode(result)


def log_sink(write: Callable[[DataFrame], None], failures: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink whose failures are recorded and don't fail the stream."""

    def sink(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch)
        except Exception as error:  # noqa: BLE001  losing log rows must not stop the job
            failures.append(f"{epoch}: {error}")

    return sink


class Bus:
    """Fan-out of events to subscribers; one that raises is dropped, the others still get the event."""

    def __init__(self) -> None:
        self._subscribers: list[Callable[[Any], None]] = []

    def subscribe(self, receive: Callable[[Any], None]) -> None:
        self._subscribers.append(receive)

    def emit(self, event: Any) -> int:
        """Sends an event; returns how many got it."""
        alive = []
        for receive in self._subscribers:
            try:
                receive(event)
                alive.append(receive)
            except Exception:  # noqa: BLE001  a dead subscriber must not stop the others
                continue
        self._subscribers = alive
        return len(alive)

    def finish(self, job_id: str, result: str) -> str:
        """Emits a job's terminal event, once, with the state that its result maps to."""
        state = {"ok": "completed", "cancelled": "cancelled"}.get(result, "failed")
        self.emit({"kind": "finished", "job_id": job_id, "state": state})
        return state


def cancel(spark: SparkSession, job_id: str) -> None:
    """Cancels the Spark jobs that were started under this job's group."""
    spark.sparkContext.cancelJobGroup(job_id)
