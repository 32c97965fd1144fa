"""Segment and chunk plans with exact frame accounting, from shots of a stream.

A pair (p, p + 1) may be synthesised if both frames lie in one shot and no dissolve starts within
the guard. Segments are runs of pairs that overlap by one frame: with windows of two, every
admissible pair is its own; wider windows take max(window - 2, 1) pairs. Other pairs of a shot are
held together. Everything is islands over pair rows; only the greedy packing of chunks is a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _div(a, n):
    return F.call_function("div", a, F.lit(n).cast("long"))


def guarded_pairs(shots: DataFrame, guard: int = 12) -> DataFrame:
    """(stream_id, pair): pairs in [d - guard, d + guard) of a dissolve start d, each once."""
    d = shots.filter("kind = 'dissolve'")
    return d.select("stream_id", F.explode(F.sequence(F.greatest(F.col("start_frame") - guard, F.lit(0).cast("long")), F.col("start_frame") + guard - 1)).alias("pair")).distinct()


def pairs(shots: DataFrame, multiplier: int, guard: int = 12) -> DataFrame:
    """(stream_id, pair, shot, allowed, cut) of all consecutive frames of the shots; a pair belongs to its
    first frame's shot, and ``cut`` marks the one that leaves it."""
    w = Window.partitionBy("stream_id").orderBy("start_frame")
    last = F.lead("shot").over(w).isNull()
    rows = shots.select("stream_id", "shot", "start_frame", "end_frame", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("pair"), last.alias("is_last"))
    rows = rows.filter(~(F.col("is_last") & (F.col("pair") == F.col("end_frame") - 1)))
    marked = rows.join(guarded_pairs(shots, guard).withColumn("guarded", F.lit(True)), ["stream_id", "pair"], "left")
    inside = F.col("pair") < F.col("end_frame") - 1
    return marked.select("stream_id", "pair", "shot", (inside & F.col("guarded").isNull() & F.lit(multiplier > 1)).alias("allowed"), (~inside).alias("cut"))


def segments(shots: DataFrame, multiplier: int = 2, guard: int = 12, window: int = 2) -> DataFrame:
    """(stream_id, seq, kind, first, last, shot, outputs, drop_first): inclusive frame ranges that overlap by one."""
    m = F.lit(multiplier).cast("long")
    w = Window.partitionBy("stream_id").orderBy("pair")
    p = pairs(shots, multiplier, guard)
    new_run = F.coalesce(F.col("cut") | (F.col("allowed") != F.lag("allowed").over(w)) | (F.col("shot") != F.lag("shot").over(w)), F.lit(True))
    p = p.withColumn("run", F.sum(new_run.cast("int")).over(w))
    k = F.row_number().over(Window.partitionBy("stream_id", "run").orderBy("pair")) - 1
    piece = F.when(F.col("allowed"), F.floor(k / max(window - 2, 1))).otherwise(0)
    p = p.withColumn("piece", piece)
    s = p.groupBy("stream_id", "shot", "run", "piece").agg(F.min("pair").alias("first"), (F.max("pair") + 1).alias("last"), F.first("allowed").alias("allowed"))
    single = shots.groupBy("stream_id").agg(F.max("end_frame").alias("n"), F.max("shot").alias("shot")).filter("n = 1")
    order = Window.partitionBy("stream_id").orderBy("first")
    s = s.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.when(F.col("allowed"), "synthesise").otherwise("hold").alias("kind"), "first", "last", "shot", (m * (F.col("last") - F.col("first")) + 1).alias("outputs"))
    zero = F.lit(0).cast("long")
    alone = single.select("stream_id", zero.alias("seq"), F.lit("pass").alias("kind"), zero.alias("first"), zero.alias("last"), "shot", F.lit(1).cast("long").alias("outputs"))
    return s.unionByName(alone).withColumn("drop_first", F.col("seq") > 0)


def emitted():
    """Frames a segment emits: outputs less the dropped first one."""
    return F.col("outputs") - F.col("drop_first").cast("long")


def accounting(segs: DataFrame, shots: DataFrame, multiplier: int = 2) -> DataFrame:
    """Per stream: emitted and expected frames, model frames and calls, protected regions, whether the sum holds."""
    n = shots.groupBy("stream_id").agg(F.max("end_frame").alias("n"))
    model = F.when(F.col("kind") == "synthesise", F.col("last") - F.col("first")).otherwise(0)
    t = segs.groupBy("stream_id").agg(
        F.sum(emitted()).alias("emitted"), F.sum(model * (multiplier - 1)).alias("model_frames"), F.sum(model).alias("model_calls"), F.sum((F.col("kind") != "synthesise").cast("long")).alias("protected")
    )
    expected = F.lit(multiplier).cast("long") * (F.col("n") - 1) + 1
    return t.join(n, "stream_id").select("stream_id", "emitted", expected.alias("expected"), "model_frames", "model_calls", "protected", (F.col("emitted") == expected).alias("exact"))


def chunks(segs: DataFrame, target: int = 1000) -> DataFrame:
    """Greedy packing of consecutive segments of a shot while the span stays within ``target`` frames.

    A chunk's start depends on the one before, so it is a fold over rows in order; shots are independent
    and are dealt apart.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, begin = None, 0
        for pdf in batches:
            out = []
            for stream, shot, first, last in zip(pdf["stream_id"].tolist(), pdf["shot"].tolist(), pdf["first"].tolist(), pdf["last"].tolist()):
                if (stream, shot) != at or last - begin > target:
                    at, begin = (stream, shot), first
                out.append(begin)
            yield pdf.assign(begin=out)

    schema = "stream_id long, shot long, seq long, kind string, first long, last long, emits long, begin long"
    rows = segs.select("stream_id", "shot", "seq", "kind", "first", "last", emitted().alias("emits"))
    packed = rows.repartition("stream_id", "shot").sortWithinPartitions("stream_id", "shot", "seq").mapInPandas(pack, schema)
    t = packed.groupBy("stream_id", "shot", "begin").agg(
        F.min("seq").alias("first_segment"), F.max("seq").alias("last_segment"), F.min("first").alias("first_input"), F.max("last").alias("last_input"), F.sum("emits").alias("outputs"),
        F.sum((F.col("kind") != "synthesise").cast("long")).alias("protected"),
    )
    w = Window.partitionBy("stream_id").orderBy("first_segment")
    return t.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("chunk"), "shot", "first_segment", "last_segment", "first_input", "last_input", "outputs", "protected")


def slots(segs: DataFrame, multiplier: int = 2) -> DataFrame:
    """(stream_id, slot, source_frame, step, kind): every output frame of every segment."""
    m = F.lit(multiplier).cast("long")
    t = segs.select("stream_id", "kind", F.explode(F.sequence(m * F.col("first") + F.col("drop_first").cast("long"), m * F.col("last"))).alias("slot"))
    step = F.col("slot") % m
    made = (step > 0) & (F.col("kind") == "synthesise")
    return t.select("stream_id", "slot", _div(F.col("slot"), multiplier).alias("source_frame"), (step / multiplier).alias("step"), F.when(made, "model").when(step > 0, "repeat").otherwise("source").alias("kind"))


def delivered(planned: DataFrame, got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A short stream is padded by its last frame; extra frames are counted. planned (stream_id, frame_idx),
    got (stream_id, frame_idx, value): (planned rows with value and padded, extras per stream).

    Frames made by explode count as their stream in Spark's sizes, so the joins ask for sorting: neither
    side goes through the driver."""
    w = Window.partitionBy("stream_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    t = planned.hint("merge").join(got.hint("merge"), ["stream_id", "frame_idx"], "left")
    filled = t.select("stream_id", "frame_idx", F.last("value", ignorenulls=True).over(w).alias("value"), F.col("value").isNull().alias("padded"))
    extra = got.hint("merge").join(planned.hint("merge"), ["stream_id", "frame_idx"], "left_anti").groupBy("stream_id").agg(F.count("*").alias("extra"))
    return filled, extra


def check_order(rows: DataFrame) -> DataFrame:
    """Arrivals (stream_id, arrival, frame_idx) out of order; an ordered source has none."""
    w = Window.partitionBy("stream_id").orderBy("arrival")
    return rows.withColumn("before", F.lag("frame_idx").over(w)).filter(F.col("frame_idx") <= F.col("before"))


def chunk_path(directory: str, chunk):
    return F.concat(F.lit(directory.rstrip("/") + "/"), F.format_string("chunk-%05d.mkv", chunk))


def to_do(planned: DataFrame, committed: DataFrame) -> DataFrame:
    """Planned chunks (stream_id, chunk, path) whose path isn't committed."""
    return planned.join(committed.select("stream_id", "chunk", F.col("artifact").alias("path")), ["stream_id", "chunk", "path"], "left_anti")


def verified(planned: DataFrame, written: DataFrame) -> DataFrame:
    """Planned and written counts by chunk; a mismatch raises when the row is computed."""
    t = planned.join(written, ["stream_id", "chunk"])
    message = F.format_string("chunk %d: %d frames planned, %d written", "chunk", "outputs", "written")
    return t.withColumn("ok", F.when(F.col("outputs") == F.col("written"), True).otherwise(F.raise_error(message).cast("boolean")))


def progress(segs: DataFrame, shots: DataFrame) -> DataFrame:
    """Fraction of the input done and frames emitted after each segment."""
    n = shots.groupBy("stream_id").agg(F.max("end_frame").alias("n"))
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return segs.join(n, "stream_id").select("stream_id", "seq", F.least((F.col("last") + 1) / F.col("n"), F.lit(1.0)).alias("fraction"), F.sum(emitted()).over(w).alias("done"))


def require_chunks(planned: DataFrame, files: DataFrame) -> DataFrame:
    """Planned chunks with their files' paths; a chunk without a file raises when its row is computed."""
    t = planned.select("stream_id", "chunk").join(files.select("stream_id", "chunk", "path"), ["stream_id", "chunk"], "left")
    missing = F.raise_error(F.format_string("chunk %d of stream %d is missing", "chunk", "stream_id")).cast("string")
    return t.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(missing))


def concat_list(files: DataFrame) -> DataFrame:
    """(stream_id, listing): one line per chunk in order; backslashes become slashes, quotes are escaped."""
    path = F.replace(F.translate("path", "\\", "/"), F.lit("'"), F.lit("'\\''"))
    line = F.struct("chunk", F.concat(F.lit("file '"), path, F.lit("'")).alias("line"))
    return files.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("listing"))
