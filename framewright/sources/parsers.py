"""Tolerant sources: probe JSON, progress blocks, counter lines, loudness logs, capability tables,
telemetry CSV, raw rasters, PCM and float WAV; and the WAV, report and publication sinks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import exact_time as X

#: Fixed values.
MEDIA_EXTENSIONS = ("mkv", "mp4", "m4v", "avi", "mov", "wmv", "mpg", "mpeg", "m2ts", "ts", "vob", "webm", "flv", "ogv", "rmvb", "rm", "divx", "mts", "iso", "mxf")
OOM_NEEDLES = (
    "out of memory", "cuda out of memory", "cuda_error_out_of_memory", "cannot allocate memory",
    "failed to allocate", "insufficient memory", "vk_error_out_of_device_memory", "not enough memory",
)
RETRYABLE = ("ffmpeg", "plugin", "device_memory", "stage")

_S, _M = T.StringType(), T.MapType(T.StringType(), T.StringType())
_TEXT_FIELDS = (
    "index", "codec_name", "codec_type", "width", "height", "r_frame_rate", "avg_frame_rate", "time_base", "duration_ts", "duration", "nb_frames", "bit_rate",
    "sample_aspect_ratio", "field_order", "color_transfer", "color_range", "channels", "channel_layout", "sample_rate", "filename",
)
STREAM = T.StructType([*[T.StructField(n, _S) for n in _TEXT_FIELDS], T.StructField("disposition", _M), T.StructField("tags", _M)])
PROBE = T.StructType(
    [
        T.StructField("streams", T.ArrayType(STREAM)), T.StructField("chapters", T.ArrayType(T.StructType([T.StructField("start_time", _S), T.StructField("end_time", _S)]))),
        T.StructField("format", T.StructType([T.StructField(n, _S) for n in ("duration", "start_time", "format_name", "bit_rate")] + [T.StructField("tags", _M)])),
    ]
)


def tolerant(c: Column, kind: str) -> Column:
    """A number, boolean or text as ``kind``; NULL for N/A in any case, empty and junk."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "n/a"), t).try_cast(kind)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of sidecar documents; a missing path is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def manifests(documents: DataFrame) -> DataFrame:
    """(path, .., m): documents with JSON parsed under the probe schema; nothing is inferred."""
    return documents.withColumn("m", F.from_json("json", PROBE))


def streams(parsed: DataFrame) -> DataFrame:
    """One row per stream of a known kind, in listed order, typed tolerantly."""
    t = parsed.select("path", F.posexplode(F.coalesce("m.streams", F.array().cast(T.ArrayType(STREAM)))).alias("pos", "s"))
    t = t.filter(F.col("s.codec_type").isin("video", "audio", "subtitle", "attachment"))
    num = lambda n, kind="bigint": tolerant(F.col(f"s.{n}"), kind)
    flag = lambda n: F.coalesce(tolerant(F.element_at("s.disposition", n), "bigint"), F.lit(0).cast("long")) != 0
    avg, raw = X.parse_frame_rate(F.col("s.avg_frame_rate")), X.parse_frame_rate(F.col("s.r_frame_rate"))
    return t.select(
        "path", "pos", F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), num("width").alias("width"), num("height").alias("height"), F.coalesce(avg, raw).alias("fps"),
        X.parse_ratio_colon(F.col("s.sample_aspect_ratio")).alias("sar"), num("duration", "double").alias("duration"), num("nb_frames").alias("frames"), num("channels").alias("channels"),
        F.col("s.channel_layout").alias("layout"), F.col("s.field_order").alias("field_order"), F.col("s.color_transfer").alias("transfer"), F.col("s.color_range").alias("range"),
        flag("attached_pic").alias("attached"), flag("default").alias("is_default"), F.element_at("s.tags", "language").alias("language"), F.element_at("s.tags", "title").alias("title"),
        F.coalesce("s.filename", F.element_at("s.tags", "filename")).alias("filename"), F.col("s.codec_name").isin("ac3", "eac3").alias("carries_drc"),
    )


def square_size(s: DataFrame) -> DataFrame:
    """Square-pixel width max(w sar, 2) by exact integer division, and height; no or zero ratio is 1:1."""
    ok = F.col("sar.num").isNotNull() & (F.col("sar.num") != 0)
    n, d = F.when(ok, F.col("sar.num")).otherwise(F.lit(1).cast("long")), F.when(ok, F.col("sar.den")).otherwise(F.lit(1).cast("long"))
    return s.withColumns({"square_w": F.greatest(F.call_function("div", F.col("width") * n, d), F.lit(2).cast("long")), "square_h": F.col("height")})


def is_cover_art() -> Column:
    still = F.coalesce(F.col("codec").isin("mjpeg", "png", "bmp", "gif", "webp"), F.lit(False))
    return F.col("attached") | (still & F.coalesce((F.col("width") <= 2048) & (F.col("height") <= 2048), F.lit(False)))


def primary_video(s: DataFrame) -> DataFrame:
    """Per path the first video that is neither attached nor cover art, else not attached, else the first."""
    tier = F.when(~is_cover_art(), 0).when(~F.col("attached"), 1).otherwise(2)
    w = Window.partitionBy("path").orderBy(tier, "pos")
    return s.filter("kind = 'video'").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def primary_audio(s: DataFrame) -> DataFrame:
    """Per path the first default audio, else the first."""
    w = Window.partitionBy("path").orderBy(~F.col("is_default"), "pos")
    return s.filter("kind = 'audio'").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def is_hdr() -> Column:
    return F.coalesce(F.col("transfer").isin("smpte2084", "arib-std-b67"), F.lit(False))


def is_limited_range() -> Column:
    return F.coalesce(F.col("range").isin("tv", "mpeg", "limited"), F.lit(False))


def declared_interlaced() -> Column:
    return F.coalesce(F.col("field_order").isin("tt", "bb", "tb", "bt"), F.lit(False))


def expected_frames(duration: Column, fps: Column) -> Column:
    return F.round(duration * fps["num"] / fps["den"]).cast("long")


def vfr_suspected(frames: Column, expected: Column) -> Column:
    """Counts that differ by more than max(expected div 100, 2); False where either is unknown."""
    return F.coalesce(F.abs(frames - expected) > F.greatest(F.call_function("div", expected, F.lit(100).cast("long")), F.lit(2).cast("long")), F.lit(False))


def content_duration(raw: Column, start: Column) -> Column:
    return F.greatest(raw - F.greatest(F.coalesce(start, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def duration_microseconds(text: Column) -> Column:
    """Exact decimal seconds as whole microseconds."""
    million = F.struct(F.lit(1_000_000).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    return X.round_half_away(X.multiply(X.from_decimal(text), million))


def problems(has_video: Column, fps: Column, width: Column, height: Column, hdr: Column, seconds: Column, vfr: Column) -> Column:
    """The validation texts that apply, in order."""
    found = F.array(
        F.when(~has_video, "no video stream"), F.when(has_video & fps.isNull(), "unknown frame rate"), F.when(has_video & (width.isNull() | height.isNull()), "missing dimensions"),
        F.when(has_video & hdr, "hdr source"), F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "no duration"), F.when(vfr, "variable frame rate"),
    )
    return F.array_compact(found)


def inventory(s: DataFrame) -> DataFrame:
    """What must be preserved: streams by kind, attachment names."""
    n = lambda k: F.count_if(F.col("kind") == k)
    names = F.array_compact(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "attachment", F.struct("pos", "filename")))), lambda x: x["filename"]))
    return s.groupBy("path").agg(n("video").alias("video"), n("audio").alias("audio"), n("subtitle").alias("subtitles"), n("attachment").alias("attachments"), F.array_join(names, ",").alias("names"))


def summary_lines(t: DataFrame, columns: list[str]) -> DataFrame:
    """(path, key, value): one row per column that is not NULL."""
    return t.select("path", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("path", "e.key", "e.value").filter("value IS NOT NULL")


def describe() -> Column:
    """codec WxH [language] "title" with what is known."""
    size = F.when(F.col("width").isNotNull(), F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    return F.concat_ws(" ", F.coalesce("codec", F.lit("?")), size, F.when(F.col("language").isNotNull(), F.concat(F.lit("["), "language", F.lit("]"))), F.when(F.col("title").isNotNull(), F.concat(F.lit('"'), "title", F.lit('"'))))


def looks_like_media(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./\\]\.([^./\\]+)$", 1)).isin(*MEDIA_EXTENSIONS)


def looks_like_oom(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in OOM_NEEDLES]), lambda n: F.contains(F.lower(text), n))


def retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def enum(value: Column, known: list[str], default: str) -> Column:
    """A wire name, or the default for anything else."""
    return F.when(F.lower(value).isin(*known), F.lower(value)).otherwise(default)


def log_line(at_ms: Column, level: Column, stage: Column, message: Column) -> Column:
    """HH:MM:SS.mmm LEVEL [stage] message, the time within its day."""
    ms = at_ms % 86_400_000
    div = lambda n: F.call_function("div", ms, F.lit(n).cast("long"))
    clock = F.format_string("%02d:%02d:%02d.%03d %-5s ", div(3_600_000), div(60_000) % 60, div(1000) % 60, ms % 1000, level)
    return F.concat(clock, F.when(stage.isNotNull(), F.concat(F.lit("["), stage, F.lit("] "))).otherwise(""), message)


def driver_version(vendor: Column, raw: Column) -> Column:
    """Vendor bit fields: 10.8.8.6 for nvidia, else 10.10.12."""
    bits = lambda shift, n: F.shiftright(raw, shift).bitwiseAND(F.lit(2**n - 1).cast("long"))
    return F.when(vendor == "nvidia", F.concat_ws(".", bits(22, 10), bits(14, 8), bits(6, 8), bits(0, 6))).otherwise(F.concat_ws(".", bits(22, 10), bits(12, 10), bits(0, 12)))


VENDORS = {0x10DE: "nvidia", 0x1002: "amd", 0x1022: "amd", 0x8086: "intel", 0x106B: "apple", 0x5143: "qualcomm"}


def vendor_name(ident: Column) -> Column:
    table = F.create_map(*[x for k, v in VENDORS.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(F.try_element_at(table, ident.cast("long")), F.lit("unknown"))


def quoted(args: Column) -> Column:
    """Arguments joined by spaces; those with spaces, quotes or nothing are quoted, quotes escaped."""
    one = lambda a: F.when((a == "") | a.rlike(r"""[\s"']"""), F.concat(F.lit('"'), F.replace(a, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(a)
    return F.array_join(F.transform(args, one), " ")


def progress_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of key=value lines (source, line_no, line) closed by progress=: one row per closed block.

    The first numeric out_time_us or out_time_ms of a block wins; other keys take their last value;
    N/A and junk are NULL; an unclosed tail gives nothing.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    kv = lines.withColumns({"key": F.trim(F.regexp_extract("line", r"^\s*([^=]*)=", 1)), "value": F.trim(F.regexp_extract("line", r"=(.*)$", 1)), "ok": F.contains("line", F.lit("="))}).filter("ok")
    closes = (F.col("key") == "progress").cast("int")
    kv = kv.withColumn("block", F.coalesce(F.sum(closes).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no")))
    us = tolerant(F.col("value"), "bigint")
    is_time = F.col("key").isin("out_time_us", "out_time_ms") & us.isNotNull()
    t = kv.groupBy("source", "block").agg(
        last("frame").alias("frame"), last("fps").alias("fps"), F.min_by(F.when(is_time, us), F.when(is_time, F.col("line_no"))).alias("out_time_us"), last("total_size").alias("total_size"),
        last("speed").alias("speed"), last("drop_frames").alias("drop_frames"), last("dup_frames").alias("dup_frames"), last("progress").alias("progress"),
    )
    return t.filter("progress IS NOT NULL").select(
        "source", "block", tolerant(F.col("frame"), "bigint").alias("frame"), tolerant(F.col("fps"), "double").alias("fps"), "out_time_us", tolerant(F.col("total_size"), "bigint").alias("total_size"),
        tolerant(F.regexp_replace("speed", "[xX]+$", ""), "double").alias("speed"), tolerant(F.col("drop_frames"), "bigint").alias("drop_frames"), tolerant(F.col("dup_frames"), "bigint").alias("dup_frames"),
        (F.lower("progress") == "end").alias("ended"),
    )


def counter_line(line: Column) -> tuple[Column, Column]:
    """(kind, map of lower-case label to count) of a field-count line; NULL kind for others."""
    kind = F.when(F.contains(line, F.lit("Repeated Fields:")), "repeated").when(F.contains(line, F.lit("Single frame detection:")), "single").when(F.contains(line, F.lit("Multi frame detection:")), "multi")
    rest = F.regexp_extract(line, r"(?:Repeated Fields|Single frame detection|Multi frame detection):(.*)$", 1)
    labels, values = (F.regexp_extract_all(rest, F.lit(r"([^\s:]+):\s*(\d+)(?=\s|$)"), F.lit(i)) for i in (1, 2))
    counts = F.map_from_arrays(F.transform(labels, lambda x: F.lower(x)), F.transform(values, lambda x: x.cast("long")))
    return F.when(F.size(labels) > 0, kind), F.when(F.size(labels) > 0, counts)


def loudness_report(lines: DataFrame) -> DataFrame:
    """(source, lra_low, lra_high, lra, threshold, peak, integrated) of log lines; the last occurrence wins,
    and a line counts for the first label it holds in the order here."""
    line = F.col("line")
    has = lambda s: F.contains(line, F.lit(s))
    after = lambda s: F.regexp_extract(line, s + r"\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    kinds = {"lra_low": "LRA low:", "lra_high": "LRA high:", "lra": "LRA:", "threshold": "Threshold:", "peak": "Peak:", "integrated": "I:"}
    kind, value = None, None
    for name, label in kinds.items():
        test = has(label) & has("LUFS") if name == "integrated" else has(label)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        value = F.when(test, after(label)) if value is None else value.when(test, after(label))
    t = lines.withColumns({"k": kind, "v": value}).filter("v IS NOT NULL")
    return t.groupBy("source").agg(*[F.max_by(F.when(F.col("k") == n, F.col("v")), F.when(F.col("k") == n, F.col("line_no"))).alias(n) for n in kinds])


def pts_time(line: Column) -> Column:
    return F.regexp_extract(line, r"pts_time:\s*([0-9.]+)", 1).try_cast("double")


def capabilities(text: Column) -> Column:
    """Names of a ``<flags> <name>`` table; legend, heading and rule lines are skipped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    ok = lambda x: (x != "") & ~x.endswith(":") & ~F.contains(x, F.lit(" = ")) & ~x.startswith("--") & x.rlike(r"^[.VASDEFXBTCN|]+\s+[^\s=]+(\s|$)")
    return F.transform(F.filter(lines, ok), lambda x: F.regexp_extract(x, r"^\S+\s+(\S+)", 1))


def version_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"version\s+(\S+)", 1), F.lit(""))


def hwaccels(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.endswith(":") & ~F.contains(x, F.lit("Hardware acceleration")))


def pixel_formats(text: Column) -> Column:
    rest = F.trim(F.regexp_extract(text, r"(?m)^\s*Supported pixel formats:(.*)$", 1))
    return F.when(rest != "", F.split(rest, r"\s+")).otherwise(F.array().cast("array<string>"))


def telemetry_csv(line: Column, bytes_used: bool = False) -> Column:
    """(name, total_mib, used_mib) of one telemetry row of at least three columns, else NULL; byte counts become MiB."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    at = lambda i: F.get(parts, i).try_cast("bigint")
    scale = lambda c: F.call_function("div", c, F.lit(1048576).cast("long")) if bytes_used else c
    return F.when((F.size(parts) >= 3) & at(1).isNotNull(), F.struct(F.get(parts, 0).alias("name"), scale(at(1)).alias("total_mib"), scale(at(2)).alias("used_mib")))


def rasters(files: DataFrame, w: int, h: int) -> DataFrame:
    """(path, frame_idx, w, h, data) of binary files of fixed-size records; a partial last record ends the stream."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                n = len(content) // (w * h)
                for at in range(0, n, 256):
                    block = np.frombuffer(content, np.uint8, (min(n, at + 256) - at) * w * h, at * w * h).reshape(-1, w * h).astype(np.int32)
                    yield pd.DataFrame({"path": path, "frame_idx": range(at, at + len(block)), "w": w, "h": h, "data": list(block)})

    return files.select("path", "content").mapInPandas(cut, "path string, frame_idx long, w int, h int, data array<int>")


def pcm(files: DataFrame, channels: int) -> DataFrame:
    """(path, frame_idx, ch, sample) of raw little-endian float files, cut to whole samples, then frames."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield from _sample_frames(path, np.frombuffer(content, "<f4", len(content) // 4), channels)

    return files.select("path", "content").mapInPandas(read, "path string, frame_idx long, ch int, sample float")


def _sample_frames(path: str, x: np.ndarray, channels: int, step: int = 65536) -> Iterator[pd.DataFrame]:
    frames = len(x) // channels
    for at in range(0, frames, step):
        n = min(step, frames - at)
        yield pd.DataFrame({"path": path, "frame_idx": np.repeat(np.arange(at, at + n), channels), "ch": np.tile(np.arange(channels, dtype=np.int32), n), "sample": x[at * channels : (at + n) * channels]})


def parse_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples) of a RIFF file of 32-bit floats; chunks are padded to even sizes; other formats are refused."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if (kind, bits) != (3, 32):
                raise ValueError(f"format {kind} of {bits} bits is not 32-bit float")
            fmt = rate, channels
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before fmt")
            size = min(size, len(content) - at - 8)
            return *fmt, np.frombuffer(content, "<f4", size // 4, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def write_wav(rate: int, channels: int, samples: np.ndarray) -> bytes:
    """A float WAV file; sizes saturate at 32 bits."""
    data = samples.astype("<f4").tobytes()
    size = min(len(data), 2**32 - 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + size, 2**32 - 1), b"WAVE", b"fmt ", 16, 3, channels, rate, rate * channels * 4, channels * 4, 32, b"data", size)
    return head + data


def wav(files: DataFrame) -> DataFrame:
    """(path, frame_idx, ch, sample) of float WAV files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                _, channels, x = parse_wav(content)
                yield from _sample_frames(path, x, channels)

    return files.select("path", "content").mapInPandas(read, "path string, frame_idx long, ch int, sample float")


def publish(df: DataFrame, destination: str) -> None:
    """Writes beside the destination, then renames over it, through the store's own file system."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    temp, dest = path(f"{destination}.tmp-{uuid.uuid4().hex}"), path(destination)
    df.write.parquet(temp.toString())
    fs = dest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(temp):
        raise FileNotFoundError(temp.toString())
    if dest.getParent() is not None:
        fs.mkdirs(dest.getParent())
    fs.delete(dest, True)
    if not fs.rename(temp, dest):
        raise OSError(f"{temp} could not be renamed")


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON documents."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
