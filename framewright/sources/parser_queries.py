"""Queries of the tolerant parsers; the texts are built from the sales and event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import read_table
from framewright.sources import parsers as P


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe document per part: video, sometimes cover art, audio, subtitle, attachment and an unknown stream."""
    p = read_table(spark, sf_dir, "part")
    text = """
    '{"streams":[' ||
    CASE WHEN p_partkey % 4 = 0 THEN '{"index":9,"codec_type":"video","codec_name":"mjpeg","width":600,"height":"600","avg_frame_rate":"0/0","disposition":{"attached_pic":1}},' ELSE '' END ||
    CASE WHEN p_partkey % 9 = 5 THEN '' ELSE '{"index":0,"codec_type":"video","codec_name":"mpeg2video","width":' || (p_size * 16) || ',"height":"' || (p_size * 9) || '","avg_frame_rate":"' ||
      CASE WHEN p_partkey % 5 = 0 THEN '0/0' ELSE '30000/1001' END || '","r_frame_rate":"25/1","sample_aspect_ratio":"' || CASE WHEN p_partkey % 6 = 0 THEN 'N/A' ELSE '32:27' END || '","duration":"' || p_partkey || '.5","nb_frames":"' ||
      CASE WHEN p_partkey % 7 = 0 THEN 'N/A' ELSE CAST(p_partkey * 30 AS STRING) END || '","field_order":"' || CASE WHEN p_size % 2 = 0 THEN 'tt' ELSE 'progressive' END || '","color_transfer":"' || CASE WHEN p_size % 10 = 0 THEN 'smpte2084' ELSE 'bt709' END || '","tags":{"title":"' || p_name || '"}},' END ||
    '{"index":1,"codec_type":"audio","codec_name":"ac3","channels":"6","disposition":{"default":0},"tags":{"language":"eng"}},{"index":2,"codec_type":"audio","codec_name":"aac","channels":2,"disposition":{"default":' || (p_size % 2) || '}},' ||
    '{"index":3,"codec_type":"data"},{"index":4,"codec_type":"subtitle","codec_name":"subrip"},{"index":5,"codec_type":"attachment","tags":{"filename":"font' || p_size || '.ttf"}}],"format":{"duration":"' || p_partkey || '.5","start_time":"' || (p_size - 20) || '.25"}}'
    """
    return p.select(F.col("p_partkey").cast("string").alias("path"), F.expr(text).alias("json"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary video and audio, sizes, rates, durations and problems of every document."""
    m = P.manifests(_json(spark, sf_dir))
    s = P.streams(m)
    v, a = P.square_size(P.primary_video(s)), P.primary_audio(s).select("path", F.col("codec").alias("audio"), F.col("channels").alias("audio_channels"), "carries_drc")
    t = m.select("path", P.tolerant(F.col("m.format.duration"), "double").alias("raw"), P.tolerant(F.col("m.format.start_time"), "double").alias("start"), P.duration_microseconds(F.col("m.format.duration")).alias("us"))
    t = t.join(v.withColumn("has", F.lit(True)).drop("channels", "carries_drc"), "path", "left").join(a, "path", "left")
    expected = P.expected_frames(F.col("duration"), F.col("fps"))
    t = t.withColumns({"expected": expected, "content": P.content_duration(F.col("raw"), F.col("start")), "has": F.coalesce("has", F.lit(False))})
    t = t.withColumn("vfr", P.vfr_suspected(F.col("frames"), F.col("expected")))
    found = P.problems(F.col("has"), F.col("fps"), F.col("width"), F.col("height"), P.is_hdr(), F.col("content"), F.col("vfr"))
    return t.select(
        "path", "codec", "square_w", "square_h", F.col("fps.num").alias("fps_num"), F.col("fps.den").alias("fps_den"), "expected", "frames", "vfr", "us", "content",
        P.is_hdr().alias("hdr"), P.declared_interlaced().alias("interlaced"), "audio", "audio_channels", "carries_drc", F.array_join(found, "; ").alias("problems"),
    )


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams to preserve and their descriptions."""
    s = P.streams(P.manifests(_json(spark, sf_dir)))
    d = s.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", P.describe().alias("d")))), lambda x: x["d"]), "; ").alias("described"), F.count_if((F.col("kind") == "video") & P.is_cover_art()).alias("covers"))
    return P.inventory(s).join(d, "path")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value rows of the manifests, and their JSON report's length."""
    t = manifests(spark, sf_dir).select("path", "codec", "square_w", "fps_num", "audio")
    return P.summary_lines(t, ["codec", "square_w", "fps_num", "audio"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of one source per user: some events are fields, errors close a block."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "error", F.when(k % 5 == 0, "progress=end").otherwise("progress=continue")).when(k % 7 == 0, "out_time_us=N/A").when(k % 7 == 1, F.concat(F.lit("out_time_ms="), k.cast("string")))
        .when(k % 7 == 2, F.concat(F.lit("out_time_us="), k.cast("string"))).when(k % 7 == 3, F.concat(F.lit("frame= "), k.cast("string"))).when(k % 7 == 4, F.concat(F.lit("speed="), (k % 100).cast("string"), F.lit(".5x")))
        .when(k % 7 == 5, F.lit("fps=N/A")).otherwise("noise")
    )
    return e.select((F.col("user_id") % 50).alias("source"), k.alias("line_no"), line.alias("line"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed progress blocks."""
    return P.progress_blocks(_lines(spark, sf_dir))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-count lines, times and out-of-memory texts."""
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    q, k = F.col("l_quantity").cast("long"), F.col("l_partkey")
    line = F.when(k % 4 == 0, F.format_string("[x] Repeated Fields: Neither: %6d Top:%d Bottom: %d", q, k, q + 1)).when(k % 4 == 1, F.format_string("Multi frame detection: TFF: %d BFF: %d Progressive: %d", q, k, q)).when(k % 4 == 2, F.format_string("n:%d pts_time:%d.25 Out Of Memory", k, q)).otherwise("Single frame detection: nothing")
    kind, counts = P.counter_line(line)
    at = lambda n: F.try_element_at(counts, F.lit(n))
    t = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), at("neither").alias("neither"), at("top").alias("top"), at("bff").alias("bff"), P.pts_time(line).alias("pts"), P.looks_like_oom(line).alias("oom"))
    return t


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness logs of one source per supplier."""
    l = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")  # noqa: E741
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    l = l.withColumn("n", F.row_number().over(w))  # noqa: E741
    v = F.concat(F.lit("-"), (F.col("l_partkey") % 60).cast("string"), F.lit(".5"))
    line = (
        F.when(F.col("n") % 6 == 0, F.concat(F.lit("  LRA low: "), v, F.lit(" LUFS"))).when(F.col("n") % 6 == 1, F.concat(F.lit("LRA:  "), F.col("n").cast("string"), F.lit(" LU"))).when(F.col("n") % 6 == 2, F.concat(F.lit("Threshold: "), v))
        .when(F.col("n") % 6 == 3, F.concat(F.lit("I: "), v, F.lit(" LUFS"))).when(F.col("n") % 6 == 4, F.concat(F.lit("I: "), v)).otherwise(F.concat(F.lit("Peak: "), v, F.lit(" dBFS")))
    )
    return P.loudness_report(l.select(F.col("l_suppkey").alias("source"), F.col("n").alias("line_no"), line.alias("line")))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capability tables, versions, accelerators, formats, telemetry, paths."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    table = F.concat(F.lit("Encoders:\n V..... = Video\n ------\n V....D "), F.concat_ws("_", F.lit("enc"), k.cast("string")), F.lit(" text\n A.X... aac AAC\n?? bad\n VF k=v\n"))
    raw = k * 1048583 % 4294967296
    csv = F.concat(F.col("p_name"), F.lit(", "), (k * 1048576).cast("string"), F.lit(","), F.when(k % 3 == 0, "junk").otherwise((k * 2097151).cast("string")))
    tel = P.telemetry_csv(csv, bytes_used=True)
    path = F.concat(F.lit("/a.b/"), F.col("p_name"), F.when(k % 3 == 0, ".MKV").when(k % 3 == 1, ".txt").otherwise(""))
    return p.select(
        "p_partkey", F.array_join(P.capabilities(table), ",").alias("names"), P.version_number(F.concat(F.lit("tool version "), k.cast("string"), F.lit(".1 x"))).alias("version"),
        F.array_join(P.hwaccels(F.lit("Hardware acceleration methods:\nvulkan\n cuda \n")), ",").alias("accels"), F.array_join(P.pixel_formats(F.concat(F.lit("x\n  Supported pixel formats: nv12 p"), k.cast("string"))), ",").alias("formats"),
        tel["total_mib"].alias("total_mib"), tel["used_mib"].alias("used_mib"), P.looks_like_media(path).alias("is_media"), P.driver_version(F.when(k % 2 == 0, "nvidia").otherwise("amd"), raw).alias("driver"),
        P.vendor_name(F.element_at(F.array(*[F.lit(x) for x in (0x10DE, 0x1022, 0x8086, 7)]), (k % 4 + 1).cast("int"))).alias("vendor"), P.quoted(F.array(F.lit("tool"), F.col("p_name"), F.lit(""), F.lit('a"b'))).alias("command"),
    )


_DOCS = """p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS path, p_size AS s, p_name, p_partkey % 9 <> 5 AS main, p_partkey % 4 = 0 AS art FROM part)"""
ORACLES = {}
ORACLES["manifests"] = f"""WITH {_DOCS},
q AS (SELECT *, CASE WHEN main THEN s * 16 WHEN art THEN 600 END::BIGINT AS w, CASE WHEN main THEN s * 9 WHEN art THEN 600 END::BIGINT AS h, CASE WHEN main THEN CASE WHEN k % 5 = 0 THEN 25 ELSE 30000 END END::BIGINT AS fn, CASE WHEN main THEN CASE WHEN k % 5 = 0 THEN 1 ELSE 1001 END END::BIGINT AS fd FROM p),
r AS (SELECT *, CASE WHEN main AND k % 6 <> 0 THEN w * 32 // 27 ELSE w END AS sw, CASE WHEN main THEN round((k + 0.5::DOUBLE) * fn / fd)::BIGINT END AS ex, CASE WHEN main AND k % 7 <> 0 THEN k * 30 END::BIGINT AS fr,
  greatest(k + 0.5::DOUBLE - greatest(CASE WHEN s - 20 < 0 THEN s - 20 - 0.25 ELSE s - 20 + 0.25 END, 0), 0) AS content, main AND s % 10 = 0 AS hdr FROM q),
t AS (SELECT *, coalesce(abs(fr - ex) > greatest(ex // 100, 2), false) AS vfr FROM r)
SELECT path, CASE WHEN main THEN 'mpeg2video' WHEN art THEN 'mjpeg' END AS codec, CASE WHEN w IS NOT NULL THEN greatest(sw, 2) END AS square_w, h AS square_h, fn AS fps_num, fd AS fps_den, ex AS expected, fr AS frames, vfr, k * 1000000 + 500000 AS us, content::DOUBLE AS content, hdr,
  main AND s % 2 = 0 AS interlaced, CASE WHEN s % 2 = 1 THEN 'aac' ELSE 'ac3' END AS audio, CASE WHEN s % 2 = 1 THEN 2 ELSE 6 END::BIGINT AS audio_channels, s % 2 = 0 AS carries_drc,
  concat_ws('; ', CASE WHEN NOT main AND NOT art THEN 'no video stream' END, CASE WHEN art AND NOT main THEN 'unknown frame rate' END, CASE WHEN hdr THEN 'hdr source' END, CASE WHEN content <= 0 THEN 'no duration' END, CASE WHEN vfr THEN 'variable frame rate' END) AS problems FROM t"""
ORACLES["inventories"] = f"""WITH {_DOCS} SELECT path, (main::INT + art::INT)::BIGINT AS video, 2::BIGINT AS audio, 1::BIGINT AS subtitles, 1::BIGINT AS attachments, 'font' || s || '.ttf' AS names,
  concat_ws('; ', CASE WHEN art THEN 'mjpeg 600x600' END, CASE WHEN main THEN 'mpeg2video ' || (s * 16) || 'x' || (s * 9) || ' "' || p_name || '"' END, 'ac3 [eng]', 'aac', 'subrip', '?') AS described, art::INT::BIGINT AS covers FROM p"""
ORACLES["summaries"] = f"""WITH m AS ({ORACLES["manifests"]}), u AS (SELECT path, 'codec' AS key, codec AS value FROM m UNION ALL SELECT path, 'square_w', square_w::VARCHAR FROM m UNION ALL SELECT path, 'fps_num', fps_num::VARCHAR FROM m UNION ALL SELECT path, 'audio', audio FROM m)
SELECT * FROM u WHERE value IS NOT NULL"""
ORACLES["progress_blocks"] = """WITH e AS (SELECT user_id % 50 AS source, event_id AS k, event_type = 'error' AS closes FROM events),
l AS (SELECT * FROM e WHERE closes OR k % 7 <> 6),
b AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM l)
SELECT source, block, max(k) FILTER (WHERE NOT closes AND k % 7 = 3) AS frame, NULL::DOUBLE AS fps, min(k) FILTER (WHERE NOT closes AND k % 7 IN (1, 2)) AS out_time_us, NULL::BIGINT AS total_size,
  arg_max(k % 100 + 0.5, k) FILTER (WHERE NOT closes AND k % 7 = 4)::DOUBLE AS speed, NULL::BIGINT AS drop_frames, NULL::BIGINT AS dup_frames, max(k) FILTER (WHERE closes) % 5 = 0 AS ended FROM b GROUP BY ALL HAVING bool_or(closes)"""
ORACLES["counters"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'repeated' WHEN 1 THEN 'multi' END AS kind, CASE WHEN l_partkey % 4 = 0 THEN l_quantity::BIGINT END AS neither,
  CASE WHEN l_partkey % 4 = 0 THEN l_partkey END AS top, CASE WHEN l_partkey % 4 = 1 THEN l_partkey END AS bff, CASE WHEN l_partkey % 4 = 2 THEN l_quantity::BIGINT + 0.25 END::DOUBLE AS pts, l_partkey % 4 = 2 AS oom FROM lineitem"""
ORACLES["loudness_reports"] = """WITH l AS (SELECT l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, -(l_partkey % 60) - 0.5 AS v FROM lineitem)
SELECT source, arg_max(v, n) FILTER (WHERE n % 6 = 0)::DOUBLE AS lra_low, NULL::DOUBLE AS lra_high, max(n) FILTER (WHERE n % 6 = 1)::DOUBLE AS lra, arg_max(v, n) FILTER (WHERE n % 6 = 2)::DOUBLE AS threshold, arg_max(v, n) FILTER (WHERE n % 6 = 5)::DOUBLE AS peak,
  arg_max(v, n) FILTER (WHERE n % 6 = 3)::DOUBLE AS integrated FROM l GROUP BY source"""
ORACLES["capabilities"] = """WITH p AS (SELECT p_partkey AS k, p_name, p_partkey * 1048583 % 4294967296 AS raw FROM part)
SELECT k AS p_partkey, 'enc_' || k || ',aac' AS names, k || '.1' AS version, 'vulkan,cuda' AS accels, 'nv12,p' || k AS formats, k AS total_mib, CASE WHEN k % 3 > 0 THEN k * 2097151 // 1048576 END AS used_mib, k % 3 = 0 AS is_media,
  CASE WHEN k % 2 = 0 THEN concat_ws('.', (raw >> 22) & 1023, (raw >> 14) & 255, (raw >> 6) & 255, raw & 63) ELSE concat_ws('.', (raw >> 22) & 1023, (raw >> 12) & 1023, raw & 4095) END AS driver,
  ['nvidia', 'amd', 'intel', 'unknown'][(k % 4 + 1)::INT] AS vendor, 'tool "' || p_name || '" "" "a\\"b"' AS command FROM p""".replace("\\\\", "\\")

CHANNELS = 3


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): files of 1000 event values each, with a partial last record."""
    e = read_table(spark, sf_dir, "events").select(F.call_function("div", F.col("event_id"), F.lit(1000).cast("long")).alias("file"), "event_id", (F.round(F.col("value") * 100).cast("long") % 251).alias("v"))
    files = e.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("v"))

    def content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v) for v in pdf["v"]]
            if kind == "raster":
                made = [v.astype(np.uint8).tobytes() for v in values]
            elif kind == "pcm":
                made = [v.astype("<f4").tobytes() + b"\x00\x01" for v in values]
            else:
                made = [P.write_wav(48000, CHANNELS, v.astype(np.float32)) for v in values]
            yield pd.DataFrame({"path": pdf["file"].astype(str), "content": made})

    return files.mapInPandas(content, "path string, content binary")


def raster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster records of 7 x 3 bytes; the partial last one ends the stream."""
    t = P.rasters(_files(spark, sf_dir, "raster"), 7, 3)
    return t.select("path", "frame_idx", "w", "h", F.array_join("data", ",").alias("data"))


def pcm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float samples cut to whole frames of three channels."""
    return P.pcm(_files(spark, sf_dir, "pcm"), CHANNELS).withColumn("sample", F.col("sample").cast("double"))


def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through float WAV files, written and read back."""
    return P.wav(_files(spark, sf_dir, "wav")).withColumn("sample", F.col("sample").cast("double"))


_FILES = """e AS (SELECT event_id // 1000 AS file, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS pos, CAST(round(value * 100) AS BIGINT) % 251 AS v, count(*) OVER (PARTITION BY event_id // 1000) AS n FROM events)"""
ORACLES["raster_scan"] = f"""WITH {_FILES} SELECT file::VARCHAR AS path, pos // 21 AS frame_idx, 7 AS w, 3 AS h, string_agg(v::VARCHAR, ',' ORDER BY pos) AS data FROM e WHERE pos < n // 21 * 21 GROUP BY ALL"""
for _name in ("pcm_scan", "wav_scan"):
    ORACLES[_name] = f"WITH {_FILES} SELECT file::VARCHAR AS path, pos // 3 AS frame_idx, (pos % 3)::INT AS ch, v::DOUBLE AS sample FROM e WHERE pos < n // 3 * 3"

QUERIES = {
    "raster_scan": raster_scan, "pcm_scan": pcm_scan, "wav_scan": wav_scan,
    "manifests": manifests, "inventories": inventories, "summaries": summaries, "progress_blocks": progress, "counters": counters, "loudness_reports": loudness, "capabilities": capabilities,
}
