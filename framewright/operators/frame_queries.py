"""Queries of frame analytics; rasters are runs of 64 event values (8 x 8), dealt to two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import frames as V
from framewright.session import read_table

FPS = 24.0


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("c"))
    run, at = F.call_function("div", F.col("event_id"), F.lit(64).cast("long")), F.col("event_id") % 64
    shade = F.call_function("div", run, F.lit(20).cast("long")) % 3 * 70
    t = e.select(
        (run % 2).alias("stream_id"), F.call_function("div", run, F.lit(2).cast("long")).alias("frame_idx"), (at % 8).cast("int").alias("x"),
        F.call_function("div", at, F.lit(8).cast("long")).cast("int").alias("y"), (F.col("c") % 90 + shade).cast("int").alias("value"),
    )
    return t


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pixels(spark, sf_dir).groupBy("stream_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("p"))
    return t.filter(F.size("p") == 64).select("stream_id", "frame_idx", F.lit(8).alias("w"), F.lit(8).alias("h"), F.transform("p", lambda p: p["value"]).alias("data"))


def frame_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram, edge and pixel distances and the score of consecutive frames (V1-V8)."""
    return V.frame_diffs(rasters(spark, sf_dir))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed cuts of the rasters."""
    return V.detect_cuts(rasters(spark, sf_dir))


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("stream_id"))
    e = e.withColumn("frame_idx", F.call_function("div", F.col("event_id"), F.lit(3).cast("long")))
    totals = e.groupBy("stream_id").agg((F.max("frame_idx") + 1).alias("total"))
    marked = e.filter("event_type = 'signup'").select("stream_id", F.col("frame_idx").alias("cut_idx"), (F.col("event_id") % 100 / 100).alias("score"), (F.col("event_id") % 4 == 0).alias("dissolve"))
    return marked, totals


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shot list between cuts (V11, V13, V16); the flagship query."""
    return V.build_shots(*_marks(spark, sf_dir))


def shot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and median shot seconds."""
    return V.shot_statistics(shots(spark, sf_dir), FPS)


def shot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event frame's shot by an as-of lookup."""
    e = read_table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("stream_id"), F.call_function("div", F.col("event_id"), F.lit(3).cast("long")).alias("frame_idx"))
    return V.shot_of(e, shots(spark, sf_dir)).groupBy("stream_id", "shot").agg(F.count("*").alias("events"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real times where complete, else index / fps; the analysis raster's size."""
    p = pixels(spark, sf_dir).select("stream_id", "frame_idx").distinct()
    pts = p.filter("stream_id = 0 OR frame_idx % 5 > 0").select("stream_id", "frame_idx", (F.col("frame_idx") * 0.05).alias("pts_time"))
    w, h = V.analysis_size(F.col("frame_idx") + 300, F.col("frame_idx") * 2 + 100)
    return V.frame_times(p, pts, FPS).select("stream_id", "frame_idx", "seconds", w.alias("w"), h.alias("h"))


def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grain per shot of ten frames and its strength."""
    g = V.grain_sigma(rasters(spark, sf_dir)).withColumn("shot", F.call_function("div", F.col("frame_idx"), F.lit(10).cast("long")))
    g = V.shot_grain(g, ["stream_id", "shot"])
    return g.withColumns({"strength": V.strength(F.col("sigma"), F.col("confidence")), "forced": V.strength(F.col("sigma"), F.lit(1.0))})


def grain_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three successive rasters as the planes of a frame."""
    g = V.grain_sigma(rasters(spark, sf_dir)).withColumn("frame_idx", F.call_function("div", F.col("frame_idx"), F.lit(3).cast("long")))
    return V.plane_grain(g)


def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to measure per shot."""
    return V.sample_frames(shots(spark, sf_dir))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters resampled to 12 x 5; a partial last raster is no frame."""
    p = pixels(spark, sf_dir)
    whole = p.groupBy("stream_id", "frame_idx").count().filter("count = 64").select("stream_id", "frame_idx")
    return V.resample(p.join(whole, ["stream_id", "frame_idx"]), 8, 8, 12, 5)


def warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear warp by a synthetic flow."""
    p = pixels(spark, sf_dir)
    flow = p.select("stream_id", "frame_idx", "x", "y", ((F.col("value") % 9 - 4) / 4).alias("dx"), ((F.col("frame_idx") % 5 - 2) / 2).alias("dy"))
    return V.warp(p, flow, 8, 8)


_PIXELS = """px AS (SELECT event_id // 64 % 2 AS stream_id, event_id // 64 // 2 AS frame_idx, (event_id % 64 % 8)::INT AS x, (event_id % 64 // 8)::INT AS y,
  (CAST(round(value * 100) AS BIGINT) % 90 + event_id // 64 // 20 % 3 * 70)::INT AS value FROM events),
fr AS (SELECT stream_id, frame_idx FROM px GROUP BY ALL HAVING count(*) = 64),
f AS (SELECT px.* FROM px JOIN fr USING (stream_id, frame_idx))"""
_SHOTS = """ev AS (SELECT event_id, event_type, user_id % 7 AS stream_id, event_id // 3 AS frame_idx FROM events),
cu AS (SELECT stream_id, frame_idx, min({'score': event_id % 100 / 100, 'dissolve': event_id % 4 = 0}) AS c FROM ev WHERE event_type = 'signup' AND frame_idx > 0 GROUP BY ALL),
mk AS (SELECT stream_id, frame_idx AS start_frame, CASE WHEN c.dissolve THEN 'dissolve' ELSE 'cut' END AS kind, c.score AS cut_score FROM cu UNION ALL SELECT DISTINCT stream_id, 0, 'start', NULL FROM ev),
sh AS (SELECT stream_id, row_number() OVER w - 1 AS shot, start_frame, coalesce(lead(start_frame) OVER w, greatest((SELECT max(frame_idx) + 1 FROM ev WHERE ev.stream_id = mk.stream_id), start_frame + 1)) AS end_frame, kind, cut_score
  FROM mk WINDOW w AS (PARTITION BY stream_id ORDER BY start_frame))"""

ORACLES = {}
ORACLES["frame_diffs"] = f"""WITH {_PIXELS},
g AS (SELECT a.*, CASE WHEN a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 AND (abs(r.value - l.value) + abs(d.value - u.value)) % 256 >= 24 THEN 1 ELSE 0 END AS e FROM f a
  LEFT JOIN f l ON l.stream_id = a.stream_id AND l.frame_idx = a.frame_idx AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN f r ON r.stream_id = a.stream_id AND r.frame_idx = a.frame_idx AND r.x = a.x + 1 AND r.y = a.y
  LEFT JOIN f u ON u.stream_id = a.stream_id AND u.frame_idx = a.frame_idx AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN f d ON d.stream_id = a.stream_id AND d.frame_idx = a.frame_idx AND d.x = a.x AND d.y = a.y + 1),
h AS (SELECT stream_id, frame_idx, b.b, count(*) FILTER (WHERE value * 32 // 256 = b.b) / 64 AS n FROM f, (SELECT unnest(range(32)) AS b) b GROUP BY ALL),
hd AS (SELECT a.stream_id, a.frame_idx, least(sum(abs(a.n - p.n)) / 2, 1) AS d FROM h a JOIN h p ON p.stream_id = a.stream_id AND p.frame_idx = a.frame_idx - 1 AND p.b = a.b GROUP BY ALL),
pd AS (SELECT a.stream_id, a.frame_idx, avg(abs(a.value - p.value)) AS mad FROM g a JOIN g p ON p.stream_id = a.stream_id AND p.frame_idx = a.frame_idx - 1 AND p.x = a.x AND p.y = a.y GROUP BY ALL),
ed AS (SELECT a.stream_id, a.frame_idx, avg((a.e <> p.e)::INT) AS edge FROM g a JOIN g p ON p.stream_id = a.stream_id AND p.frame_idx = 0 AND p.x = a.x AND p.y = a.y GROUP BY ALL),
lu AS (SELECT stream_id, frame_idx, avg(value) AS luma FROM f GROUP BY ALL),
al AS (SELECT stream_id, frame_idx, luma, coalesce(d, 0) AS histogram, CASE WHEN frame_idx = 0 THEN 0 ELSE edge END AS edge, coalesce(mad, 0) AS mad FROM lu LEFT JOIN hd USING (stream_id, frame_idx) LEFT JOIN pd USING (stream_id, frame_idx) LEFT JOIN ed USING (stream_id, frame_idx))
SELECT *, least(greatest(histogram * 0.5::DOUBLE + least(edge, 0.5) * 0.4::DOUBLE + mad / 255 * 0.6::DOUBLE, 0), 1) AS score FROM al"""
ORACLES["shots"] = f"WITH {_SHOTS} SELECT * FROM sh"
ORACLES["shot_statistics"] = f"WITH {_SHOTS} SELECT stream_id, count(*) - 1 AS cuts, list((end_frame - start_frame) / 24 ORDER BY end_frame - start_frame)[count(*)::INT // 2 + 1] AS median_seconds FROM sh GROUP BY stream_id"
ORACLES["shot_lookup"] = f"WITH {_SHOTS} SELECT ev.stream_id, shot, count(*) AS events, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM ev JOIN sh ON sh.stream_id = ev.stream_id AND frame_idx >= start_frame AND frame_idx < end_frame GROUP BY ALL"
ORACLES["frame_times"] = """WITH p AS (SELECT DISTINCT event_id // 64 % 2 AS stream_id, event_id // 64 // 2 AS frame_idx FROM events)
SELECT stream_id, frame_idx, CASE WHEN stream_id = 0 THEN frame_idx * 0.05::DOUBLE ELSE frame_idx / 24 END AS seconds, 160::BIGINT AS w,
  (greatest(round(160 * (frame_idx * 2 + 100) / (frame_idx + 300)), 2)::BIGINT + greatest(round(160 * (frame_idx * 2 + 100) / (frame_idx + 300)), 2)::BIGINT % 2) AS h FROM p"""
ORACLES["grain"] = f"""WITH {_PIXELS},
l AS (SELECT a.stream_id, a.frame_idx, (a.value * 4 - l.value - r.value - u.value - d.value) / 255 AS v FROM f a
  JOIN f l ON l.stream_id = a.stream_id AND l.frame_idx = a.frame_idx AND l.x = a.x - 1 AND l.y = a.y JOIN f r ON r.stream_id = a.stream_id AND r.frame_idx = a.frame_idx AND r.x = a.x + 1 AND r.y = a.y
  JOIN f u ON u.stream_id = a.stream_id AND u.frame_idx = a.frame_idx AND u.x = a.x AND u.y = a.y - 1 JOIN f d ON d.stream_id = a.stream_id AND d.frame_idx = a.frame_idx AND d.x = a.x AND d.y = a.y + 1),
m AS (SELECT stream_id, frame_idx, median(v) AS m FROM l GROUP BY ALL),
g AS (SELECT stream_id, frame_idx, median(abs(v - m)) * 1.4826::DOUBLE / sqrt(20) AS sigma, count(*) AS samples, least(count(*) / 4096, 1) AS confidence FROM l JOIN m USING (stream_id, frame_idx) GROUP BY ALL),
s AS (SELECT stream_id, frame_idx // 10 AS shot, median(sigma) AS sigma, sum(samples)::BIGINT AS samples, min(confidence) AS confidence FROM g GROUP BY ALL)
SELECT *, CASE WHEN sigma > 0.0008 AND confidence > 0.2 THEN least(greatest(sigma * 255 * 2.6::DOUBLE, 1), 30) ELSE 0 END AS strength, CASE WHEN sigma > 0.0008 THEN least(greatest(sigma * 255 * 2.6::DOUBLE, 1), 30) ELSE 0 END AS forced FROM s"""
ORACLES["grain_planes"] = ORACLES["grain"][: ORACLES["grain"].index(",\ns AS")] + """ SELECT stream_id, frame_idx // 3 AS frame_idx, avg(sigma) AS sigma, sum(samples)::BIGINT AS samples, min(confidence) AS confidence FROM g GROUP BY ALL"""
ORACLES["sample_plan"] = f"""WITH {_SHOTS}, k AS (SELECT *, end_frame - start_frame AS n, greatest(least(3, end_frame - start_frame), 1) AS k FROM sh)
SELECT DISTINCT stream_id, shot, least(start_frame + 1 + floor((s + 0.5) / k * greatest(n - 2, 0))::BIGINT, end_frame - 1) AS frame_idx FROM (SELECT *, unnest(range(k)) AS s FROM k)"""
_SINC = "CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"


def _taps(src: int, dst: int) -> str:
    scale = f"greatest({src} / {dst}, 1)"
    kernel = f"({_SINC.format(x='z')}) * ({_SINC.format(x='(z / 3)')})"
    return f"""(SELECT i, greatest(least(j, {src - 1}), 0) AS src, sum(v / t) AS weight FROM (SELECT i, j, v, sum(v) OVER (PARTITION BY i) AS t FROM (SELECT i, j, CASE WHEN abs(z) < 3 THEN {kernel} ELSE 0 END AS v
  FROM (SELECT i, j, (j - ((i + 0.5::DOUBLE) * {src} / {dst} - 0.5)) / {scale} AS z FROM range({dst}) a(i), range(-20, {src + 20}) b(j)))) GROUP BY ALL)"""


ORACLES["resampled"] = f"""WITH {_PIXELS}, a AS {_taps(8, 12)}, b AS {_taps(8, 5)},
r AS (SELECT stream_id, frame_idx, y, a.i AS x, sum(value * weight) AS value FROM f JOIN a ON a.src = f.x GROUP BY ALL)
SELECT stream_id, frame_idx, x, b.i AS y, least(greatest(round(sum(value * weight)), 0), 255)::INT AS value FROM r JOIN b ON b.src = r.y GROUP BY ALL"""
ORACLES["warped"] = f"""WITH {_PIXELS},
t AS (SELECT *, least(greatest(x + (value % 9 - 4) / 4, 0), 7)::DOUBLE AS sx, least(greatest(y + (frame_idx % 5 - 2) / 2, 0), 7)::DOUBLE AS sy FROM px),
c AS (SELECT stream_id, frame_idx, x, y, least(floor(sx)::INT + i, 7) AS qx, least(floor(sy)::INT + j, 7) AS qy,
  (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS k FROM t, range(2) a(i), range(2) b(j))
SELECT c.stream_id, c.frame_idx, c.x, c.y, sum(k * q.value) AS value FROM c JOIN px q ON q.stream_id = c.stream_id AND q.frame_idx = c.frame_idx AND q.x = qx AND q.y = qy GROUP BY ALL"""

QUERIES = {
    "shots": shots, "shot_statistics": shot_statistics, "shot_lookup": shot_lookup, "frame_diffs": frame_diffs, "frame_cuts": cuts, "frame_times": frame_times,
    "grain": grain, "grain_planes": grain_planes, "sample_plan": sample_plan, "resampled": resampled, "warped": warped,
}
