"""Queries of audio analytics; the signal is the event values, dealt to four streams of two channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import audio as A
from framewright.session import read_table

CHUNK = 4


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("c"))
    stream, ch = F.col("event_id") % 4, F.call_function("div", F.col("event_id"), F.lit(4).cast("long")) % 2
    loud = F.when(F.call_function("div", F.col("event_id"), F.lit(800).cast("long")) % 3 == 0, 0.9).otherwise(0.004)
    return e.select(
        stream.alias("stream_id"), ch.cast("int").alias("ch"), F.call_function("div", F.col("event_id"), F.lit(8).cast("long")).alias("frame_idx"),
        ((F.col("c") % 2001 - 1000) / 1000 * loud).alias("sample"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squares on the chunk grid, broken samples, peaks."""
    c = A.chunk_squares(samples(spark, sf_dir), CHUNK)
    return c.select("stream_id", "chunk_idx", "ms", "broken", A.dbfs(F.col("peak")).alias("peak_dbfs"))


def programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-weighted blocks, gated loudness, loudness range over 3 s."""
    c = A.chunk_squares(A.filtered(samples(spark, sf_dir), *A.k_weighting(RATE)), CHUNK, value="filtered")
    b = A.blocks(c)
    return A.gated_loudness(b).join(A.loudness_range(c), "stream_id").select("stream_id", F.col("n").alias("blocks_above"), F.col("gated").alias("programme"), "lra")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunk_squares(samples(spark, sf_dir), CHUNK)
    return c.select("stream_id", "chunk_idx", F.greatest(F.coalesce(10 * F.log10(F.when(F.col("ms") > 0, F.col("ms"))), F.lit(-120.0)), F.lit(-120.0)).alias("level_db"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, raw activity, hangover mask, smoothed mask."""
    t = A.smooth_mask(A.hangover(A.speech_threshold(levels(spark, sf_dir))), 5)
    return t.select("stream_id", "chunk_idx", "threshold_db", "raw", "mask", "smooth")


def remaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech summary, dialogue loudness and the remaster decision."""
    c = A.chunk_squares(samples(spark, sf_dir), CHUNK)
    b = A.blocks(c)
    m = A.hangover(A.speech_threshold(levels(spark, sf_dir)))
    peak = c.groupBy("stream_id").agg(A.plausible_peak(A.dbfs(F.max("peak"))).alias("peak"))
    t = A.track_summary(m).join(A.gated_loudness(b).select("stream_id", F.col("gated").alias("programme")), "stream_id", "left")
    t = A.decide(t.join(A.dialogue_loudness(b, m), "stream_id", "left").join(peak, "stream_id", "left"))
    gain, limit, chain = A.final_gain(F.col("programme"), F.col("peak"))
    return t.select("stream_id", "speech_ratio", "median_snr", "confidence", "notes", "programme", "dialogue", "apply", "ldr", "gain_db", "duck_db", "ldr_after", "reason", gain.alias("gain"), limit.alias("limited"), chain.alias("chain"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and duck envelopes over the mask."""
    m = A.hangover(A.speech_threshold(levels(spark, sf_dir)))
    fixed = m.select("stream_id").distinct().select("stream_id", F.lit(True).alias("apply"), (F.col("stream_id") + 1.5).alias("gain_db"), F.lit(-3.0).alias("duck_db"))
    return A.gain_curve(m, fixed).select("stream_id", "chunk_idx", F.round("gain_db", 9).alias("gain_db"), F.round("duck_db", 9).alias("duck_db"), F.round(A.to_linear(F.col("gain_db")), 9).alias("gain"))


RATE = 48000.0


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-weighted samples of the first frames' recurrences, whole streams (A1-A3)."""
    out = A.filtered(samples(spark, sf_dir), *A.k_weighting(RATE))
    return out.select("stream_id", "ch", "frame_idx", F.round("filtered", 9).alias("filtered"))


def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono downmix, chunk cursor, frames past the declared count."""
    s = samples(spark, sf_dir)
    declared = s.groupBy("stream_id").agg((F.max("frame_idx") + 1 - F.col("stream_id") * 7).alias("declared"))
    kept, dropped = A.within(s.join(F.broadcast(declared), "stream_id"), F.col("declared"))
    mono = kept.groupBy("stream_id", "frame_idx").agg(F.avg("sample").alias("mono"), F.max(F.when(F.col("ch") == 1, F.col("sample"))).alias("right"))
    return mono.join(dropped, "stream_id").select("stream_id", "frame_idx", F.call_function("div", F.col("frame_idx"), F.lit(CHUNK).cast("long")).alias("chunk_idx"), "mono", "right", F.col("dropped").cast("long").alias("dropped"))


def speech_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech-band levels of the analysis signal, and where they disagree with the full band."""
    mono = A.analysis_signal(samples(spark, sf_dir))
    t = A.speech_levels(mono, RATE, CHUNK).withColumnRenamed("level_db", "speech_db")
    full = mono.groupBy("stream_id", F.call_function("div", F.col("frame_idx"), F.lit(CHUNK).cast("long")).alias("chunk_idx")).agg(A.lufs(F.avg(F.col("sample") * F.col("sample"))).alias("full"))
    t = t.join(full, ["stream_id", "chunk_idx"])
    return t.select("stream_id", "chunk_idx", F.round("speech_db", 6).alias("speech_db"), A.cross_check(F.round("speech_db", 6), F.round("full", 6), 3.0).isNotNull().alias("apart"))


LAYOUTS = (None, "", "mono", "stereo", "2.1", "3.0", "3.1", "quad", "4.1", "5.0(side)", "5.1", "5.1(side)", "hexagonal", "6.1", "6.1(back)", "7.0", "7.1", "7.1(wide)", "octagonal", "LFE only")


def channel_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy and roles of every channel count and layout name."""
    names = F.array(*[F.lit(x).cast("string") for x in LAYOUTS])
    t = spark.range(11).select(F.col("id").cast("int").alias("channels"), F.explode(names).alias("layout"))
    plan = A.channel_plan(F.col("channels"), F.col("layout"))
    return t.select("channels", "layout", plan["strategy"].alias("strategy"), F.array_join(plan["roles"], ",").alias("roles"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and band ducking by role in a stereo, a 3.0 and a quad stream, with default 0 past the curve's end."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("c"))
    n, k = F.col("event_id") % 3 + 2, F.call_function("div", F.col("event_id"), F.lit(3).cast("long"))
    s = e.select((n - 2).alias("stream_id"), (k % n).cast("int").alias("ch"), F.call_function("div", k, n).alias("frame_idx"), ((F.col("c") % 2001 - 1000) / 1000).alias("sample"))
    plans = spark.range(3).select(F.col("id").alias("stream_id"), A.channel_plan((F.col("id") + 2).cast("int"), F.element_at(F.array(F.lit("stereo"), F.lit("3.0"), F.lit("quad")), (F.col("id") + 1).cast("int"))).alias("plan"))
    c = s.select("stream_id", F.call_function("div", F.col("frame_idx"), F.lit(CHUNK).cast("long")).alias("chunk_idx")).distinct().filter("chunk_idx % 50 < 40")
    c = c.select("stream_id", "chunk_idx", (F.col("chunk_idx") % 7 - 3.0).alias("gain_db"), (F.col("chunk_idx") % 5 * 1.0).alias("duck_db"))
    out = A.apply_gain(s, c, CHUNK, plans, RATE)
    return out.select("stream_id", "frame_idx", "ch", "role", F.round("out", 9).alias("out"))


_SAMPLES = """s AS (SELECT event_id % 4 AS stream_id, (event_id // 4 % 2)::INT AS ch, event_id // 8 AS frame_idx,
  (CAST(round(value * 100) AS BIGINT) % 2001 - 1000) / 1000::DOUBLE * CASE WHEN event_id // 800 % 3 = 0 THEN 0.9::DOUBLE ELSE 0.004::DOUBLE END AS sample FROM events)"""
_CHUNKS = _SAMPLES + """,
c AS (SELECT stream_id, frame_idx // 4 AS chunk_idx, sum(sample * sample) / 4 AS ms, max(abs(sample)) AS peak FROM s GROUP BY ALL HAVING count(*) = 8)"""
_BLOCKS = """b AS (SELECT stream_id, (k - 40) // 10 AS block_idx, ms FROM (
  SELECT stream_id, row_number() OVER w AS k, avg(ms) OVER (PARTITION BY stream_id ORDER BY chunk_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS ms
  FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY chunk_idx)) WHERE k >= 40 AND (k - 40) % 10 = 0)"""
_L = "(-0.691::DOUBLE + 10 * log10({0}))"
_GATED = """(SELECT stream_id, count(*) AS n, {L} AS gated FROM (SELECT *, avg(ms) OVER (PARTITION BY stream_id) AS m FROM {src} WHERE ms > 0 AND {l} > -70)
  GROUP BY stream_id)""".replace("{l}", _L.format("ms")).replace("{L}", _L.format("coalesce(avg(ms) FILTER (WHERE " + _L.format("ms") + " > " + _L.format("m") + " - 10), avg(ms))"))
_LEVELS = """l AS (SELECT stream_id, chunk_idx, CASE WHEN ms > 0 THEN greatest(10 * log10(ms), -120) ELSE -120 END::DOUBLE AS level_db FROM c),
p AS (SELECT stream_id, v[1 + round((len(v) - 1) * 0.2)::INT] AS floor_db, v[1 + round((len(v) - 1) * 0.95)::INT] AS p95_db FROM (SELECT stream_id, list(level_db ORDER BY level_db) AS v FROM l GROUP BY stream_id)),
x AS (SELECT l.*, floor_db, greatest(floor_db + 9, p95_db - 28) AS threshold_db, level_db > greatest(floor_db + 9, p95_db - 28) AS raw FROM l JOIN p USING (stream_id)),
g AS (SELECT *, sum(CASE WHEN raw THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY chunk_idx) AS run FROM x),
o AS (SELECT *, raw AND sum(raw::INT) OVER (PARTITION BY stream_id, run) >= 3 AS opens FROM g),
h AS (SELECT *, max(CASE WHEN opens THEN run END) OVER (PARTITION BY stream_id ORDER BY chunk_idx) AS last FROM o),
m AS (SELECT *, opens OR (NOT raw AND last IS NOT NULL AND run - last <= 20) AS mask FROM h)"""

ORACLES = {}
ORACLES["audio_chunks"] = f"WITH {_CHUNKS} SELECT stream_id, chunk_idx, ms, 0::BIGINT AS broken, CASE WHEN peak > 0 THEN 20 * log10(peak) END AS peak_dbfs FROM c"
ORACLES["audio_speech"] = f"WITH {_CHUNKS}, {_LEVELS} SELECT stream_id, chunk_idx, threshold_db, raw, mask, avg(mask::INT) OVER (PARTITION BY stream_id ORDER BY chunk_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM m"
ORACLES["audio_remaster"] = f"""WITH {_CHUNKS}, {_BLOCKS}, {_LEVELS},
q AS (SELECT b.* FROM b JOIN (SELECT b.stream_id, block_idx FROM b JOIN m ON m.stream_id = b.stream_id AND m.chunk_idx >= block_idx * 10 AND m.chunk_idx < block_idx * 10 + 40
  GROUP BY ALL HAVING sum(mask::INT) * 10 >= count(*) * 3) USING (stream_id, block_idx)),
q3 AS (SELECT * FROM q WHERE stream_id IN (SELECT stream_id FROM q GROUP BY stream_id HAVING count(*) >= 3)),
d AS (SELECT stream_id, gated AS dialogue FROM {_GATED.replace("{src}", "q3")}),
a AS (SELECT stream_id, gated AS programme FROM {_GATED.replace("{src}", "b")}),
k AS (SELECT stream_id, CASE WHEN max(peak) > 0 AND 20 * log10(max(peak)) > -120 AND 20 * log10(max(peak)) < 6 THEN 20 * log10(max(peak)) END AS peak FROM c GROUP BY stream_id),
t AS (SELECT stream_id, avg(mask::INT) AS speech_ratio, list(level_db - floor_db ORDER BY level_db - floor_db) FILTER (WHERE mask) AS v FROM m GROUP BY stream_id),
u AS (SELECT stream_id, speech_ratio, coalesce(v[len(v) // 2 + 1], 0) AS median_snr FROM t),
w AS (SELECT *, least(greatest((median_snr - 9) / 12, 0), 1) * CASE WHEN speech_ratio < 0.02 THEN 0 WHEN speech_ratio > 0.9 THEN 0.5 ELSE 1 END * CASE WHEN median_snr < 9 THEN 0.5 ELSE 1 END AS confidence FROM u),
z AS (SELECT *, programme - dialogue AS ldr, coalesce(dialogue IS NOT NULL AND speech_ratio >= 0.02 AND programme IS NOT NULL AND programme - dialogue > 5, false) AS apply
  FROM w LEFT JOIN a USING (stream_id) LEFT JOIN d USING (stream_id) LEFT JOIN k USING (stream_id)),
y AS (SELECT *, CASE WHEN apply THEN least(greatest(-24 - dialogue, -3), 6) * confidence ELSE 0 END::DOUBLE AS gain_db, CASE WHEN apply THEN least(ldr - 5, 4) * confidence ELSE 0 END::DOUBLE AS duck_db, -19 - programme AS gain FROM z)
SELECT stream_id, speech_ratio, median_snr, confidence::DOUBLE AS confidence,
  concat_ws('; ', CASE WHEN speech_ratio < 0.02 THEN 'no speech' WHEN speech_ratio > 0.9 THEN 'nearly all speech' END, CASE WHEN median_snr < 9 THEN 'speech close to the floor' END) AS notes,
  programme, dialogue, apply, ldr, gain_db, duck_db, CASE WHEN apply THEN ldr - gain_db - duck_db / 2 END AS ldr_after,
  CASE WHEN dialogue IS NULL THEN 'no measurable dialogue' WHEN speech_ratio < 0.02 THEN 'virtually no dialogue' WHEN programme IS NULL THEN 'programme not measurable' WHEN ldr <= 5 THEN 'already within target'
    WHEN confidence < 0.5 THEN 'reduced correction' ELSE 'above target' END AS reason,
  gain, coalesce(peak + gain > -1.5, false) AS limited,
  concat_ws(',', CASE WHEN abs(gain) >= 0.05 THEN printf('volume=%.2fdB', gain) END, CASE WHEN peak + gain > -1.5 THEN 'alimiter=limit=-1.5dB' END) AS chain
FROM y"""


def _follow(t: str, v: str) -> str:
    return f"{v} + least(greatest(({t} - {v}) * CASE WHEN {t} > {v} THEN 1 - exp(-10 / 120::DOUBLE) ELSE 1 - exp(-10 / 800::DOUBLE) END, -0.18::DOUBLE), 0.18::DOUBLE)"


ORACLES["audio_curve"] = f"""WITH RECURSIVE {_CHUNKS}, {_LEVELS},
n AS MATERIALIZED (SELECT stream_id, chunk_idx, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_idx) AS k, CASE WHEN mask THEN stream_id + 1.5 ELSE 0 END::DOUBLE AS g, CASE WHEN mask THEN -3.0 ELSE 0 END::DOUBLE AS d FROM m),
r(stream_id, k, g, d) AS (SELECT DISTINCT stream_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE FROM n
  UNION ALL SELECT n.stream_id, n.k, {_follow("n.g", "r.g")}, {_follow("n.d", "r.d")} FROM r JOIN n ON n.stream_id = r.stream_id AND n.k = r.k + 1)
SELECT stream_id, chunk_idx, round(r.g, 9) AS gain_db, round(r.d, 9) AS duck_db, round(pow(10::DOUBLE, r.g / 20), 9) AS gain FROM r JOIN n USING (stream_id, k)"""


def _cascade_sql(sections: list[A.Biquad], source: str) -> str:
    """Tables nn and rr: the sections run over (stream_id, ch) of ``source``, last output y."""
    lit = lambda x: f"({x!r}::DOUBLE)"
    count = len(sections)
    names = ", ".join(f"p{i}, q{i}" for i in range(1, count + 1))
    inner = "SELECT nn.stream_id, nn.ch, nn.k, nn.sample AS y0, rr.* EXCLUDE (stream_id, ch, k, y) FROM rr JOIN nn ON nn.stream_id = rr.stream_id AND nn.ch = rr.ch AND nn.k = rr.k + 1"
    for i, f in enumerate(sections, 1):
        inner = f"SELECT *, {lit(f.b0)} * y{i - 1} + p{i} AS y{i} FROM ({inner})"
    state = ", ".join(f"{lit(f.b1)} * y{i - 1} - {lit(f.a1)} * y{i} + q{i}, {lit(f.b2)} * y{i - 1} - {lit(f.a2)} * y{i}" for i, f in enumerate(sections, 1))
    return f"""nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, ch ORDER BY frame_idx) AS k FROM {source}),
rr(stream_id, ch, k, y, {names}) AS (SELECT DISTINCT stream_id, ch, 0::BIGINT, 0::DOUBLE, {", ".join(["0::DOUBLE"] * 2 * count)} FROM nn UNION ALL SELECT stream_id, ch, k, y{count}, {state} FROM ({inner}))"""


def _weighted_sql() -> str:
    (f, g) = A.k_weighting(RATE)
    lit = lambda x: f"({x!r}::DOUBLE)"
    y1 = f"({lit(f.b0)} * n.sample + p1)"
    y2 = f"({lit(g.b0)} * {y1} + q1)"
    return f"""WITH RECURSIVE {_SAMPLES},
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, ch ORDER BY frame_idx) AS k FROM s),
r(stream_id, ch, k, p1, p2, q1, q2, y) AS (SELECT DISTINCT stream_id, ch, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM n
  UNION ALL SELECT n.stream_id, n.ch, n.k, {lit(f.b1)} * n.sample - {lit(f.a1)} * {y1} + p2, {lit(f.b2)} * n.sample - {lit(f.a2)} * {y1},
    {lit(g.b1)} * {y1} - {lit(g.a1)} * {y2} + q2, {lit(g.b2)} * {y1} - {lit(g.a2)} * {y2}, {y2}
  FROM r JOIN n ON n.stream_id = r.stream_id AND n.ch = r.ch AND n.k = r.k + 1)
SELECT stream_id, ch, frame_idx, round(y, 9) AS filtered FROM r JOIN n USING (stream_id, ch, k)"""


ORACLES["audio_programme"] = f"""WITH RECURSIVE {_SAMPLES}, {_cascade_sql(list(A.k_weighting(RATE)), "s")},
c AS (SELECT stream_id, frame_idx // 4 AS chunk_idx, sum(y * y) / 4 AS ms FROM rr JOIN nn USING (stream_id, ch, k) GROUP BY ALL HAVING count(*) = 8), {_BLOCKS},
t AS (SELECT stream_id, {_L.format("ms")} AS v FROM (SELECT stream_id, row_number() OVER w AS k, avg(ms) OVER (PARTITION BY stream_id ORDER BY chunk_idx ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS ms FROM c
  WINDOW w AS (PARTITION BY stream_id ORDER BY chunk_idx)) WHERE k >= 300 AND (k - 300) % 10 = 0 AND ms > 0),
k AS (SELECT * FROM (SELECT *, 10 * log10(avg(pow(10::DOUBLE, v / 10)) OVER (PARTITION BY stream_id)) - 20 AS th FROM t WHERE v > -70) WHERE v > th),
r AS (SELECT stream_id, list(v ORDER BY v) AS v FROM k GROUP BY stream_id)
SELECT a.stream_id, a.n AS blocks_above, a.gated AS programme, CASE WHEN len(v) >= 2 THEN greatest(v[1 + round((len(v) - 1) * 0.95)::INT] - v[1 + round((len(v) - 1) * 0.1)::INT], 0) ELSE 0 END::DOUBLE AS lra
FROM {_GATED.replace("{src}", "b")} a LEFT JOIN r USING (stream_id)"""
ORACLES["audio_weighted"] = _weighted_sql()
def _levels_sql() -> str:
    sections = [A.high_pass(RATE, 300.0)] * 2 + [A.low_pass(RATE, 3400.0)] * 2
    lit = lambda x: f"({x!r}::DOUBLE)"
    inner, x = "SELECT n.stream_id, n.k, n.sample AS y0, r.* EXCLUDE (stream_id, k, y) FROM r JOIN n ON n.stream_id = r.stream_id AND n.k = r.k + 1", "y0"
    for i, f in enumerate(sections, 1):
        inner = f"SELECT *, {lit(f.b0)} * y{i - 1} + p{i} AS y{i} FROM ({inner})"
    state = ", ".join(f"{lit(f.b1)} * y{i - 1} - {lit(f.a1)} * y{i} + q{i}, {lit(f.b2)} * y{i - 1} - {lit(f.a2)} * y{i}" for i, f in enumerate(sections, 1))
    names = ", ".join(f"p{i}, q{i}" for i in range(1, 5))
    return f"""WITH RECURSIVE {_SAMPLES},
n AS MATERIALIZED (SELECT stream_id, frame_idx, avg(sample) AS sample, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS k FROM s GROUP BY stream_id, frame_idx),
r(stream_id, k, y, {names}) AS (SELECT DISTINCT stream_id, 0::BIGINT, 0::DOUBLE, {", ".join(["0::DOUBLE"] * 8)} FROM n UNION ALL SELECT stream_id, k, y4, {state} FROM ({inner})),
c AS (SELECT r.stream_id, frame_idx // 4 AS chunk_idx, avg(y * y) AS ms, avg(sample * sample) AS full_ms FROM r JOIN n USING (stream_id, k) GROUP BY ALL HAVING count(*) >= 1),
d AS (SELECT *, round(CASE WHEN ms > 0 THEN greatest(10 * log10(ms), -120) ELSE -120 END::DOUBLE, 6) AS speech_db, CASE WHEN full_ms > 0 THEN round({_L.format("full_ms")}, 6) END AS f FROM c)
SELECT stream_id, chunk_idx, speech_db, coalesce(abs(speech_db - f) > 3, false) AS apart FROM d"""


ORACLES["audio_speech_levels"] = _levels_sql()
ORACLES["audio_downmix"] = f"""WITH {_SAMPLES}, m AS (SELECT stream_id, max(frame_idx) + 1 - stream_id * 7 AS declared FROM s GROUP BY stream_id),
d AS (SELECT stream_id, declared, count(*) FILTER (WHERE frame_idx >= declared) AS dropped FROM s JOIN m USING (stream_id) GROUP BY ALL)
SELECT stream_id, frame_idx, frame_idx // 4 AS chunk_idx, avg(sample) AS mono, max(sample) FILTER (WHERE ch = 1) AS "right", dropped FROM s JOIN d USING (stream_id) WHERE frame_idx < declared GROUP BY ALL"""
ORACLES["audio_channel_plans"] = f"""WITH l AS (SELECT unnest([{", ".join("NULL" if x is None else repr(x) for x in LAYOUTS)}]) AS layout),
t AS (SELECT c::INT AS channels, layout, lower(coalesce(layout, '')) AS n FROM range(11) r(c), l)
SELECT channels, layout, CASE strategy WHEN 'front,front' THEN 'mid/side' WHEN 'dialogue' THEN 'mono' WHEN '' THEN 'untouched' ELSE 'centre' END AS strategy,
  CASE WHEN strategy = '' THEN array_to_string(list_transform(range(channels), lambda x: 'unknown'), ',') ELSE strategy END AS roles
FROM (SELECT *, CASE
  WHEN channels = 1 THEN 'dialogue' WHEN channels = 2 THEN 'front,front'
  WHEN channels = 3 AND n NOT LIKE '%2.1%' THEN 'front,front,dialogue'
  WHEN channels = 4 AND (n LIKE '%3.1%' OR n LIKE '%lfe%') THEN 'front,front,dialogue,lfe'
  WHEN channels = 5 THEN 'front,front,dialogue,surround,surround'
  WHEN channels = 6 AND (n LIKE '%5.1%' OR n LIKE '%lfe%' OR n = '') THEN 'front,front,dialogue,lfe,surround,surround'
  WHEN channels = 7 AND n LIKE '%6.1%' THEN 'front,front,dialogue,lfe,surround,surround,surround'
  WHEN channels = 8 AND (n LIKE '%7.1%' OR n = '') THEN 'front,front,dialogue,lfe,surround,surround,surround,surround' ELSE '' END AS strategy FROM t)"""
_BAND = [A.high_pass(RATE, 300.0)] * 2 + [A.low_pass(RATE, 6000.0)] * 2
ORACLES["audio_roles"] = f"""WITH RECURSIVE s AS (SELECT event_id % 3 AS stream_id, (event_id // 3 % (event_id % 3 + 2))::INT AS ch, event_id // 3 // (event_id % 3 + 2) AS frame_idx,
  (CAST(round(value * 100) AS BIGINT) % 2001 - 1000) / 1000::DOUBLE AS sample FROM events),
u AS (SELECT *, pow(10::DOUBLE, CASE WHEN frame_idx // 4 % 50 < 40 THEN frame_idx // 4 % 7 - 3 ELSE 0 END / 20) AS gain,
  pow(10::DOUBLE, CASE WHEN frame_idx // 4 % 50 < 40 THEN -(frame_idx // 4 % 5) ELSE 0 END / 20) AS duck FROM s),
sd AS (SELECT l.frame_idx, l.gain, l.duck, (l.sample + r.sample) / 2 * l.gain AS mid, (l.sample - r.sample) / 2 AS side FROM u l JOIN u r ON l.stream_id = 0 AND r.stream_id = 0 AND l.ch = 0 AND r.ch = 1 AND l.frame_idx = r.frame_idx),
sig AS (SELECT 1::BIGINT AS stream_id, ch, frame_idx, sample FROM u WHERE stream_id = 1 AND ch < 2 AND duck < 0.999 UNION ALL SELECT 0, -1, frame_idx, side FROM sd WHERE duck < 0.999),
{_cascade_sql(_BAND, "sig")},
bd AS (SELECT nn.stream_id, nn.ch, nn.frame_idx, rr.y FROM rr JOIN nn USING (stream_id, ch, k))
SELECT u.stream_id, u.frame_idx, u.ch, CASE WHEN u.stream_id = 2 THEN 'unknown' WHEN u.stream_id = 1 AND u.ch = 2 THEN 'dialogue' ELSE 'front' END AS role,
  round(CASE u.stream_id WHEN 2 THEN u.sample WHEN 1 THEN CASE u.ch WHEN 2 THEN u.sample * u.gain ELSE u.sample - coalesce(y * (1 - u.duck), 0) END
    ELSE coalesce(mid + (CASE u.ch WHEN 0 THEN 1 ELSE -1 END) * (side - coalesce(y * (1 - u.duck), 0)), u.sample) END, 9) AS out
FROM u LEFT JOIN sd ON u.stream_id = 0 AND sd.frame_idx = u.frame_idx LEFT JOIN bd ON bd.stream_id = u.stream_id AND bd.frame_idx = u.frame_idx AND bd.ch = CASE u.stream_id WHEN 0 THEN -1 ELSE u.ch END"""

QUERIES = {
    "audio_chunks": chunks, "audio_programme": programme, "audio_speech": speech, "audio_remaster": remaster,
    "audio_curve": curve, "audio_weighted": weighted, "audio_downmix": downmix, "audio_roles": roles, "audio_channel_plans": channel_plans, "audio_speech_levels": speech_levels,
}
