"""Queries of segment plans over the shot list of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import frame_queries as Q
from framewright.plans import segments as G

TARGET = 40


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shots = Q.shots(spark, sf_dir)
    return shots, G.segments(shots)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold and synthesise segments of every stream."""
    return _plan(spark, sf_dir)[1]


def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted against expected frames and the model's work."""
    shots, segs = _plan(spark, sf_dir)
    return G.accounting(segs, shots)


def wide_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at three times with windows of five."""
    shots = Q.shots(spark, sf_dir)
    segs = G.segments(shots, multiplier=3, window=5)
    return G.accounting(segs, shots, 3).join(segs.groupBy("stream_id").agg(F.count("*").alias("n_segments")), "stream_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most TARGET input frames within a shot, with their paths."""
    t = G.chunks(_plan(spark, sf_dir)[1], TARGET)
    return t.withColumn("path", G.chunk_path("/work", F.col("chunk")))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output slots by kind and shot."""
    t = G.slots(_plan(spark, sf_dir)[1])
    return t.groupBy("stream_id", "kind", "step").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("source_frame").alias("last_source"))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left to do where every third is committed, one under another path."""
    planned = chunks(spark, sf_dir).select("stream_id", "chunk", "path", "outputs")
    done = planned.filter("chunk % 3 = 0").select("stream_id", "chunk", F.when(F.col("chunk") == 3, "/old/chunk").otherwise(F.col("path")).alias("artifact"))
    return G.to_do(planned, done)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written against planned frames by chunk."""
    t = chunks(spark, sf_dir)
    planned = t.select("stream_id", "chunk", "outputs")
    held = t.select("stream_id", "chunk", F.explode(F.sequence("first_segment", "last_segment")).alias("seq"))
    slot = F.explode(F.sequence(F.col("first") * 2 + F.col("drop_first").cast("long"), F.col("last") * 2))
    written = _plan(spark, sf_dir)[1].select("stream_id", "seq", slot.alias("slot")).join(held, ["stream_id", "seq"])
    return G.verified(planned, written.groupBy("stream_id", "chunk").agg(F.countDistinct("slot").alias("written")))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress after each segment."""
    shots, segs = _plan(spark, sf_dir)
    return G.progress(segs, shots)


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short and gappy source padded by its last frame, extras counted, arrivals in order."""
    e = Q._marks(spark, sf_dir)[1]
    planned = e.select("stream_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("frame_idx"))
    got = planned.filter("frame_idx % 11 < 7 AND (frame_idx = 0 OR frame_idx < total - 20)").select("stream_id", "frame_idx", (F.col("frame_idx") * 2).alias("value"))
    got = got.unionByName(e.select("stream_id", (F.col("total") + F.col("stream_id")).alias("frame_idx"), F.lit(1).cast("long").alias("value")))
    planned = planned.drop("total")
    filled, extra = G.delivered(planned, got)
    return filled.hint("merge").join(extra.hint("merge"), "stream_id")


def concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenation lists of each stream's chunks (K6); files left over have numbers below 0, which no plan has."""
    planned = chunks(spark, sf_dir)
    files = planned.select("stream_id", "chunk", F.concat(F.lit("C:\\it's\\"), "path").alias("path"))
    files = files.unionByName(files.select("stream_id", (-1 - F.col("chunk")).alias("chunk"), F.lit("left over").alias("path")))
    return G.concat_list(G.require_chunks(planned, files))


def _segments_sql(m: int = 2, window: int = 2) -> str:
    return f"""{Q._SHOTS},
dg AS (SELECT DISTINCT stream_id, unnest(range(greatest(start_frame - 12, 0), start_frame + 12)) AS pair FROM sh WHERE kind = 'dissolve'),
ls AS (SELECT stream_id, max(end_frame) AS n FROM sh GROUP BY stream_id),
pr AS (SELECT sh.stream_id, shot, end_frame, unnest(range(start_frame, end_frame)) AS pair FROM sh),
pa AS (SELECT pr.stream_id, pr.pair, shot, pr.pair < end_frame - 1 AND dg.pair IS NULL AS ok, pr.pair = end_frame - 1 AS cut FROM pr JOIN ls USING (stream_id) LEFT JOIN dg ON dg.stream_id = pr.stream_id AND dg.pair = pr.pair WHERE pr.pair < n - 1),
ru AS (SELECT *, pair - row_number() OVER (PARTITION BY stream_id, shot, ok, cut ORDER BY pair) AS isle FROM pa),
rp AS (SELECT *, CASE WHEN ok THEN (row_number() OVER (PARTITION BY stream_id, shot, ok, cut, isle ORDER BY pair) - 1) // {max(window - 2, 1)} ELSE 0 END AS piece FROM ru),
sg AS (SELECT stream_id, CASE WHEN ok THEN 'synthesise' ELSE 'hold' END AS kind, min(pair) AS "first", max(pair) + 1 AS "last", shot, {m} * (max(pair) + 1 - min(pair)) + 1 AS outputs FROM rp GROUP BY stream_id, shot, ok, cut, isle, piece),
se AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY "first") - 1 AS seq, * EXCLUDE (stream_id) FROM sg),
sx AS (SELECT *, seq > 0 AS drop_first FROM se)"""


_ACCOUNT = """SELECT stream_id, sum(outputs - drop_first::INT)::BIGINT AS emitted, {m} * (any_value(n) - 1) + 1 AS expected, (coalesce(sum("last" - "first") FILTER (WHERE kind = 'synthesise'), 0) * ({m} - 1))::BIGINT AS model_frames,
  coalesce(sum("last" - "first") FILTER (WHERE kind = 'synthesise'), 0)::BIGINT AS model_calls, count(*) FILTER (WHERE kind <> 'synthesise') AS protected, sum(outputs - drop_first::INT) = {m} * (any_value(n) - 1) + 1 AS exact
  FROM sx JOIN ls USING (stream_id) GROUP BY stream_id"""
_CHUNKS = f"""WITH RECURSIVE {_segments_sql()},
sm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, shot ORDER BY seq) AS k FROM sx),
pk(stream_id, shot, k, begins) AS (SELECT stream_id, shot, k, "first" FROM sm WHERE k = 1
  UNION ALL SELECT sm.stream_id, sm.shot, sm.k, CASE WHEN sm."last" - pk.begins > {TARGET} THEN sm."first" ELSE pk.begins END FROM pk JOIN sm ON sm.stream_id = pk.stream_id AND sm.shot = pk.shot AND sm.k = pk.k + 1),
ch AS (SELECT stream_id, shot, min(seq) AS first_segment, max(seq) AS last_segment, min("first") AS first_input, max("last") AS last_input, sum(outputs - drop_first::INT)::BIGINT AS outputs, count(*) FILTER (WHERE kind <> 'synthesise') AS protected
  FROM pk JOIN sm USING (stream_id, shot, k) GROUP BY stream_id, shot, begins),
cx AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY first_segment) - 1 AS chunk, * EXCLUDE (stream_id), printf('/work/chunk-%05d.mkv', row_number() OVER (PARTITION BY stream_id ORDER BY first_segment) - 1) AS path FROM ch)"""

ORACLES = {
    "segments": f"WITH {_segments_sql()} SELECT * FROM sx",
    "segment_accounting": f"WITH {_segments_sql()} {_ACCOUNT.format(m=2)}",
    "segment_wide_accounting": f"WITH {_segments_sql(3, 5)} SELECT a.*, (SELECT count(*) FROM sx WHERE sx.stream_id = a.stream_id) AS n_segments FROM ({_ACCOUNT.format(m=3)}) a",
    "chunks": f"{_CHUNKS} SELECT * FROM cx",
    "slots": f"""WITH {_segments_sql()}, sl AS (SELECT stream_id, kind, unnest(range("first" * 2 + drop_first::INT, "last" * 2 + 1)) AS slot FROM sx)
SELECT stream_id, CASE WHEN slot % 2 = 0 THEN 'source' WHEN kind = 'synthesise' THEN 'model' ELSE 'repeat' END AS kind, slot % 2 / 2 AS step, count(*) AS n, min(slot) AS first_slot, max(slot // 2) AS last_source FROM sl GROUP BY ALL""",
    "resume": f"{_CHUNKS} SELECT stream_id, chunk, path, outputs FROM cx WHERE chunk % 3 <> 0 OR chunk = 3",
    "verified_chunks": f"""{_CHUNKS}, w AS (SELECT cx.stream_id, chunk, sum("last" * 2 + 1 - "first" * 2 - drop_first::INT)::BIGINT AS written FROM cx JOIN sx ON sx.stream_id = cx.stream_id AND seq BETWEEN first_segment AND last_segment GROUP BY ALL)
SELECT stream_id, chunk, outputs, written, outputs = written AS ok FROM cx JOIN w USING (stream_id, chunk)""",
    "segment_progress": f"""WITH {_segments_sql()} SELECT stream_id, seq, least(("last" + 1) / n, 1) AS fraction, sum(outputs - drop_first::INT) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS done FROM sx JOIN ls USING (stream_id)""",
    "padding": """WITH t AS (SELECT user_id % 7 AS stream_id, max(event_id // 3) + 1 AS total FROM events GROUP BY 1),
p AS (SELECT stream_id, total, unnest(range(total)) AS frame_idx FROM t), g AS (SELECT *, frame_idx % 11 < 7 AND (frame_idx = 0 OR frame_idx < total - 20) AS here FROM p)
SELECT stream_id, frame_idx, max(CASE WHEN here THEN frame_idx * 2 END) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS value, NOT here AS padded, 1::BIGINT AS extra FROM g""",
    "concat_lists": _CHUNKS + r""" SELECT stream_id, string_agg('file ''C:/it''\''''s/' || path || '''', chr(10) ORDER BY chunk) AS listing FROM cx GROUP BY stream_id""",
}
QUERIES = {
    "segments": segments, "segment_accounting": accounting, "segment_wide_accounting": wide_accounting, "chunks": chunks, "slots": slots, "resume": resume,
    "verified_chunks": verified, "segment_progress": progress, "padding": padding, "concat_lists": concat_lists,
}
