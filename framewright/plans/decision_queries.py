"""Queries of the decision tables over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans import decisions as D
from framewright.session import read_table
from framewright.sources.parsers import retryable


def _div(a, n):
    return F.call_function("div", a.cast("long"), F.lit(n).cast("long"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    k, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    lean = F.col("l_suppkey") % 5
    cols = {c: (q * (i + 1) + k) % 11 for i, c in enumerate(D.COUNTERS)}
    cols["progressive"] = F.when(lean < 2, q * 40).otherwise(q % 7)
    cols["tff"] = F.when(lean == 2, q * 30).otherwise(q % 5)
    cols["single_undetermined"] = F.when(k % 2 == 0, q * 20).otherwise(F.lit(0).cast("long"))
    cols["repeated_neither"] = F.when(lean == 4, q).otherwise(q * 60)
    return l.select(F.col("l_suppkey").alias("file"), *[v.cast("long").alias(n) for n, v in cols.items()])


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed counters to mode, confidence, notes and filter chain."""
    t = D.cadence(D.sum_counts(_counts(spark, sf_dir)).withColumn("declared_interlaced", F.col("file") % 3 == 0))
    chain, renumbers = D.cadence_plan(F.col("mode"))
    return t.select("file", "mode", F.round("confidence", 9).alias("confidence"), "notes", F.round("combing", 9).alias("combing"), chain.alias("chain"), renumbers.alias("renumbers"))


def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis windows by duration."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 400 / 4).alias("s"))
    return p.select("p_partkey", F.posexplode(D.sample_points(F.col("s"))).alias("k", "at")).select("p_partkey", "k", F.round("at", 9).alias("at"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target raster, model geometry, executor choice, filter chains, rates."""
    p = read_table(spark, sf_dir, "part")
    w, h = F.col("p_partkey") % 1900, (F.col("p_size") * 29).cast("long")
    tw, th = D.choose_target(w, h, F.col("p_size") / 10)
    restores, m = F.col("p_size") % 2 == 0, (F.col("p_size") % 3 + 1).cast("long")
    mode, num, den = D.interpolation(m, F.col("p_size") % 5 > 0, F.lit(24000).cast("long"), F.lit(1001).cast("long"))
    mw, mh = D.model_geometry(restores, (tw, th), (w, h))
    chain = D.filter_chain(F.when(restores, "restore"), F.lit(""), F.when(m > 1, F.concat(F.lit("minterp="), m.cast("string"))), F.lit("format=yuv420p"))
    return p.select("p_partkey", tw.alias("target_w"), th.alias("target_h"), mw.alias("model_w"), mh.alias("model_h"), D.needs_chunks(m > 1, restores, F.col("p_size") > 40).alias("chunked"), chain.alias("chain"), mode.alias("mode"), num.alias("fps_num"), den.alias("fps_den"))


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k, cents = F.col("s_suppkey"), F.round(F.col("s_acctbal") * 100).cast("long")
    mib = F.abs(cents) % 24000
    return s.select(
        _div(k, 3).alias("host"), k.alias("idx"), F.when(k % 4 == 3, "amd").otherwise("nvidia").alias("vendor"),
        F.when(k % 5 == 0, "integrated").when(k % 7 == 0, "cpu").when(k % 11 == 0, "other").otherwise("discrete").alias("device_type"), (k % 5 == 0).alias("unified"),
        F.when(k % 6 > 0, mib).alias("total_mib"), F.when(k % 4 > 0, mib % 5000).alias("used_mib"), F.when(k % 3 > 0, mib - mib % 3000).alias("budget_mib"),
        F.when(k % 2 == 0, mib % 900).alias("process_used_mib"), F.when(k % 2 == 0, F.lit("1.0")).alias("driver"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry merged by vendor, free memory and order."""
    d = _devices(spark, sf_dir)
    t = read_table(spark, sf_dir, "supplier").select(_div(F.col("s_suppkey"), 3).alias("host")).distinct()
    t = t.select("host", F.lit("amd").alias("vendor"), (F.col("host") * 100).alias("total_mib"), (F.col("host") * 7).alias("used_mib"), F.lit("9.9").alias("driver"))
    return D.device_order(D.free_mib(D.merge_telemetry(d, t))).select("host", "idx", "place", "total_mib", "used_mib", "driver", "free")


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet's free memory, the two preferred devices and the budget."""
    d = _devices(spark, sf_dir)
    t = d.select("host").distinct().join(D.fleet(d), "host", "left").join(D.runtime_device(d), "host", "left")
    budget, notes = D.vram_budget(F.col("free"))
    return t.select("host", "free", "preferred", "device", budget.alias("budget_mib"), notes.alias("notes"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-set estimates and the next rung."""
    p = read_table(spark, sf_dir, "part")
    tile = F.element_at(F.array(*[F.lit(x) for x in (0, 128, 192, 200, 256, 384, 512)]), (F.col("p_partkey") % 7 + 1).cast("int"))
    least = (F.col("p_size") % 5 * 64 + 64).cast("int")
    return p.select("p_partkey", tile.alias("tile"), least.alias("least"), D.working_set_mib(tile, (F.col("p_size") % 4 + 1).cast("long")).alias("mib"), D.degrade(tile, least).alias("next_tile"))


def heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest local heap of each device."""
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    h = l.groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    h = h.select(F.col("l_suppkey").alias("device"), F.col("l_linenumber").alias("heap"), (F.col("q") % 20 * 1073741824).alias("size"), (F.col("l_linenumber") != 2).alias("device_local"), F.when(F.col("q") % 3 > 0, F.col("q") * 1048576).otherwise(0).cast("long").alias("budget"))
    return D.largest_heap(h, ["device"])


KINDS = ("ffmpeg", "plugin", "device_memory", "stage", "cancelled", "unsupported", "tool_missing", "probe", "no_encoder", "state")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused model tasks and decodes, and which failures are worth a retry."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", D.refusal(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, "restoration").alias("restoration"), D.decode_refusal(F.col("p_size") * 100).alias("decode"), kind.alias("kind"), retryable(kind).alias("retry")
    )


ENCODERS = [
    (0, "av1_nvenc", "av1", True, ["p010le", "nv12"]), (1, "hevc_nvenc", "hevc", True, ["p010le", "nv12"]), (2, "h264_nvenc", "h264", True, ["nv12"]),
    (3, "libx265", "hevc", False, ["yuv420p10le", "yuv420p"]), (4, "libsvtav1", "av1", False, ["yuv420p10le", "yuv420p"]), (5, "libx264", "h264", False, ["yuv420p10le", "yuv420p"]),
    (6, "libvpx-vp9", "vp9", False, ["yuv420p"]),
]
AUDIO = ("flac", "alac", "tta", "libopus", "aac", "libvorbis", "mp2")


def encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder chains by host with pixel format and audio encoder."""
    table = F.broadcast(spark.createDataFrame(ENCODERS, "idx int, name string, codec string, hardware boolean, formats array<string>"))
    host = F.col("n_nationkey").cast("long")
    order = F.when(host % 3 == 0, F.array(F.lit("av1"), F.lit("hevc"), F.lit("h264"))).when(host % 3 == 1, F.array(F.lit("hevc"), F.lit("h264"))).otherwise(F.array(F.lit("h264"), F.lit("av1")))
    preference = read_table(spark, sf_dir, "nation").select(host.alias("host"), (host % 2 == 0).alias("prefer_hardware"), (host % 5 > 0).alias("allow_software"), order.alias("codecs"), (host % 4 < 2).alias("prefer_10bit"))
    slot = F.explode(F.sequence(F.lit(0), F.lit(len(ENCODERS) - 1))).alias("idx")
    have = preference.select("host", slot).filter((F.col("host") + F.col("idx")) % 3 > 0)
    kind = (F.col("host") + F.col("idx")) % 4
    supported = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("nv12"), F.lit("yuv420p"))).when(kind == 2, F.array(F.lit("yuv420p10le"), F.lit("p010le"))).otherwise(F.array(F.lit("rgb24")))
    t = D.encoder_chain(have.withColumn("supported", supported).join(table, "idx"), preference)
    names = F.array(*[F.lit(x) for x in AUDIO])
    audio = D.audio_encoder(F.filter(names, lambda x, i: (F.col("host") + i) % 4 == 0), F.col("host") % 2 == 0)
    return t.select("host", "place", "name", "pix_fmt", audio.alias("audio"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a conversion that applies, planned against actual."""
    k = F.col("o_orderkey")
    some = lambda names, n: F.filter(F.array(*[F.lit(x) for x in names]), lambda x, i: (k + i) % n == 0)
    source = (k % 5000) * 0.25 + 1
    t = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 17 > 0, F.concat(F.lit("video "), F.col("o_orderstatus"))).alias("video"), source.alias("source_s"), (source + (k % 13) / 8 - 0.75).alias("output_s"),
        (k % 3 * 2 + 640).cast("int").alias("planned_w"), F.lit(480).alias("planned_h"), F.when(k % 17 > 0, (k % 6 * 2 + 640).cast("int")).alias("w"), F.when(k % 17 > 0, 480).alias("h"),
        (k % 4 > 0).alias("audio_enabled"), (k % 3 > 0).alias("keep_original"), some(["ac3", "dts", "aac"], 2).alias("source_codecs"), some(["flac", "ac3", "aac", "dts"], 3).alias("output_codecs"),
        *[(k % n).cast("int").alias(f"{side}_{what}") for side, add in (("source", 0), ("output", 1)) for what, n in (("subtitles", 3 + add), ("chapters", 5 + add), ("attachments", 7 - add))],
        (k % 2 == 0).alias("interpolated"), ((k % 7 + 24) * 2).cast("double").alias("planned_fps"), F.when(k % 17 > 0, (k % 7 + 24) * 2 + (k % 5 - 2) * 0.25).alias("fps"),
        F.when(k % 11 > 0, k % 16 / 4 - 3.5).alias("true_peak"), F.when(k % 10 > 0, k % 12 / 2 - 22).alias("loudness"), F.lit(-1.5).alias("peak_target"), F.lit(-19.0).alias("loudness_target"),
        F.when(k % 9 == 0, F.concat(F.lit("exit "), (k % 4).cast("string"))).alias("measure_error"),
    )
    return D.quality_checks(t, ["o_orderkey"], D.conversion_checks())


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by order."""
    return D.check_summary(quality(spark, sf_dir), ["o_orderkey"])


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraction and remaining time."""
    e = read_table(spark, sf_dir, "events")
    us = F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 1000)
    f, eta = D.job_progress(us, F.col("event_id") % 500, (F.col("user_id") % 9 * 1.0), F.lit(400).cast("long"), F.col("event_id") % 4 / 2)
    return e.select("event_id", F.round(f, 9).alias("fraction"), F.round(eta, 9).alias("eta"))


def conversion_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole plans by file."""
    c = cadence(spark, sf_dir).select("file", "mode", "chain", "confidence")
    f = F.col("file")
    shapes = c.select("file", *[x.alias(n) for n, x in zip(("target_w", "target_h"), D.choose_target(f * 20, f * 30, F.lit(2.0)))], (f * 10).alias("source_frames"), (f % 2 + 1).alias("multiplier"))
    audio = c.filter(f % 7 > 0).select("file", D.audio_plan(f % 3 == 0, f / 4, f / 8, F.when(f % 3 == 0, "above target").otherwise("within"), f % 2 == 0, f % 4).alias("audio"))
    p = D.assemble_plan(c, shapes, audio)
    return p.select("file", "plan.mode", "plan.raster.target_w", "plan.raster.target_h", "plan.decoded_frames", "plan.output_frames", "plan.audio.remaster", "plan.audio.tracks", F.array_join("warnings", "; ").alias("warnings"))


def _counts_sql() -> str:
    special = {
        "progressive": "CASE WHEN l_suppkey % 5 < 2 THEN q * 40 ELSE q % 7 END", "tff": "CASE WHEN l_suppkey % 5 = 2 THEN q * 30 ELSE q % 5 END",
        "single_undetermined": "CASE WHEN l_partkey % 2 = 0 THEN q * 20 ELSE 0 END", "repeated_neither": "CASE WHEN l_suppkey % 5 = 4 THEN q ELSE q * 60 END",
    }
    cols = ", ".join(f"sum({special.get(c, f'(q * {i + 1} + l_partkey) % 11')})::BIGINT AS {c}" for i, c in enumerate(D.COUNTERS))
    return f"SELECT l_suppkey AS file, {cols} FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_suppkey"


ORACLES = {}
ORACLES["cadence"] = f"""WITH t AS ({_counts_sql()}),
u AS (SELECT *, file % 3 = 0 AS dec, tff + bff + progressive + undetermined AS mu, repeated_neither + repeated_top + repeated_bottom + repeated_repeat AS fr, single_tff + single_bff + single_progressive + single_undetermined AS si FROM t),
v AS (SELECT *, coalesce(progressive / nullif(mu, 0), 0) AS p, coalesce((tff + bff) / nullif(mu, 0), 0) AS i0, coalesce((fr - repeated_neither) / nullif(fr, 0), 0) AS r, coalesce((single_tff + single_bff) / nullif(si, 0), 1) AS combing, fr = 0 OR mu = 0 AS no FROM u),
w AS (SELECT *, NOT no AND NOT dec AND i0 >= 0.6 AND combing < 0.5 AS veto FROM v),
x AS (SELECT *, CASE WHEN veto THEN 0 ELSE i0 END AS i FROM w),
y AS (SELECT *, CASE WHEN no THEN 'unknown' WHEN NOT veto AND r >= 0.1 AND i >= 0.05 THEN 'telecine' WHEN p >= 0.9 THEN 'progressive' WHEN i >= 0.6 THEN 'interlaced' WHEN p >= 0.6 AND i < 0.2 THEN 'progressive' WHEN veto THEN 'progressive' ELSE 'mixed' END AS mode FROM x)
SELECT file, mode, round(CASE mode WHEN 'progressive' THEN least(greatest(0.5 + (p - 0.9) * 5, 0.5), 1) WHEN 'telecine' THEN least(greatest(0.5 + (r - 0.1) * 5, 0.5), 1) WHEN 'interlaced' THEN least(greatest(0.5 + (i - 0.6) * 2, 0.5), 1)
  WHEN 'mixed' THEN least(greatest(0.5 + (0.5 - abs(p - i)) * 2, 0.4), 0.9) ELSE 0 END::DOUBLE, 9) AS confidence,
  concat_ws('; ', CASE WHEN no THEN 'no usable statistics' END, CASE WHEN veto THEN 'aggregate vetoed' END, CASE WHEN NOT no AND dec AND mode = 'progressive' THEN 'declared interlaced, frames progressive' END,
    CASE WHEN NOT dec AND NOT veto AND mode IN ('interlaced', 'telecine') THEN 'declared progressive, frames disagree' END, CASE WHEN tff > 0 AND bff > 0 AND mode = 'interlaced' THEN 'both field orders' END,
    CASE WHEN mode = 'telecine' THEN 'inverse telecine planned' END, CASE WHEN mode = 'mixed' THEN 'selective deinterlace only' END, CASE WHEN NOT no AND undetermined / mu > 0.5 THEN 'mostly undetermined' END) AS notes,
  round(combing, 9) AS combing, CASE mode WHEN 'interlaced' THEN '{D.CADENCE_CHAINS["interlaced"]}' WHEN 'mixed' THEN '{D.CADENCE_CHAINS["mixed"]}' WHEN 'telecine' THEN '{D.CADENCE_CHAINS["telecine"]}' END AS chain, mode = 'telecine' AS renumbers FROM y"""
ORACLES["cadence_points"] = """WITH RECURSIVE d AS (SELECT p_partkey, p_partkey % 400 / 4 AS s FROM part),
a AS MATERIALIZED (SELECT p_partkey, least(greatest(s * f, 0), greatest(s - 6, 0))::DOUBLE AS at FROM d, (SELECT unnest([0, 0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99]::DOUBLE[]) AS f) WHERE s > 6 UNION SELECT p_partkey, 0::DOUBLE FROM d),
r(p_partkey, k, pos) AS (SELECT p_partkey, 0, 0::DOUBLE FROM d UNION ALL SELECT r.p_partkey, r.k + 1, (SELECT min(a.at) FROM a WHERE a.p_partkey = r.p_partkey AND a.at - r.pos >= 1.0) FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.p_partkey = r.p_partkey AND a.at - r.pos >= 1.0))
SELECT p_partkey, k, round(pos, 9) AS at FROM r""".replace(" AS at", ' AS "at"').replace("a.at", 'a."at"')
ORACLES["geometry"] = """WITH p AS (SELECT *, p_partkey % 1900 AS w, p_size::BIGINT * 29 AS h, greatest(p_size / 10, 1) AS up, p_size % 2 = 0 AS res, (p_size % 3 + 1)::BIGINT AS m FROM part),
q AS (SELECT *, least(CASE WHEN h < 1080 THEN 1080 ELSE h END, greatest(round(h * up)::BIGINT, h)) AS hh FROM p),
r AS (SELECT *, greatest(round(hh * w / nullif(h, 0))::BIGINT, 2) AS ww, greatest(hh, 2) AS h2, w = 0 OR h = 0 AS no FROM q),
s AS (SELECT *, CASE WHEN no THEN 1920 ELSE ww + ww % 2 END AS tw, CASE WHEN no THEN 1080 ELSE h2 + h2 % 2 END AS th FROM r)
SELECT p_partkey, tw AS target_w, th AS target_h, CASE WHEN res THEN tw ELSE greatest(w, 2) + greatest(w, 2) % 2 END AS model_w, CASE WHEN res THEN th ELSE greatest(h, 2) + greatest(h, 2) % 2 END AS model_h, m > 1 OR res OR p_size > 40 AS chunked,
  concat_ws(',', CASE WHEN res THEN 'restore' END, CASE WHEN m > 1 THEN 'minterp=' || m END, 'format=yuv420p') AS chain, CASE WHEN m = 1 THEN 'off' WHEN p_size % 5 = 0 THEN 'refused' ELSE 'rife' END AS mode,
  24000 * CASE WHEN m > 1 AND p_size % 5 > 0 THEN m ELSE 1 END AS fps_num, 1001::BIGINT AS fps_den FROM s"""
_DEVICES = """mi AS (SELECT s_suppkey AS idx, abs(CAST(round(s_acctbal * 100) AS BIGINT)) % 24000 AS mib FROM supplier),
dv AS (SELECT idx // 3 AS host, idx, CASE WHEN idx % 4 = 3 THEN 'amd' ELSE 'nvidia' END AS vendor, CASE WHEN idx % 5 = 0 THEN 'integrated' WHEN idx % 7 = 0 THEN 'cpu' WHEN idx % 11 = 0 THEN 'other' ELSE 'discrete' END AS device_type, idx % 5 = 0 AS unified,
  CASE WHEN idx % 6 > 0 THEN mib END AS total_mib, CASE WHEN idx % 4 > 0 THEN mib % 5000 END AS used_mib, CASE WHEN idx % 3 > 0 THEN mib - mib % 3000 END AS budget_mib, CASE WHEN idx % 2 = 0 THEN mib % 900 END AS process_used_mib, CASE WHEN idx % 2 = 0 THEN '1.0' END AS driver FROM mi)"""
_FREE = "CASE WHEN NOT unified THEN least(CASE WHEN budget_mib IS NOT NULL THEN greatest(budget_mib - coalesce(process_used_mib, 0), 0) END, CASE WHEN total_mib IS NOT NULL THEN greatest(total_mib - coalesce(used_mib, 0), 0) END) END"
ORACLES["devices"] = f"""WITH {_DEVICES}, n AS (SELECT *, vendor = 'amd' AND count(*) OVER (PARTITION BY host, vendor) = 1 AS one FROM dv),
m AS (SELECT * REPLACE (CASE WHEN one THEN coalesce(total_mib, host * 100) ELSE total_mib END AS total_mib, CASE WHEN one THEN host * 7 ELSE used_mib END AS used_mib, CASE WHEN one THEN coalesce(driver, '9.9') ELSE driver END AS driver) FROM n)
SELECT host, idx, row_number() OVER (PARTITION BY host ORDER BY CASE device_type WHEN 'discrete' THEN 0 WHEN 'integrated' THEN 2 ELSE 1 END, total_mib DESC NULLS LAST, idx) - 1 AS place, total_mib, used_mib, driver, {_FREE} AS free FROM m"""
ORACLES["budgets"] = f"""WITH {_DEVICES}, f AS (SELECT *, {_FREE} AS free FROM dv),
b AS (SELECT host, max(free) FILTER (WHERE device_type NOT IN ('cpu', 'virtual')) AS free FROM f GROUP BY host),
c AS (SELECT b.*, (SELECT max(idx) FROM f WHERE f.host = b.host AND f.free = b.free AND device_type NOT IN ('cpu', 'virtual')) AS preferred, (SELECT min(idx) FROM f WHERE f.host = b.host AND device_type = 'discrete' AND NOT unified AND budget_mib > 0) AS device FROM b)
SELECT host, free, preferred, device, CASE WHEN free IS NULL THEN 13312 ELSE least(13312, greatest(free - 2560, 0)) END AS budget_mib,
  concat_ws('; ', CASE WHEN free IS NULL THEN 'no telemetry' END, CASE WHEN greatest(free - 2560, 0) < 13312 AND free IS NOT NULL THEN 'reduced' END, CASE WHEN greatest(free - 2560, 0) < 2048 AND free IS NOT NULL THEN 'under 2 GiB' END) AS notes FROM c"""
ORACLES["ladder"] = """WITH t AS (SELECT p_partkey, [0, 128, 192, 200, 256, 384, 512][(p_partkey % 7 + 1)::INT] AS tile, (p_size % 5 * 64 + 64)::INT AS least, p_size % 4 + 1 AS scale FROM part)
SELECT p_partkey, tile, least, 67 + (CASE tile WHEN 0 THEN 512 ELSE tile END)::BIGINT * (CASE tile WHEN 0 THEN 512 ELSE tile END) * scale * scale * 144 // 1048576 + 69 AS mib,
  CASE WHEN tile = 0 THEN coalesce((SELECT max(r) FROM (SELECT unnest([512, 384, 256, 192, 128]) AS r) WHERE r >= least), least) ELSE (SELECT max(r) FROM (SELECT unnest([512, 384, 256, 192, 128]) AS r) WHERE r < tile AND r >= least) END AS next_tile FROM t"""
ORACLES["heaps"] = """WITH h AS (SELECT l_suppkey AS device, l_linenumber AS heap, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY q % 20 DESC, heap) AS k FROM h WHERE heap <> 2)
SELECT device, heap, q % 20 * 1024 AS total_mib, CASE WHEN q % 3 > 0 THEN q END AS budget_mib FROM r WHERE k = 1"""
ORACLES["refusals"] = f"""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'restoration was asked for and no runtime can run it' END AS restoration,
  CASE WHEN p_size > 36 THEN 'in-memory decode refused for streams longer than an hour' END AS decode, {list(KINDS)}[p_partkey % {len(KINDS)} + 1] AS kind, p_partkey % {len(KINDS)} < 4 AS retry FROM part"""
ORACLES["encoders"] = f"""WITH e(idx, name, codec, hardware, formats) AS (VALUES {", ".join(map(str, ENCODERS))}),
h AS (SELECT n_nationkey::BIGINT AS host, CASE n_nationkey % 3 WHEN 0 THEN ['av1', 'hevc', 'h264'] WHEN 1 THEN ['hevc', 'h264'] ELSE ['h264', 'av1'] END AS codecs FROM nation),
x AS (SELECT *, CASE (host + idx) % 4 WHEN 0 THEN NULL WHEN 1 THEN ['nv12', 'yuv420p'] WHEN 2 THEN ['yuv420p10le', 'p010le'] ELSE ['rgb24'] END AS supported FROM h, e WHERE (host + idx) % 3 > 0 AND (host % 5 > 0 OR hardware)),
f AS (SELECT host, idx, name, codec, hardware, codecs, u.f AS f, u.i + CASE WHEN host % 4 >= 2 AND u.f LIKE '%10%' THEN 100 ELSE 0 END AS rank FROM x, LATERAL (SELECT unnest(formats) AS f, unnest(range(len(formats))) AS i) u WHERE supported IS NULL OR list_contains(supported, u.f)),
p AS (SELECT host, idx, name, codec, hardware, codecs, min_by(f, rank) AS pix_fmt FROM f GROUP BY ALL)
SELECT host, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN hardware = (host % 2 = 0) THEN 0 ELSE 1 END, coalesce(list_position(codecs, codec), 100), idx) - 1 AS place, name, pix_fmt,
  coalesce((SELECT min_by(n, CASE WHEN host % 2 = 0 THEN i ELSE (i + 3) % 6 END) FROM (VALUES (0, 'flac'), (1, 'alac'), (2, 'tta'), (3, 'libopus'), (4, 'aac'), (5, 'libvorbis')) a(i, n) WHERE (host + i) % 4 = 0), 'pcm_s16le') AS audio FROM p"""
_QUALITY = """b AS (SELECT o_orderkey, o_orderkey AS k, o_orderstatus, o_orderkey % 17 > 0 AS video, (o_orderkey % 5000) * 0.25::DOUBLE + 1 AS s, (o_orderkey % 13) / 8 - 0.75::DOUBLE AS d,
  list_filter(['ac3', 'dts', 'aac'], lambda x, i: (o_orderkey + i - 1) % 2 = 0) AS sc, list_filter(['flac', 'ac3', 'aac', 'dts'], lambda x, i: (o_orderkey + i - 1) % 3 = 0) AS oc,
  CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 16 / 4 - 3.5 END::DOUBLE AS peak, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 12 / 2 - 22 END::DOUBLE AS loud FROM orders),
t AS (SELECT *, CASE WHEN k % 4 > 0 AND len(sc) > 0 THEN CASE WHEN k % 3 > 0 THEN len(sc) + 1 ELSE 1 END ELSE len(sc) END AS expected, k % 4 > 0 AND len(oc) > 0 AS measured,
  (k % 7 + 24) * 2 AS pf, CASE WHEN video THEN (k % 7 + 24) * 2 + (k % 5 - 2) * 0.25::DOUBLE ELSE 0 END AS af FROM b),
q AS (SELECT o_orderkey, 'output exists and probes' AS name, video AS passed, CASE WHEN video THEN 'video ' || o_orderstatus ELSE 'no video stream' END AS detail FROM t
  UNION ALL SELECT o_orderkey, 'duration drift', abs(d) <= greatest(0.5, s * 0.001::DOUBLE), printf('source %.3fs, output %.3fs, drift %.3fs', s, s + d, abs(d)) FROM t
  UNION ALL SELECT o_orderkey, 'resolution matches the plan', coalesce(video AND k % 6 = k % 3, false), 'planned ' || (k % 3 * 2 + 640) || 'x480, got ' || CASE WHEN video THEN (k % 6 * 2 + 640) || 'x480' ELSE '?' END FROM t
  UNION ALL SELECT o_orderkey, 'audio tracks preserved', len(oc) >= expected, 'expected at least ' || expected || ', found ' || len(oc) FROM t
  UNION ALL SELECT o_orderkey, 'original audio present', list_has_all(oc, sc), 'source codecs ' || array_to_string(sc, ', ') FROM t WHERE k % 3 > 0
  UNION ALL SELECT o_orderkey, 'subtitles preserved', k % 4 >= k % 3, 'source ' || k % 3 || ', output ' || k % 4 FROM t
  UNION ALL SELECT o_orderkey, 'chapters preserved', k % 6 >= k % 5, 'source ' || k % 5 || ', output ' || k % 6 FROM t
  UNION ALL SELECT o_orderkey, 'attachments preserved', k % 6 >= k % 7, 'source ' || k % 7 || ', output ' || k % 6 FROM t
  UNION ALL SELECT o_orderkey, 'frame rate matches the plan', abs(af - pf) <= greatest(pf * 0.01::DOUBLE, 0.05), printf('planned %.3f fps, got %.3f fps', pf::DOUBLE, af) FROM t WHERE k % 2 = 0
  UNION ALL SELECT o_orderkey, 'true peak within target', coalesce(peak <= -1.5::DOUBLE + 0.2, true), CASE WHEN peak IS NULL THEN 'not measured' ELSE printf('%.2f dBTP', peak) END FROM t WHERE measured AND k % 9 <> 0
  UNION ALL SELECT o_orderkey, 'integrated loudness within 1 LU of target', coalesce(abs(loud + 19) <= 1, true), CASE WHEN loud IS NULL THEN 'not measured' ELSE printf('%.1f LUFS', loud) END FROM t WHERE measured AND k % 9 <> 0
  UNION ALL SELECT o_orderkey, 'loudness verification', true, 'not measured: exit ' || k % 4 FROM t WHERE measured AND k % 9 = 0)"""
ORACLES["quality_checks"] = f"WITH {_QUALITY} SELECT * FROM q"
ORACLES["quality_summary"] = f"WITH {_QUALITY} SELECT o_orderkey, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed, bool_and(passed) AS all_passed FROM q GROUP BY 1"
ORACLES["job_progress"] = """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id * 1000 / 1e6 END::DOUBLE AS s, event_id % 500 AS f, user_id % 9 * 1.0::DOUBLE AS total, event_id % 4 / 2 AS speed FROM events)
SELECT event_id, round(least(greatest(CASE WHEN total > 0 AND s IS NOT NULL THEN s / total ELSE f / 400 END, 0), 1), 9) AS fraction, round(CASE WHEN speed > 0.01 AND total > 0 AND s IS NOT NULL THEN greatest(total - s, 0) / speed END, 9) AS eta FROM t"""

ORACLES["conversion_plans"] = f"""WITH c AS ({ORACLES["cadence"]}),
t AS (SELECT *, CASE WHEN mode = 'telecine' THEN file * 10 * 4 // 5 ELSE file * 10 END AS dec, least(CASE WHEN file * 30 < 1080 THEN 1080 ELSE file * 30 END, greatest(round(file * 30 * 2)::BIGINT, file * 30)) AS h FROM c),
u AS (SELECT *, greatest(round(h * file * 20 / nullif(file * 30, 0))::BIGINT, 2) AS w FROM t)
SELECT file, mode, CASE WHEN file = 0 THEN 1920 ELSE w + w % 2 END AS target_w, CASE WHEN file = 0 THEN 1080 ELSE h + h % 2 END AS target_h, dec AS decoded_frames, CASE WHEN dec > 0 THEN (file % 2 + 1) * (dec - 1) + 1 ELSE 0 END AS output_frames,
  CASE WHEN file % 7 > 0 THEN file % 3 = 0 END AS remaster, CASE WHEN file % 7 > 0 THEN CASE WHEN file % 4 = 0 THEN 0 WHEN file % 2 = 0 THEN file % 4 + 1 ELSE 1 END END::INT AS tracks,
  concat_ws('; ', CASE WHEN file % 7 = 0 THEN 'no audio' END, CASE WHEN confidence < 0.5 THEN 'cadence unsure' END, CASE WHEN file <> 0 AND h + h % 2 > 2160 THEN 'large canvas' END) AS warnings FROM u"""

QUERIES = {
    "conversion_plans": conversion_plans, "cadence": cadence, "cadence_points": sample_points, "geometry": geometry, "devices": devices, "budgets": budgets, "ladder": ladder, "heaps": heaps, "encoders": encoders, "refusals": refusals,
    "quality_checks": quality, "quality_summary": quality_summary, "job_progress": job_progress,
}
