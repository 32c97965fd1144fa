"""Decision tables: cadence, geometry, memory budget, devices, encoders and quality checks.

Each is a projection over rows; notes are arrays of the texts that apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
FRACTIONS = (0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99)
TILE_LADDER = (512, 384, 256, 192, 128)
CEILING_MIB, RESERVE_MIB = 13312, 2560
COUNTERS = (
    "tff", "bff", "progressive", "undetermined", "single_tff", "single_bff", "single_progressive", "single_undetermined",
    "repeated_neither", "repeated_top", "repeated_bottom", "repeated_repeat",
)


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 where the total is 0."""
    return F.when(total != 0, part / F.nullif(total, F.lit(0).cast("long"))).otherwise(0.0)


def sum_counts(samples: DataFrame, key: str = "file") -> DataFrame:
    """The twelve counters summed over a file's windows."""
    return samples.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def sample_points(seconds: Column, window: float = 6.0) -> Column:
    """Window starts: 0 and the fractions clamped to the last start, sorted; of points within one
    second of the last kept one, the earlier stays."""
    last = F.greatest(seconds - window, F.lit(0.0))
    points = F.sort_array(F.array(F.lit(0.0), *[F.least(F.greatest(seconds * f, F.lit(0.0)), last) for f in FRACTIONS]))
    keep = lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).when(p - F.element_at(acc, -1) < 1.0, acc).otherwise(F.array_append(acc, p))
    kept = F.aggregate(points, F.array().cast("array<double>"), keep)
    return F.when(seconds <= window, F.array(F.lit(0.0))).otherwise(kept)


def cadence(totals: DataFrame) -> DataFrame:
    """Mode, confidence and notes from summed counters and ``declared_interlaced``."""
    c = {n: F.col(n) for n in COUNTERS}
    multi = c["tff"] + c["bff"] + c["progressive"] + c["undetermined"]
    frames = c["repeated_neither"] + c["repeated_top"] + c["repeated_bottom"] + c["repeated_repeat"]
    single = c["single_tff"] + c["single_bff"] + c["single_progressive"] + c["single_undetermined"]
    t = totals.withColumns(
        {
            "p": ratio(c["progressive"], multi), "i0": ratio(c["tff"] + c["bff"], multi), "r": ratio(c["repeated_top"] + c["repeated_bottom"] + c["repeated_repeat"], frames),
            "combing": F.when(single == 0, 1.0).otherwise(ratio(c["single_tff"] + c["single_bff"], single)), "none": (frames == 0) | (multi == 0), "dark": ratio(c["undetermined"], multi),
        }
    )
    declared = F.col("declared_interlaced")
    t = t.withColumn("vetoed", ~F.col("none") & ~declared & (F.col("i0") >= 0.60) & (F.col("combing") < 0.50))
    t = t.withColumn("i", F.when(F.col("vetoed"), 0.0).otherwise(F.col("i0")))
    p, i, r, veto = (F.col(x) for x in ("p", "i", "r", "vetoed"))
    mode = (
        F.when(F.col("none"), "unknown").when(~veto & (r >= 0.10) & (i >= 0.05), "telecine").when(p >= 0.90, "progressive").when(i >= 0.60, "interlaced")
        .when((p >= 0.60) & (i < 0.20), "progressive").when(veto, "progressive").otherwise("mixed")
    )
    t = t.withColumn("mode", mode)
    m = F.col("mode")
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    confidence = (
        F.when(m == "progressive", clamp(0.5 + (p - 0.90) * 5, 0.5, 1.0)).when(m == "telecine", clamp(0.5 + (r - 0.10) * 5, 0.5, 1.0))
        .when(m == "interlaced", clamp(0.5 + (i - 0.60) * 2, 0.5, 1.0)).when(m == "mixed", clamp(0.5 + (0.5 - F.abs(p - i)) * 2, 0.4, 0.9)).otherwise(0.0)
    )
    known = ~F.col("none")
    notes = F.array(
        F.when(F.col("none"), "no usable statistics"), F.when(veto, "aggregate vetoed"), F.when(known & declared & (m == "progressive"), "declared interlaced, frames progressive"),
        F.when(~declared & ~veto & m.isin("interlaced", "telecine"), "declared progressive, frames disagree"), F.when((c["tff"] > 0) & (c["bff"] > 0) & (m == "interlaced"), "both field orders"),
        F.when(m == "telecine", "inverse telecine planned"), F.when(m == "mixed", "selective deinterlace only"), F.when(known & (F.col("dark") > 0.5), "mostly undetermined"),
    )
    return t.withColumns({"confidence": confidence, "notes": F.array_join(F.array_compact(notes), "; ")})


#: Filter chains by mode; only telecine drops frames (rate x 4/5).
CADENCE_CHAINS = {
    "interlaced": "bwdif=mode=send_frame:parity=auto:deint=all",
    "mixed": "bwdif=mode=send_frame:parity=auto:deint=interlaced",
    "telecine": "fieldmatch=order=auto:combmatch=full,decimate",
}


def cadence_plan(mode: Column) -> tuple[Column, Column]:
    """(filter chain or NULL, whether frames are renumbered)."""
    chain = F.lit(None).cast("string")
    for name, text in CADENCE_CHAINS.items():
        chain = F.when(mode == name, text).otherwise(chain)
    return chain, mode == "telecine"


def _even(x: Column) -> Column:
    x = F.greatest(x, F.lit(2).cast("long"))
    return x + x % 2


def choose_target(w: Column, h: Column, max_upscale: Column) -> tuple[Column, Column]:
    """1080 lines for smaller sources, no more than the upscale allows, even; 1920 x 1080 for no size."""
    up = F.greatest(max_upscale, F.lit(1.0))
    lines = F.least(F.when(h < 1080, F.lit(1080).cast("long")).otherwise(h), F.greatest(F.round(h * up).cast("long"), h))
    width = F.round(lines * w / F.nullif(h, F.lit(0).cast("long"))).cast("long")
    none = (w == 0) | (h == 0)
    return F.when(none, F.lit(1920).cast("long")).otherwise(_even(width)), F.when(none, F.lit(1080).cast("long")).otherwise(_even(lines))


def model_geometry(restores: Column, target: tuple[Column, Column], square: tuple[Column, Column]) -> tuple[Column, Column]:
    """The canvas where restoration is on, else the square-pixel source, even; the model's input is always the source."""
    return tuple(_even(F.when(restores, t).otherwise(s)) for t, s in zip(target, square))


def needs_chunks(interpolates: Column, restores: Column, regrains: Column) -> Column:
    return interpolates | restores | regrains


def filter_chain(*parts: Column) -> Column:
    """Ordered optional filters, joined by comma; NULL and empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ",")


def interpolation(multiplier: Column, has_runtime: Column, fps_num: Column, fps_den: Column) -> tuple[Column, Column, Column]:
    """(mode, output rate's numerator, denominator): off, refused without a runtime, or rife."""
    on = multiplier > 1
    mode = F.when(~on, "off").when(~has_runtime, "refused").otherwise("rife")
    num = fps_num * F.when(on & has_runtime, multiplier).otherwise(1)
    g = F.when((num % fps_den == 0), fps_den).otherwise(F.lit(1).cast("long"))
    return mode, F.call_function("div", num.cast("long"), g.cast("long")), F.call_function("div", fps_den.cast("long"), g.cast("long"))


def refusal(missing: Column, wanted: Column, task: str) -> Column:
    """Why a wanted model task can't run, by name; NULL where it can or isn't wanted."""
    return F.when(wanted & missing, F.lit(f"{task} was asked for and no runtime can run it"))


def refuse(missing: Column, wanted: Column, task: str) -> Column:
    """Raises by name where a wanted model task has no runtime; True elsewhere."""
    reason = refusal(missing, wanted, task)
    return F.when(reason.isNotNull(), F.raise_error(reason).cast("boolean")).otherwise(True)


def decode_refusal(seconds: Column) -> Column:
    """Why a stream isn't decoded whole into memory: it is longer than an hour; NULL otherwise."""
    return F.when(seconds > 3600, F.lit("in-memory decode refused for streams longer than an hour"))


def free_mib(d: DataFrame) -> DataFrame:
    """Devices with ``free``: the lower of the two views, NULL for unified memory."""
    zero = F.lit(0).cast("long")
    budget = F.greatest(F.col("budget_mib") - F.coalesce("process_used_mib", zero), zero)
    total = F.greatest(F.col("total_mib") - F.coalesce("used_mib", zero), zero)
    budget, total = F.when(F.col("budget_mib").isNotNull(), budget), F.when(F.col("total_mib").isNotNull(), total)
    return d.withColumn("free", F.when(~F.col("unified"), F.least(budget, total)))


def is_candidate() -> Column:
    return ~F.col("device_type").isin("cpu", "virtual")


def fleet(devices: DataFrame, key: str = "host") -> DataFrame:
    """(key, free, preferred): most free memory among candidates; ties go to the last device."""
    d = free_mib(devices).filter(is_candidate() & F.col("free").isNotNull())
    best = F.max(F.struct("free", "idx")).alias("best")
    return d.groupBy(key).agg(best).select(key, F.col("best.free").alias("free"), F.col("best.idx").alias("preferred"))


def runtime_device(devices: DataFrame, key: str = "host") -> DataFrame:
    """(key, device): the first discrete device that isn't unified and has a budget."""
    d = devices.filter((F.col("device_type") == "discrete") & ~F.col("unified") & (F.col("budget_mib") > 0))
    return d.groupBy(key).agg(F.min("idx").alias("device"))


def vram_budget(free: Column, ceiling: int = CEILING_MIB, reserve: int = RESERVE_MIB) -> tuple[Column, Column]:
    """(budget, notes): the ceiling, or what is free less the reserve if that is lower."""
    available = F.when(free.isNotNull(), F.greatest(free - reserve, F.lit(0).cast("long")))
    budget = F.when(free.isNull(), F.lit(ceiling).cast("long")).otherwise(F.least(F.lit(ceiling).cast("long"), available))
    notes = F.array(F.when(free.isNull(), "no telemetry"), F.when(available < ceiling, "reduced"), F.when(available < 2048, "under 2 GiB"))
    return budget, F.array_join(F.array_compact(notes), "; ")


def working_set_mib(tile: Column, scale: Column) -> Column:
    """67 MB of weights, tile^2 scale^2 x 3 x 48 bytes of activations, three 4K frames."""
    t = F.when(tile == 0, F.lit(TILE_LADDER[0])).otherwise(tile).cast("long")
    div = lambda a: F.call_function("div", a, F.lit(1048576).cast("long"))
    return F.lit(67) + div(t * t * scale * scale * 144) + F.lit(3 * (3840 * 2160 * 3 // 1048576))


def degrade(tile: Column, least: Column) -> Column:
    """The next smaller tile of the ladder that isn't under the least; automatic (0) starts at the first
    rung that isn't; NULL when exhausted."""
    ladder = F.array(*[F.lit(x) for x in TILE_LADDER])
    allowed = F.filter(ladder, lambda x: x >= least)
    lower = F.filter(allowed, lambda x: x < tile)
    first = F.when(F.size(allowed) > 0, F.element_at(allowed, 1)).otherwise(least)
    return F.when(tile == 0, first).when(F.size(lower) > 0, F.array_max(lower))


def merge_telemetry(devices: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Telemetry joined by vendor where exactly one device has it: totals and drivers fill gaps, use overrides."""
    w = Window.partitionBy("host", "vendor")
    t = devices.withColumn("n", F.count("*").over(w)).join(telemetry.withColumnsRenamed({"total_mib": "t_total", "used_mib": "t_used", "driver": "t_driver"}), ["host", "vendor"], "left")
    only = F.col("n") == 1
    return t.withColumns(
        {
            "total_mib": F.when(only, F.coalesce("total_mib", "t_total")).otherwise(F.col("total_mib")),
            "used_mib": F.when(only, F.coalesce("t_used", "used_mib")).otherwise(F.col("used_mib")),
            "driver": F.when(only, F.coalesce("driver", "t_driver")).otherwise(F.col("driver")),
        }
    ).drop("n", "t_total", "t_used", "t_driver")


def device_order(devices: DataFrame, key: str = "host") -> DataFrame:
    """Devices with ``place``: discrete, then others, then integrated; larger first, then as listed."""
    rank = F.when(F.col("device_type") == "discrete", 0).when(F.col("device_type") == "integrated", 2).otherwise(1)
    w = Window.partitionBy(key).orderBy(rank, F.desc_nulls_last("total_mib"), "idx")
    return devices.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def largest_heap(heaps: DataFrame, keys: list[str]) -> DataFrame:
    """The largest device-local heap (the first of equals) in MiB, a zero budget as NULL."""
    best = F.max(F.struct(F.col("size"), (-F.col("heap")).alias("neg"), F.col("budget"))).alias("b")
    t = heaps.filter("device_local").groupBy(*keys).agg(best)
    mib = lambda c: F.call_function("div", F.col(c), F.lit(1048576).cast("long"))
    return t.select(*keys, (-F.col("b.neg")).alias("heap"), mib("b.size").alias("total_mib"), F.when(F.col("b.budget") > 0, mib("b.budget")).alias("budget_mib"))


def encoder_chain(encoders: DataFrame, preference: DataFrame) -> DataFrame:
    """The encoders of each host that can be used, in order, with their pixel format.

    encoders: host, idx, name, codec, hardware, formats, supported (its build's formats, empty: unknown);
    preference: host, prefer_hardware, allow_software, codecs, prefer_10bit. An encoder without a usable
    format leaves the chain; the rest go by hardware as preferred, place of the codec, table order."""
    t = encoders.join(preference, "host").filter(F.col("allow_software") | F.col("hardware"))
    t = t.withColumn("pix_fmt", first_supported(F.col("formats"), F.col("supported"), F.col("prefer_10bit"))).filter("pix_fmt IS NOT NULL")
    place = F.array_position("codecs", F.col("codec"))
    w = Window.partitionBy("host").orderBy((F.col("hardware") != F.col("prefer_hardware")).cast("int"), F.when(place > 0, place - 1).otherwise(99), "idx")
    return t.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def first_supported(preferred: Column, supported: Column, prefer_10bit: Column) -> Column:
    """The first preferred entry that is supported, 10-bit ones last where they aren't preferred; no list of supported ones means the table is trusted."""
    ten = lambda x: x.contains("10")
    order = F.when(prefer_10bit, preferred).otherwise(F.concat(F.filter(preferred, lambda x: ~ten(x)), F.filter(preferred, ten)))
    kept = F.when(F.size(supported) == 0, order).otherwise(F.filter(order, lambda x: F.array_contains(supported, x)))
    return F.when(F.size(kept) > 0, F.element_at(kept, 1))


#: Audio encoders by preference.
LOSSLESS, LOSSY = ("flac", "alac", "tta"), ("libopus", "aac", "libvorbis")


def audio_encoder(available: Column, lossless: Column) -> Column:
    """The first available of the wanted kind, else of the other; pcm_s16le if none is."""
    both = lambda *lists: F.array(*[F.lit(x) for names in lists for x in names])
    order = F.when(lossless, both(LOSSLESS, LOSSY)).otherwise(both(LOSSY, LOSSLESS))
    return F.element_at(F.concat(F.filter(order, lambda x: F.array_contains(available, x)), F.array(F.lit("pcm_s16le"))), 1)


def duration_ok(source: Column, output: Column) -> Column:
    """Drift within max(max(0.05, 0.1 %), 0.5) seconds."""
    return F.abs(output - source) <= F.greatest(F.greatest(F.lit(0.05), source * 0.001), F.lit(0.5))


def quality_checks(rows: DataFrame, keys: list[str], checks: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(keys, name, passed, detail): one row per named check (applies, passed, detail) that applies."""
    made = [F.when(a, F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))) for n, (a, p, d) in checks.items()]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("c")).select(*keys, "c.*")


def conversion_checks() -> dict[str, tuple[Column, Column, Column]]:
    """The checks of an output against its plan and source.

    Columns: video, source_s, output_s, planned_w, planned_h, w, h (null without video), audio_enabled,
    keep_original, source_codecs, output_codecs, and for subtitles, chapters and attachments their number in source_
    and output_; interpolated, planned_fps, fps; true_peak, loudness (null: not measured), peak_target,
    loudness_target, measure_error (null: measured)."""
    c, always = F.col, F.lit(True)
    tracks, out_tracks = F.size("source_codecs"), F.size("output_codecs")
    expected = F.when(c("audio_enabled") & (tracks > 0), F.when(c("keep_original"), tracks + 1).otherwise(1)).otherwise(tracks)
    measured = c("audio_enabled") & (out_tracks > 0)
    kept = lambda what: (always, c(f"output_{what}") >= c(f"source_{what}"), F.format_string("source %d, output %d", c(f"source_{what}"), c(f"output_{what}")))
    size = F.when(c("w").isNotNull() & c("h").isNotNull(), F.format_string("%dx%d", "w", "h")).otherwise("?")
    found = lambda value, unit: F.when(c(value).isNull(), "not measured").otherwise(F.format_string(unit, c(value)))
    fps = F.coalesce("fps", F.lit(0.0))
    return {
        "output exists and probes": (always, c("video").isNotNull(), F.coalesce("video", F.lit("no video stream"))),
        "duration drift": (always, duration_ok(c("source_s"), c("output_s")), F.format_string("source %.3fs, output %.3fs, drift %.3fs", "source_s", "output_s", F.abs(c("output_s") - c("source_s")))),
        "resolution matches the plan": (always, (c("w") == c("planned_w")) & (c("h") == c("planned_h")), F.concat(F.format_string("planned %dx%d, got ", "planned_w", "planned_h"), size)),
        "audio tracks preserved": (always, out_tracks >= expected, F.format_string("expected at least %d, found %d", expected, out_tracks)),
        "original audio present": (c("keep_original"), codecs_kept(c("source_codecs"), c("output_codecs")), F.concat(F.lit("source codecs "), F.array_join("source_codecs", ", "))),
        "subtitles preserved": kept("subtitles"),
        "chapters preserved": kept("chapters"),
        "attachments preserved": kept("attachments"),
        "frame rate matches the plan": (c("interpolated"), F.abs(fps - c("planned_fps")) <= F.greatest(c("planned_fps") * 0.01, F.lit(0.05)), F.format_string("planned %.3f fps, got %.3f fps", c("planned_fps"), fps)),
        "true peak within target": (measured & c("measure_error").isNull(), F.coalesce(c("true_peak") <= c("peak_target") + 0.2, always), found("true_peak", "%.2f dBTP")),
        "integrated loudness within 1 LU of target": (measured & c("measure_error").isNull(), F.coalesce(F.abs(c("loudness") - c("loudness_target")) <= 1.0, always), found("loudness", "%.1f LUFS")),
        "loudness verification": (measured & c("measure_error").isNotNull(), always, F.concat(F.lit("not measured: "), c("measure_error"))),
    }


def check_summary(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("all_passed"))


def codecs_kept(source: Column, output: Column) -> Column:
    """Every source codec is in the output."""
    return F.size(F.array_except(source, output)) == 0


def job_progress(done_us: Column, frames: Column, total_s: Column, total_frames: Column, speed: Column) -> tuple[Column, Column]:
    """(fraction, eta seconds): by time first, by frames second; an eta needs a speed over 0.01."""
    by_time = F.when((total_s > 0) & done_us.isNotNull(), done_us / 1e6 / F.nullif(total_s, F.lit(0.0)))
    by_frames = F.when((total_frames > 0) & frames.isNotNull(), frames / F.nullif(total_frames, F.lit(0).cast("long")))
    fraction = F.least(F.greatest(F.coalesce(by_time, by_frames), F.lit(0.0)), F.lit(1.0))
    eta = F.when((speed > 0.01) & by_time.isNotNull(), F.greatest(total_s - done_us / 1e6, F.lit(0.0)) / speed)
    return fraction, eta


def audio_plan(apply_: Column, gain_db: Column, duck_db: Column, reason: Column, keep_original: Column, tracks: Column) -> Column:
    """The audio part of a plan: what is done and how many tracks come out."""
    out = F.when(tracks == 0, 0).otherwise(F.when(keep_original, tracks + 1).otherwise(1))
    return F.struct(F.coalesce(apply_, F.lit(False)).alias("remaster"), gain_db.alias("gain_db"), duck_db.alias("duck_db"), reason.alias("reason"), out.cast("int").alias("tracks"))


def assemble_plan(cadences: DataFrame, shapes: DataFrame, audio: DataFrame, key: str = "file") -> DataFrame:
    """(key, plan, warnings): cadence, geometry, audio and the frame estimate as one nested document.

    cadences has mode, chain, confidence, fps_num, fps_den; shapes target_w, target_h, source_frames,
    multiplier; audio the struct ``audio``. A key without audio keeps a NULL there and a warning.
    """
    t = cadences.join(shapes, key).join(audio, key, "left")
    dropped = F.col("mode") == "telecine"
    decoded = F.when(dropped, F.call_function("div", F.col("source_frames") * 4, F.lit(5).cast("long"))).otherwise(F.col("source_frames"))
    estimate = F.when(decoded > 0, F.col("multiplier") * (decoded - 1) + 1).otherwise(F.lit(0).cast("long"))
    warnings = F.array(F.when(F.col("audio").isNull(), "no audio"), F.when(F.col("confidence") < 0.5, "cadence unsure"), F.when(F.col("target_h") > 2160, "large canvas"))
    plan = F.struct("mode", "chain", F.struct("target_w", "target_h").alias("raster"), decoded.alias("decoded_frames"), estimate.alias("output_frames"), "audio")
    return t.select(key, plan.alias("plan"), F.array_compact(warnings).alias("warnings"))
