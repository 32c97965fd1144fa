"""Audio time-series analytics over (stream_id, frame_idx, ch, sample) rows.

Everything on the 10 ms grid is windows and aggregates; linear recurrences (filters) and nonlinear
folds (envelopes) run per (stream, channel) in order, over sorted Arrow batches with carried state.
Loudness that cannot be measured is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CHUNKS, HOP_CHUNKS, SHORT_TERM_CHUNKS = 40, 10, 300
ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, 10.0, -0.691
#: Samples that a filter takes at once.
FILTER_BLOCK = 64


@dataclass(frozen=True)
class Biquad:
    """Second-order section in transposed direct form II: y = b0 x + s1; s1 = b1 x - a1 y + s2; s2 = b2 x - a2 y."""

    b0: float
    b1: float
    b2: float
    a1: float
    a2: float

    def run(self, x: np.ndarray, state: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
        return self.carry(x, state)[0]

    def carry(self, x: np.ndarray, state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
        """(output, state after it), in blocks: what a block gives from rest and from its state are matrix
        products, and only the state steps from block to block."""
        n, whole = len(x), len(x) // FILTER_BLOCK
        out, state = np.empty(n), np.array(state)
        if whole:
            rest, free, turn, push = _block(self)
            blocks = x[: whole * FILTER_BLOCK].reshape(whole, FILTER_BLOCK)
            states, pushes = np.empty((whole, 2)), blocks @ push.T
            for k in range(whole):
                states[k] = state
                state = turn @ state + pushes[k]
            out[: whole * FILTER_BLOCK] = (blocks @ rest.T + states @ free.T).reshape(-1)
        out[whole * FILTER_BLOCK :], state = self._walk(x[whole * FILTER_BLOCK :], *state)
        return out, tuple(state)

    def _walk(self, x: np.ndarray, s1: float, s2: float) -> tuple[np.ndarray, tuple[float, float]]:
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y = self.b0 * v + s1
            s1 = self.b1 * v - self.a1 * y + s2
            s2 = self.b2 * v - self.a2 * y
            out[i] = y
        return out, (s1, s2)


@lru_cache(64)
def _block(f: Biquad) -> tuple[np.ndarray, ...]:
    """A block's matrices: output from input, output from state, state from state, state from input."""
    unit = np.eye(FILTER_BLOCK)
    impulses = [f._walk(row, 0.0, 0.0) for row in unit]
    free = [f._walk(np.zeros(FILTER_BLOCK), *s) for s in ((1.0, 0.0), (0.0, 1.0))]
    columns = lambda pairs, k: np.stack([np.asarray(p[k]) for p in pairs], 1)
    return columns(impulses, 0), columns(free, 0), columns(free, 1), columns(impulses, 1)


def _rbj(rate: float, freq: float, q: float, sign: int) -> Biquad:
    w0 = 2 * math.pi * min(max(freq / rate, 1e-6), 0.49)
    alpha, c = math.sin(w0) / (2 * q), math.cos(w0)
    a0, edge = 1 + alpha, 1 + sign * c
    return Biquad(edge / 2 / a0, -sign * edge / a0, edge / 2 / a0, -2 * c / a0, (1 - alpha) / a0)


def low_pass(rate: float, freq: float, q: float = math.sqrt(0.5)) -> Biquad:
    return _rbj(rate, freq, q, -1)


def high_pass(rate: float, freq: float, q: float = math.sqrt(0.5)) -> Biquad:
    return _rbj(rate, freq, q, 1)


def _k(rate: float, f0: float, q: float) -> tuple[float, float, float, float]:
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return k, a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0


def k_weighting(rate: float) -> tuple[Biquad, Biquad]:
    """The two stages of BS.1770 K-weighting: high shelf, then high pass (fixed values of the standard)."""
    q = 0.7071752369554196
    k, a0, a1, a2 = _k(rate, 1681.974450955533, q)
    vh = 10 ** (3.999843853973347 / 20)
    vb = vh**0.4996667741545416
    shelf = Biquad((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, a1, a2)
    _, _, a1, a2 = _k(rate, 38.13547087602444, 0.5003270373238773)
    return shelf, Biquad(1.0, -2.0, 1.0, a1, a2)


def cascade(x: np.ndarray, *sections: Biquad) -> np.ndarray:
    for section in sections:
        x = section.run(x)
    return x


def three_bands(x: np.ndarray, rate: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low, mid and high bands by fourth-order Linkwitz-Riley splits (two cascaded sections each way)."""
    rest = cascade(x, high_pass(rate, low), high_pass(rate, low))
    return (
        cascade(x, low_pass(rate, low), low_pass(rate, low)),
        cascade(rest, low_pass(rate, high), low_pass(rate, high)),
        cascade(rest, high_pass(rate, high), high_pass(rate, high)),
    )


def in_order(rows: DataFrame, keys: list[str], order: str, columns: list[str], names: list[str], fold: Callable) -> DataFrame:
    """Rows with the doubles ``names`` added by ``fold(arrays, state) -> (arrays, state)`` over the columns of each
    key's rows in order. Sorted batches stream through with the state carried, so no key has to fit in memory."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {n} double" for n in names)
    at, places = [rows.columns.index(k) for k in keys], [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(i).to_pylist() for i in at)))
            cuts = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1]), len(own)]
            arrays = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in places]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if own[a] != key:
                    key, state = own[a], None
                out, state = fold([x[a:b] for x in arrays], state)
                parts.append(out)
            added = [pa.array(np.concatenate(x), pa.float64()) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def filtered(samples: DataFrame, *sections: Biquad) -> DataFrame:
    """Samples with ``filtered`` added: the sections run over each (stream, channel) in frame order."""

    def fold(arrays: list[np.ndarray], states: list | None) -> tuple[list[np.ndarray], list]:
        x, after = arrays[0].astype(float), []
        for section, state in zip(sections, states or [(0.0, 0.0)] * len(sections)):
            x, state = section.carry(x, state)
            after.append(state)
        return [x], after

    return in_order(samples, ["stream_id", "ch"], "frame_idx", ["sample"], ["filtered"], fold)


def channel_weight(ch: Column, channels: Column, layout: Column) -> Column:
    """BS.1770 weight by channel index: fronts 1, LFE (index 3) 0, others 1.41, or 1 in 2.1 and quad layouts."""
    low = F.lower(F.coalesce(layout, F.lit("")))
    flat = low.contains("2.1") | low.contains("quad")
    return F.when(channels <= 2, 1.0).when(ch <= 2, 1.0).when(ch == 3, 0.0).when(flat, 1.0).otherwise(1.41)


def clean(sample: Column) -> Column:
    """0 where a sample is NaN or infinite."""
    return F.when(F.isnan(sample) | (F.abs(sample) == float("inf")), 0.0).otherwise(sample)


def is_broken(sample: Column) -> Column:
    return F.isnan(sample) | (F.abs(sample) == float("inf"))


def lufs(ms: Column) -> Column:
    """Loudness of a mean square; NULL where it is not positive."""
    return F.when(ms > 0, F.lit(OFFSET) + 10 * F.log10(ms))


def dbfs(peak: Column) -> Column:
    return F.when(peak > 0, 20 * F.log10(peak))


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def chunk_squares(samples: DataFrame, chunk_frames: int, layout: str = "", value: str = "sample") -> DataFrame:
    """(stream_id, chunk_idx, ms, broken, peak): weighted mean squares of whole chunks on the fixed grid."""
    v = clean(F.col(value))
    channels = F.max("ch").over(Window.partitionBy("stream_id")) + 1
    per = (
        samples.withColumns({"chunk_idx": F.call_function("div", F.col("frame_idx"), F.lit(chunk_frames).cast("long")), "channels": channels})
        .groupBy("stream_id", "chunk_idx", "ch", "channels")
        .agg(F.sum(v * v).alias("e"), F.count("*").alias("n"), F.sum(is_broken(F.col(value)).cast("int")).alias("broken"), F.max(F.abs(v)).alias("peak"))
    )
    weight = channel_weight(F.col("ch"), F.col("channels"), F.lit(layout))
    whole = per.groupBy("stream_id", "chunk_idx").agg(F.sum(F.col("e") / chunk_frames * weight).alias("ms"), F.min("n").alias("n"), F.sum("broken").alias("broken"), F.max("peak").alias("peak"))
    return whole.filter(F.col("n") == chunk_frames).drop("n")


def blocks(chunks: DataFrame, length: int = BLOCK_CHUNKS, hop: int = HOP_CHUNKS) -> DataFrame:
    """(stream_id, block_idx, ms): means over ``length`` chunks every ``hop``, complete ones only."""
    w = Window.partitionBy("stream_id").orderBy("chunk_idx")
    frame = w.rowsBetween(-(length - 1), 0)
    rows = chunks.select("stream_id", F.row_number().over(w).alias("k"), F.avg("ms").over(frame).alias("ms"))
    return rows.filter((F.col("k") >= length) & ((F.col("k") - length) % hop == 0)).select("stream_id", F.call_function("div", (F.col("k") - length).cast("long"), F.lit(hop).cast("long")).alias("block_idx"), "ms")


def gated_loudness(rows: DataFrame, key: str = "stream_id", ms: str = "ms") -> DataFrame:
    """(key, gated, n): two-stage gated loudness of mean squares per key; NULL where nothing passes."""
    above = rows.filter(lufs(F.col(ms)) > ABSOLUTE_GATE)
    w = Window.partitionBy(key)
    marked = above.withColumn("threshold", lufs(F.avg(ms).over(w)) - RELATIVE_GATE)
    passes = lufs(F.col(ms)) > F.col("threshold")
    found = marked.groupBy(key).agg(F.avg(F.when(passes, F.col(ms))).alias("second"), F.avg(ms).alias("first"), F.count("*").alias("n"))
    return found.select(key, lufs(F.coalesce("second", "first")).alias("gated"), "n")


def nearest(fraction: float) -> Callable[[Column], Column]:
    """The place of a nearest-rank percentile among n sorted values: round((n - 1) f), from 0."""
    return lambda n: F.round((n - 1) * F.lit(fraction)).cast("long")


def upper_median(n: Column) -> Column:
    """The place of the upper median among n sorted values: n div 2, from 0."""
    return F.call_function("div", n, F.lit(2).cast("long"))


def picked(rows: DataFrame, value: Column, key: str = "stream_id", **places: Callable[[Column], Column]) -> DataFrame:
    """(key, n, a column for each place): values of a key's sorted ones, NULLs left out. Rows are sorted and numbered, so
    that no array of a key's values is built."""
    t = rows.select(key, value.alias("v")).filter("v IS NOT NULL")
    t = t.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("v")) - 1).join(t.groupBy(key).agg(F.count("*").alias("n")), key)
    return t.groupBy(key, "n").agg(*[F.max(F.when(F.col("at") == place(F.col("n")), F.col("v"))).alias(name) for name, place in places.items()])


def loudness_range(chunks: DataFrame, window: int = SHORT_TERM_CHUNKS, hop: int = HOP_CHUNKS) -> DataFrame:
    """(stream_id, lra): P95 - P10 of short-term loudness above -70 and above its energy mean - 20; 0 with under two values."""
    short = blocks(chunks, window, hop).select("stream_id", lufs(F.col("ms")).alias("v")).filter(F.col("v") > ABSOLUTE_GATE)
    w = Window.partitionBy("stream_id")
    kept = short.withColumn("threshold", 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("v") / 10)).over(w)) - 20).filter("v > threshold")
    found = picked(kept, F.col("v"), high=nearest(0.95), low=nearest(0.10)).select("stream_id", F.when(F.col("n") >= 2, F.greatest(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(0.0).alias("lra"))
    return chunks.select("stream_id").distinct().join(found, "stream_id", "left").select("stream_id", F.coalesce("lra", F.lit(0.0)).alias("lra"))


def speech_threshold(levels: DataFrame, noise: float = 0.20, min_snr: float = 9.0, below_peak: float = 28.0) -> DataFrame:
    """Levels with floor (P20), p95, threshold = max(floor + 9, p95 - 28) and raw = level > threshold."""
    stats = picked(levels, F.col("level_db"), floor_db=nearest(noise), p95_db=nearest(0.95)).drop("n")
    stats = stats.withColumn("threshold_db", F.greatest(F.col("floor_db") + min_snr, F.col("p95_db") - below_peak))
    return levels.join(stats, "stream_id").withColumn("raw", F.col("level_db") > F.col("threshold_db"))


def hangover(rows: DataFrame, raw: str = "raw", min_speech: int = 3, hold: int = 20) -> DataFrame:
    """Rows with ``mask``: runs of at least ``min_speech`` are open from their start, and the next
    ``hold`` inactive chunks stay open; shorter runs neither open nor use up the hold."""
    w = Window.partitionBy("stream_id").orderBy("chunk_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    active = F.col(raw)
    t = rows.withColumn("h_run", F.sum((~active).cast("int")).over(upto))
    run = Window.partitionBy("stream_id", "h_run")
    t = t.withColumn("h_long", active & (F.sum(active.cast("int")).over(run) >= min_speech))
    t = t.withColumn("h_last", F.last(F.when(F.col("h_long"), F.col("h_run")), ignorenulls=True).over(upto))
    held = ~active & F.col("h_last").isNotNull() & (F.col("h_run") - F.col("h_last") <= hold)
    return t.withColumn("mask", F.col("h_long") | F.coalesce(held, F.lit(False))).drop("h_run", "h_long", "h_last")


def speech_levels(mono: DataFrame, rate: float, chunk_frames: int, low: float = 300.0, high: float = 3400.0) -> DataFrame:
    """(stream_id, chunk_idx, level_db): RMS of the speech band per chunk, -120 at least. A stream's last
    partial chunk counts if it has a quarter of a chunk. mono is (stream_id, ch, frame_idx, sample)."""
    band = filtered(mono, high_pass(rate, low), high_pass(rate, low), low_pass(rate, high), low_pass(rate, high))
    c = band.groupBy("stream_id", F.call_function("div", F.col("frame_idx"), F.lit(chunk_frames).cast("long")).alias("chunk_idx")).agg(F.avg(F.col("filtered") * F.col("filtered")).alias("ms"), F.count("*").alias("n"))
    level = F.greatest(F.coalesce(10 * F.log10(F.when(F.col("ms") > 0, F.col("ms"))), F.lit(-120.0)), F.lit(-120.0))
    return c.filter(F.col("n") >= chunk_frames // 4).select("stream_id", "chunk_idx", level.alias("level_db"))


def analysis_signal(samples: DataFrame) -> DataFrame:
    """(stream_id, ch, frame_idx, sample): the centre channel of streams with three or more, else the mean of the channels."""
    t = samples.groupBy("stream_id", "frame_idx").agg(F.max(F.when(F.col("ch") == 2, clean(F.col("sample")))).alias("centre"), F.avg(clean(F.col("sample"))).alias("mean"))
    return t.select("stream_id", F.lit(0).alias("ch"), "frame_idx", F.coalesce("centre", "mean").alias("sample"))


def cross_check(own: Column, other: Column, tolerance: float = 0.5) -> Column:
    """A note where two meters differ by more than the tolerance, else NULL."""
    return F.when(F.abs(own - other) > tolerance, F.format_string("meters differ by %.2f LU", F.abs(own - other)))


def smooth_mask(rows: DataFrame, width: int) -> DataFrame:
    """Trailing moving average of the mask (partial at the start)."""
    w = Window.partitionBy("stream_id").orderBy("chunk_idx").rowsBetween(-(width - 1), 0)
    return rows.withColumn("smooth", F.avg(F.col("mask").cast("int")).over(w))


def speech_blocks(block_rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Blocks of which at least 30 % of the chunks that exist are speech: chunks are dealt to the
    blocks that hold them (a fixed four each), not compared with all."""
    b = F.call_function("div", F.col("chunk_idx").cast("long"), F.lit(HOP_CHUNKS).cast("long"))
    held = mask.select("stream_id", "mask", F.explode(F.sequence(F.greatest(b - (BLOCK_CHUNKS // HOP_CHUNKS - 1), F.lit(0).cast("long")), b)).alias("block_idx"))
    share = held.groupBy("stream_id", "block_idx").agg(F.sum(F.col("mask").cast("int")).alias("speech"), F.count("*").alias("n"))
    return block_rows.join(share.filter(F.col("speech") * 10 >= F.col("n") * 3).select("stream_id", "block_idx"), ["stream_id", "block_idx"])


def dialogue_loudness(block_rows: DataFrame, mask: DataFrame) -> DataFrame:
    """(stream_id, dialogue): gated loudness of the speech blocks, where there are three at least."""
    picked = speech_blocks(block_rows, mask)
    enough = picked.groupBy("stream_id").agg(F.count("*").alias("picked")).filter("picked >= 3")
    return gated_loudness(picked.join(enough.select("stream_id"), "stream_id")).select("stream_id", F.col("gated").alias("dialogue"))


def track_summary(masked: DataFrame, min_snr: float = 9.0) -> DataFrame:
    """(stream_id, speech_ratio, median_snr, confidence, notes) of a masked level series."""
    t = masked.groupBy("stream_id").agg((F.sum(F.col("mask").cast("int")) / F.count("*")).alias("speech_ratio"))
    snr = picked(masked, F.when(F.col("mask"), F.col("level_db") - F.col("floor_db")), median_snr=upper_median).drop("n")
    t = t.join(snr, "stream_id", "left").select("stream_id", "speech_ratio", F.coalesce("median_snr", F.lit(0.0)).alias("median_snr"))
    base = F.least(F.greatest((F.col("median_snr") - min_snr) / 12, F.lit(0.0)), F.lit(1.0))
    by_ratio = F.when(F.col("speech_ratio") < 0.02, 0.0).when(F.col("speech_ratio") > 0.90, base * 0.5).otherwise(base)
    notes = F.array(
        F.when(F.col("speech_ratio") < 0.02, "no speech").when(F.col("speech_ratio") > 0.90, "nearly all speech"), F.when(F.col("median_snr") < min_snr, "speech close to the floor")
    )
    return t.withColumns({"confidence": F.when(F.col("median_snr") < min_snr, by_ratio * 0.5).otherwise(by_ratio), "notes": F.array_join(F.array_compact(notes), "; ")})


def decide(rows: DataFrame, anchor: float = -24.0, target: float = 5.0, up: float = 6.0, down: float = 3.0, duck_max: float = 4.0) -> DataFrame:
    """Remaster decision from programme, dialogue, confidence and speech_ratio columns."""
    p, d, c, r = (F.col(x) for x in ("programme", "dialogue", "confidence", "speech_ratio"))
    c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    ldr = p - d
    reason = (
        F.when(d.isNull(), "no measurable dialogue").when(r < 0.02, "virtually no dialogue").when(p.isNull(), "programme not measurable")
        .when(ldr <= target, "already within target").when(c < 0.5, "reduced correction").otherwise("above target")
    )
    apply_ = d.isNotNull() & (r >= 0.02) & p.isNotNull() & (ldr > target)
    gain = F.when(apply_, F.least(F.greatest(anchor - d, F.lit(-down)), F.lit(up)) * c).otherwise(0.0)
    duck = F.when(apply_, F.least(ldr - target, F.lit(duck_max)) * c).otherwise(0.0)
    return rows.withColumns(
        {"apply": F.coalesce(apply_, F.lit(False)), "ldr": ldr, "gain_db": F.coalesce(gain, F.lit(0.0)), "duck_db": F.coalesce(duck, F.lit(0.0)), "ldr_after": F.when(apply_, ldr - gain - duck / 2), "reason": reason}
    )


def envelope(targets: np.ndarray, block_ms: float = 10.0, attack_ms: float = 120.0, release_ms: float = 800.0, slew: float = 18.0, start: float | None = None) -> np.ndarray:
    """One-pole follower in dB with attack, release and a slew limit in dB a second."""
    coeff = lambda ms: 1.0 if ms <= 0 else 1 - math.exp(-block_ms / ms)
    attack, release, step = coeff(attack_ms), coeff(release_ms), slew * block_ms / 1000
    out, value = np.empty(len(targets)), start
    for i, t in enumerate(targets.tolist()):
        t = t if math.isfinite(t) else 0.0
        value = t if value is None else value + min(max((t - value) * (attack if t > value else release), -step), step)
        out[i] = value
    return out


def gain_curve(masked: DataFrame, decisions: DataFrame) -> DataFrame:
    """(stream_id, chunk_idx, gain_db, duck_db): two envelopes over the mask, from nothing."""
    rows = masked.join(decisions.select("stream_id", "apply", F.col("gain_db").alias("g"), F.col("duck_db").alias("d")), "stream_id")
    speech = F.col("mask") & F.col("apply")
    rows = rows.select("stream_id", "chunk_idx", F.when(speech, F.col("g")).otherwise(0.0).alias("g"), F.when(speech, F.col("d")).otherwise(0.0).alias("d"))

    def fold(arrays: list[np.ndarray], state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        out = [envelope(x, start=v) for x, v in zip(arrays, state or (0.0, 0.0))]
        return out, tuple(x[-1] for x in out)

    return in_order(rows, ["stream_id"], "chunk_idx", ["g", "d"], ["gain_db", "duck_db"], fold).select("stream_id", "chunk_idx", "gain_db", "duck_db")


def channel_plan(channels: Column, layout: Column) -> Column:
    """(strategy, roles) by channel count and layout name, in the usual order (FL FR FC LFE BL BR ..): ``mono``,
    ``mid/side``, ``centre``, or ``untouched`` where no centre is known, whose channels are all unknown."""
    name = F.lower(F.coalesce(layout, F.lit("")))
    has = lambda *words: _any([name.contains(w) for w in words])
    centre = (
        ((channels == 3) & ~has("2.1")) | ((channels == 4) & has("3.1", "lfe")) | (channels == 5) | ((channels == 6) & (has("5.1", "lfe") | (name == "")))
        | ((channels == 7) & has("6.1")) | ((channels == 8) & (has("7.1") | (name == "")))
    )
    strategy = F.when(channels == 1, "mono").when(channels == 2, "mid/side").when(centre, "centre").otherwise("untouched")
    role = lambda i: (
        F.when(strategy == "untouched", "unknown").when((strategy == "mono") | ((strategy == "centre") & (i == 2)), "dialogue").when(i < 2, "front")
        .when((i == 3) & (channels != 5), "lfe").otherwise("surround")
    )
    roles = F.when(channels > 0, F.transform(F.sequence(F.lit(0), F.greatest(channels, F.lit(1)) - 1), role)).otherwise(F.array().cast("array<string>"))
    return F.struct(strategy.alias("strategy"), roles.alias("roles"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def apply_gain(samples: DataFrame, curve: DataFrame, chunk_frames: int, plans: DataFrame, rate: float, low: float = 300.0, high: float = 6000.0) -> DataFrame:
    """(stream_id, frame_idx, ch, role, out) by each stream's ``plan`` (plans: stream_id, plan).

    Dialogue takes the gain. Front and surround channels lose (1 - duck) of their band where the duck is
    under 0.999; the band's filter runs over those samples only. In mid/side the gain goes to the mid and
    the side loses its band; a frame without its other channel is left alone. LFE, unknown and untouched
    channels stay. Chunks past the curve's end take 0 dB."""
    t = samples.withColumn("chunk_idx", F.call_function("div", F.col("frame_idx"), F.lit(chunk_frames).cast("long")))
    t = t.join(curve, ["stream_id", "chunk_idx"], "left").join(F.broadcast(plans), "stream_id")
    gain, duck = to_linear(F.coalesce(F.col("gain_db"), F.lit(0.0))), to_linear(-F.coalesce(F.col("duck_db"), F.lit(0.0)))
    role = F.coalesce(F.get(F.col("plan.roles"), F.col("ch").cast("int")), F.lit("unknown"))
    t = t.select("stream_id", "frame_idx", "ch", "sample", gain.alias("gain"), duck.alias("duck"), role.alias("role"), (F.col("plan.strategy") == "mid/side").alias("paired"))
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("sample")))
    pairs = t.filter("paired").groupBy("stream_id", "frame_idx").agg(of(0).alias("left"), of(1).alias("right"), F.first("gain").alias("gain"), F.first("duck").alias("duck"))
    pairs = pairs.withColumns({"mid": (F.col("left") + F.col("right")) / 2 * F.col("gain"), "side": (F.col("left") - F.col("right")) / 2})
    ducked = t.filter("NOT paired AND role IN ('front', 'surround') AND duck < 0.999").select("stream_id", F.col("ch").cast("int").alias("ch"), "frame_idx", "sample")
    sides = pairs.filter("side IS NOT NULL AND duck < 0.999").select("stream_id", F.lit(-1).alias("ch"), "frame_idx", F.col("side").alias("sample"))
    band = filtered(ducked.unionByName(sides), high_pass(rate, low), high_pass(rate, low), low_pass(rate, high), low_pass(rate, high))
    band = band.select("stream_id", "frame_idx", F.col("ch").alias("band_ch"), F.col("filtered").alias("band"))
    t = t.withColumn("band_ch", F.when(F.col("paired"), -1).otherwise(F.col("ch").cast("int"))).join(band, ["stream_id", "frame_idx", "band_ch"], "left")
    t = t.join(pairs.select("stream_id", "frame_idx", "mid", "side"), ["stream_id", "frame_idx"], "left")
    lost = F.coalesce(F.col("band") * (1 - F.col("duck")), F.lit(0.0))
    side = F.col("side") - lost
    out = (
        F.when(F.col("paired"), F.coalesce(F.when(F.col("ch") == 0, F.col("mid") + side).when(F.col("ch") == 1, F.col("mid") - side), F.col("sample")))
        .when(F.col("role") == "dialogue", F.col("sample") * F.col("gain")).otherwise(F.col("sample") - lost)
    )
    return t.select("stream_id", "frame_idx", "ch", "role", out.alias("out"))


def mid_side(left: np.ndarray, right: np.ndarray, rate: float, gain: float, duck: float, low: float = 300.0, high: float = 6000.0) -> tuple[np.ndarray, np.ndarray]:
    """Mid times the gain; the side loses (1 - duck) of its speech band where duck is under 0.999. For arrays; ``apply_gain`` does so for rows."""
    mid, side = (left + right) / 2 * gain, (left - right) / 2
    if duck < 0.999:
        side = side - three_bands(side, rate, low, high)[1] * (1 - duck)
    return mid + side, mid - side


def within(samples: DataFrame, declared: Column) -> tuple[DataFrame, DataFrame]:
    """Frames before the declared count, and per stream how many were dropped."""
    kept = samples.filter(F.col("frame_idx") < declared)
    return kept, samples.groupBy("stream_id").agg(F.sum((F.col("frame_idx") >= declared).cast("int")).alias("dropped"))


def final_gain(measured: Column, peak: Column, target: float = -19.0, target_peak: float = -1.5) -> tuple[Column, Column, Column]:
    """(gain in dB, whether a limiter is needed, the chain's text); gains under 0.05 dB are left out."""
    gain = F.lit(target) - measured
    limit = F.coalesce(peak + gain > target_peak, F.lit(False))
    parts = F.array(F.when(F.abs(gain) >= 0.05, F.concat(F.lit("volume="), F.format_string("%.2f", gain), F.lit("dB"))), F.when(limit, F.lit(f"alimiter=limit={target_peak:g}dB")))
    return gain, limit, F.array_join(F.array_compact(parts), ",")


def plausible_peak(peak: Column) -> Column:
    """True peaks in (-120, 6), else NULL."""
    return F.when((peak > -120) & (peak < 6), peak)
