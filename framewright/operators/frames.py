"""Frame-series analytics: rasters, frame differences, cut detection, shots, grain, resampling and warps.

A raster is (stream_id, frame_idx, w, h, data) with row-major 8-bit values. Per-frame measures are
array expressions; the cut detector is an ordered fold per stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 32


def _div(a: Column, n: Column | int) -> Column:
    return F.call_function("div", a.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def histogram(data: Column) -> Column:
    """32 normalised bins of an 8-bit array, counted in one pass over the pixels."""
    zero = F.array_repeat(F.lit(0), BINS)
    sorted_bins = F.transform(data, lambda p: F.floor(p * BINS / 256).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter(sorted_bins, lambda p: p == b)) / F.size(data))
    return F.when(F.size(data) > 0, counts).otherwise(F.transform(zero, lambda x: x.cast("double")))


def mean_luma(data: Column) -> Column:
    return F.aggregate(data, F.lit(0).cast("long"), lambda s, p: s + p) / F.size(data)


def edge_map(data: Column, w: Column, h: Column, threshold: int = 24, wraps: bool = True) -> Column:
    """1 where the sum of absolute central differences reaches the threshold, border 0; the sum is
    taken modulo 256 as an 8-bit value would (``wraps``), which hides gradients of 256 and a little more."""
    at = lambda i: F.element_at(data, (i + 1).cast("int"))

    def cell(i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        inside = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
        g = F.abs(at(i + 1) - at(i - 1)) + F.abs(at(i + w) - at(i - w))
        return F.when(inside, ((g % 256 if wraps else g) >= threshold).cast("int")).otherwise(0)

    cells = F.transform(F.sequence(F.lit(0), F.size(data) - 1), cell)
    return F.when((w >= 3) & (h >= 3), cells).otherwise(F.transform(data, lambda _: F.lit(0)))


def _distance(a: Column, b: Column, pair) -> Column:
    total = F.aggregate(F.zip_with(a, b, pair), F.lit(0.0), lambda s, x: s + x)
    return total


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference; 0 for rasters of different size."""
    return F.when(F.size(a) == F.size(b), _distance(a, b, lambda x, y: F.abs(x - y).cast("double")) / F.size(a)).otherwise(0.0)


def histogram_distance(a: Column, b: Column) -> Column:
    return F.least(F.greatest(_distance(a, b, lambda x, y: F.abs(x - y)) / 2, F.lit(0.0)), F.lit(1.0))


def edge_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _distance(a, b, lambda x, y: (x != y).cast("double")) / F.size(a)).otherwise(0.0)


def score(hist: Column, edge: Column, mad: Column) -> Column:
    return F.least(F.greatest(hist * 0.5 + F.least(edge, F.lit(0.5)) * 0.4 + mad / 255 * 0.6, F.lit(0.0)), F.lit(1.0))


def frame_diffs(frames: DataFrame, edge_reference: str = "first") -> DataFrame:
    """Each frame against the one before it; the edge signal against the stream's first frame, as the
    original's state holds it, or the previous one (``edge_reference='previous'``)."""
    w = Window.partitionBy("stream_id").orderBy("frame_idx")
    t = frames.withColumns({"hist": histogram(F.col("data")), "edges": edge_map(F.col("data"), F.col("w"), F.col("h")), "luma": mean_luma(F.col("data"))})
    reference = F.first("edges").over(w) if edge_reference == "first" else F.lag("edges").over(w)
    t = t.withColumns({"p_hist": F.lag("hist").over(w), "p_data": F.lag("data").over(w), "p_edges": reference, "k": F.row_number().over(w)})
    first = F.col("k") == 1
    t = t.withColumns(
        {
            "histogram": F.when(first, 0.0).otherwise(histogram_distance(F.col("p_hist"), F.col("hist"))),
            "edge": F.when(first, 0.0).otherwise(edge_distance(F.col("p_edges"), F.col("edges"))),
            "mad": F.when(first, 0.0).otherwise(mean_abs_diff(F.col("p_data"), F.col("data"))),
        }
    )
    return t.select("stream_id", "frame_idx", "luma", "histogram", "edge", "mad", score(F.col("histogram"), F.col("edge"), F.col("mad")).alias("score"))


@dataclass(frozen=True)
class SceneOptions:
    min_shot: int = 6
    hard: float = 0.52
    mad: float = 12.0
    window: int = 24
    k: float = 6.0
    floor: float = 0.18
    edge_threshold: int = 24
    dissolve_run: int = 4
    dissolve_level: float = 0.35


@dataclass
class _View:
    """A raster with its measures."""

    data: np.ndarray
    hist: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(data: np.ndarray, w: int, h: int, threshold: int) -> _View:
        a = data.reshape(h, w).astype(np.int32)
        edges = np.zeros((h, w), bool)
        if w >= 3 and h >= 3:
            g = np.abs(a[1:-1, 2:] - a[1:-1, :-2]) + np.abs(a[2:, 1:-1] - a[:-2, 1:-1])
            edges[1:-1, 1:-1] = g % 256 >= threshold
        return _View(a.ravel(), np.bincount(a.ravel() * BINS // 256, minlength=BINS) / max(1, a.size), edges.ravel())

    def apart(self, other: _View) -> tuple[float, float]:
        """(histogram distance, mean absolute difference)."""
        mad = float(np.abs(self.data - other.data).mean()) if self.data.size == other.data.size and self.data.size else 0.0
        return min(float(np.abs(self.hist - other.hist).sum()) / 2, 1.0), mad


@dataclass
class CutDetector:
    """Ordered fold over a stream's frames. A frame that differs enough becomes a candidate; the
    next frame confirms it by differing from the frame before the candidate too, or shows that it
    was a flash, after which comparison goes on from the frame before the flash."""

    options: SceneOptions = field(default_factory=SceneOptions)
    cuts: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.index, self.since, self.elevated = 0, None, 0
        self.kept: _View | None = None
        self.edges: np.ndarray | None = None
        self.waiting: tuple | None = None
        self.scores: deque = deque(maxlen=self.options.window)

    def threshold(self) -> float:
        o = self.options
        if len(self.scores) < 4:
            return o.hard
        s = np.sort(np.array(self.scores))
        middle = s[len(s) // 2]
        spread = np.sort(np.abs(s - middle))[len(s) // 2]
        return max(float(middle + o.k * spread), o.floor)

    def push(self, frame: _View) -> dict:
        o, index = self.options, self.index
        self.index += 1
        flash, confirmed = False, False
        base, base_edges = self.kept, self.edges
        if self.waiting is not None:
            at, value, slow, before = self.waiting
            self.waiting = None
            hist, mad = before.apart(frame)
            if mad >= o.mad or hist >= o.hard * 0.6:
                self.cuts.append((at, value, slow))
                self.since, self.elevated, confirmed = 0, 0, True
                self.scores.clear()
            else:
                flash, base, base_edges = True, before, before.edges
        hist = edge = mad = 0.0
        limit = o.hard
        if base is not None:
            hist, mad = base.apart(frame)
            edge = float((base_edges != frame.edges).mean()) if base_edges.size == frame.edges.size else 0.0
            limit = self.threshold()
        value = min(max(0.5 * hist + 0.4 * min(edge, 0.5) + 0.6 * mad / 255, 0.0), 1.0)
        apart = mad >= o.mad and (hist >= o.hard or value >= limit)
        if apart and self.kept is not None and (self.since is None or self.since >= o.min_shot):
            self.waiting = (index, value, self.elevated >= o.dissolve_run, self.kept)
        else:
            self.since = None if self.since is None else self.since + 1
            self.elevated = self.elevated + 1 if value >= limit * o.dissolve_level else 0
            self.scores.append(value)
        if flash:
            self.kept, self.edges = base, base.edges
        else:
            self.kept, self.edges = frame, frame.edges if self.edges is None else self.edges
        return {"frame_idx": index, "confirmed": confirmed, "score": value, "threshold": limit}


def detect_cuts(frames: DataFrame, options: SceneOptions = SceneOptions()) -> DataFrame:
    """(stream_id, cut_idx, score, dissolve): confirmed cuts per stream, by the place of their frame in it.

    Frames stream through in order; a task holds one batch and the few rasters that comparisons go back to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, detector = None, CutDetector(options)
        for batch in batches:
            found: list[tuple] = []
            streams, widths, heights = (batch.column(i).to_pylist() for i in (0, 2, 3))
            data, offsets = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k, (own, w, h) in enumerate(zip(streams, widths, heights)):
                if own != stream:
                    stream, detector = own, CutDetector(options)
                detector.push(_View.of(data[offsets[k] : offsets[k + 1]], w, h, options.edge_threshold))
                found += [(own, *cut) for cut in detector.cuts]
                detector.cuts.clear()
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["stream_id", "cut_idx", "score", "dissolve"])

    rows = frames.select(F.col("stream_id").cast("long"), "frame_idx", F.col("w").cast("int"), F.col("h").cast("int"), F.col("data").cast("array<int>"))
    rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "frame_idx")
    return rows.mapInArrow(run, "stream_id long, cut_idx long, score double, dissolve boolean")


def build_shots(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """Contiguous shots from cuts (stream_id, cut_idx, score, dissolve) and totals (stream_id, total).

    Cuts at 0 or repeated are skipped; the last shot ends at the total, one frame at least.
    """
    real = cuts.filter("cut_idx > 0").groupBy("stream_id", "cut_idx").agg(F.min(F.struct("score", "dissolve")).alias("c"))
    marks = real.select("stream_id", F.col("cut_idx").alias("start_frame"), F.when(F.col("c.dissolve"), "dissolve").otherwise("cut").alias("kind"), F.col("c.score").alias("cut_score"))
    marks = marks.unionByName(totals.select("stream_id", F.lit(0).cast("long").alias("start_frame"), F.lit("start").alias("kind"), F.lit(None).cast("double").alias("cut_score")))
    w = Window.partitionBy("stream_id").orderBy("start_frame")
    ends = F.coalesce(F.lead("start_frame").over(w), F.greatest(F.col("total"), F.col("start_frame") + 1))
    return marks.join(totals, "stream_id").select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("shot"), "start_frame", ends.alias("end_frame"), "kind", "cut_score")


def shot_of(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """As-of lookup: each (stream_id, frame_idx) with the last shot that starts at or before it. A union and
    a running last, so nothing is compared with every shot."""
    both = frames.select("stream_id", "frame_idx", F.lit(1).alias("is_frame"), F.lit(None).cast("long").alias("s")).unionByName(
        shots.select("stream_id", F.col("start_frame").alias("frame_idx"), F.lit(0).alias("is_frame"), F.col("shot").alias("s"))
    )
    w = Window.partitionBy("stream_id").orderBy("frame_idx", "is_frame").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shot", F.coalesce(F.last("s", ignorenulls=True).over(w), F.lit(0).cast("long"))).filter("is_frame = 1").select("stream_id", "frame_idx", "shot")


def shot_statistics(shots: DataFrame, fps: float) -> DataFrame:
    """Cuts and the upper median of shot seconds per stream."""
    lengths = shots.groupBy("stream_id", (F.col("end_frame") - F.col("start_frame")).alias("frames")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("stream_id").orderBy("frames").rowsBetween(Window.unboundedPreceding, 0)
    t = lengths.withColumn("upto", F.sum("n").over(upto)).join(shots.groupBy("stream_id").agg(F.count("*").alias("all")), "stream_id")
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("frames")))
    return t.groupBy("stream_id", "all").agg((middle / fps).alias("median_seconds")).select("stream_id", (F.col("all") - 1).alias("cuts"), "median_seconds")


def frame_times(frames: DataFrame, pts: DataFrame, fps: float) -> DataFrame:
    """A frame's real time where a stream has times for all its frames, else index / fps."""
    n = frames.groupBy("stream_id").agg(F.count("*").alias("n"))
    have = pts.groupBy("stream_id").agg(F.count("*").alias("m"))
    full = n.join(have, "stream_id", "left").select("stream_id", (F.coalesce("m", F.lit(0)) >= F.col("n")).alias("full"))
    t = frames.select("stream_id", "frame_idx").join(full, "stream_id").join(pts, ["stream_id", "frame_idx"], "left")
    return t.select("stream_id", "frame_idx", F.when(F.col("full") & F.col("pts_time").isNotNull(), F.col("pts_time")).otherwise(F.col("frame_idx") / fps).alias("seconds"))


def analysis_size(w: Column, h: Column, width: int = 160) -> tuple[Column, Column]:
    """Analysis raster: fixed width, height by aspect, at least 2 and even."""
    raw = F.greatest(F.round(F.lit(width) * h / F.greatest(w, F.lit(1))), F.lit(2.0)).cast("long")
    return F.lit(width).cast("long"), raw + raw % 2


def laplacian(data: Column, w: Column, h: Column) -> Column:
    """4-neighbour Laplacian of the interior."""
    at = lambda i: F.element_at(data, (i + 1).cast("int"))
    inside = F.filter(F.sequence(F.lit(0), F.size(data) - 1), lambda i: (i % w > 0) & (i % w < w - 1) & (i >= w) & (i < w * (h - 1)))
    return F.transform(inside, lambda i: (at(i) * 4 - at(i - 1) - at(i + 1) - at(i - w) - at(i + w)) / 255.0)


def _median(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def grain_sigma(frames: DataFrame) -> DataFrame:
    """(.., sigma, samples, confidence) per raster: median absolute deviation of the Laplacian,
    x 1.4826 / sqrt(20); 0 with under 16 samples."""
    t = frames.withColumn("lap", laplacian(F.col("data"), F.col("w"), F.col("h"))).withColumn("m", _median(F.col("lap")))
    t = t.withColumns({"mad": _median(F.transform("lap", lambda x: F.abs(x - F.col("m")))), "samples": F.size("lap").cast("long")})
    enough = F.col("samples") >= 16
    return t.select("stream_id", "frame_idx", F.when(enough, F.col("mad") * 1.4826 / F.sqrt(F.lit(20.0))).otherwise(0.0).alias("sigma"), "samples", F.when(enough, F.least(F.col("samples") / 4096, F.lit(1.0))).otherwise(0.0).alias("confidence"))


def plane_grain(planes: DataFrame) -> DataFrame:
    """Planes (stream_id, frame_idx, sigma, samples, confidence) as frames: the mean sigma, all samples, the least
    confidence; zeros where no plane has samples."""
    some = F.sum("samples") > 0
    return planes.groupBy("stream_id", "frame_idx").agg(
        F.when(some, F.avg("sigma")).otherwise(0.0).alias("sigma"), F.sum("samples").alias("samples"), F.when(some, F.least(F.min("confidence"), F.lit(1.0))).otherwise(0.0).alias("confidence")
    )


def shot_grain(grain: DataFrame, keys: list[str]) -> DataFrame:
    """Median sigma, all samples, least confidence per shot."""
    return grain.groupBy(*keys).agg(F.median("sigma").alias("sigma"), F.sum("samples").alias("samples"), F.least(F.min("confidence"), F.lit(1.0)).alias("confidence"))


def strength(sigma: Column, confidence: Column) -> Column:
    return F.when((sigma > 0.0008) & (confidence > 0.2), F.least(F.greatest(sigma * 255 * 2.6, F.lit(1.0)), F.lit(30.0))).otherwise(0.0)


def sample_frames(shots: DataFrame, per_shot: int = 3) -> DataFrame:
    """Frames to measure per shot: fractions (s + .5) / k of the inner frames, offset 1, inside the shot."""
    n = F.col("end_frame") - F.col("start_frame")
    k = F.greatest(F.least(F.lit(per_shot).cast("long"), n), F.lit(1).cast("long"))
    t = shots.select("stream_id", "shot", "start_frame", "end_frame", n.alias("n"), k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("s"))
    inner = F.greatest(F.col("n") - 2, F.lit(0).cast("long"))
    at = F.col("start_frame") + 1 + F.floor((F.col("s") + 0.5) / F.col("k") * inner).cast("long")
    return t.select("stream_id", "shot", F.least(at, F.col("end_frame") - 1).alias("frame_idx")).distinct()


def lanczos_taps(src: int, dst: int, lobes: int = 3) -> pd.DataFrame:
    """(dst, src, weight): normalised taps, the kernel widened on downscale and indices clamped."""
    ratio = src / dst
    scale = max(ratio, 1.0)
    rows = []
    for i in range(dst):
        centre = (i + 0.5) * ratio - 0.5
        span = np.arange(int(np.floor(centre - lobes * scale)) + 1, int(np.floor(centre + lobes * scale)) + 1)
        x = (span - centre) / scale
        weight = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        rows += [(i, min(max(int(j), 0), src - 1), float(v / weight.sum())) for j, v in zip(span, weight) if v]
    return pd.DataFrame(rows, columns=["dst", "src", "weight"]).groupby(["dst", "src"], as_index=False).sum()


def resample(pixels: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    """(stream_id, frame_idx, x, y, value) resampled by two sparse products over the tap tables."""
    spark = pixels.sparkSession
    across, down = (F.broadcast(spark.createDataFrame(lanczos_taps(*d))) for d in ((w, to_w), (h, to_h)))
    first = pixels.join(across, pixels["x"] == across["src"]).groupBy("stream_id", "frame_idx", "y", F.col("dst").alias("x")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    second = first.join(down, first["y"] == down["src"]).groupBy("stream_id", "frame_idx", "x", F.col("dst").alias("y")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    return second.select("stream_id", "frame_idx", "x", "y", F.least(F.greatest(F.round(F.nanvl("value", F.lit(0.0))), F.lit(0.0)), F.lit(255.0)).cast("int").alias("value"))


def warp(pixels: DataFrame, flow: DataFrame, w: int, h: int) -> DataFrame:
    """Bilinear lookup at (x + dx, y + dy) with clamped corners: four equi-joins on pixel positions."""
    sx = F.least(F.greatest(F.col("x") + F.col("dx"), F.lit(0.0)), F.lit(w - 1.0))
    sy = F.least(F.greatest(F.col("y") + F.col("dy"), F.lit(0.0)), F.lit(h - 1.0))
    t = flow.withColumns({"sx": sx, "sy": sy}).withColumns({"x0": F.floor("sx").cast("int"), "y0": F.floor("sy").cast("int")})
    t = t.withColumns({"fx": F.col("sx") - F.col("x0"), "fy": F.col("sy") - F.col("y0")})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = t.withColumn("c", corner)
    weight = F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    t = t.select("stream_id", "frame_idx", "x", "y", weight.alias("weight"), F.least(F.col("x0") + F.col("c.i"), F.lit(w - 1)).alias("px"), F.least(F.col("y0") + F.col("c.j"), F.lit(h - 1)).alias("py"))
    source = pixels.select("stream_id", "frame_idx", F.col("x").alias("px"), F.col("y").alias("py"), "value")
    return t.join(source, ["stream_id", "frame_idx", "px", "py"]).groupBy("stream_id", "frame_idx", "x", "y").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
