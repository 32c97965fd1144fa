import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import frames as V
from framewright.plans import segment_queries
from framewright.plans import segments as G


def run(levels, size=8):
    detector = V.CutDetector()
    rng = np.random.default_rng(1)
    for level in levels:
        noise = rng.integers(0, 3, size * size)
        detector.push(V._View.of(np.clip(np.full(size * size, level) + noise, 0, 255).astype(np.int32), size, size, 24))
    return [c[0] for c in detector.cuts]


def test_a_hard_cut_is_found():
    assert run([20] * 12 + [200] * 12) == [12]


def test_a_flash_is_not_a_cut():
    assert run([20] * 12 + [250] + [20] * 12) == []


def test_a_cut_too_soon_after_another_is_not_a_candidate():
    assert run([20] * 12 + [200] * 3 + [20] * 12) == [12]


def test_a_cut_after_a_flash():
    assert run([20] * 12 + [250] + [20] * 3 + [120] * 12) == [16]


def walk(frames, size, o=V.SceneOptions()):
    """Cuts by looking up distances between any two frames, for comparison."""
    n = len(frames)
    f = np.array(frames, float).reshape(n, size, size)
    bins = np.array([np.histogram(x, 32, (0, 256))[0] / x.size for x in f])
    g = np.zeros((n, size, size))
    g[:, 1:-1, 1:-1] = np.abs(f[:, 1:-1, 2:] - f[:, 1:-1, :-2]) + np.abs(f[:, 2:, 1:-1] - f[:, :-2, 1:-1])
    marks = g % 256 >= o.edge_threshold
    hist = lambda i, j: min(np.abs(bins[i] - bins[j]).sum() / 2, 1)
    mad = lambda i, j: np.abs(f[i] - f[j]).mean()
    cuts, history, open_, last, shot, run, edges = [], [], None, None, None, 0, None
    for i in range(n):
        flash = False
        if open_:
            at, value, slow, base = open_
            if mad(base, i) >= o.mad or hist(base, i) >= 0.6 * o.hard:
                cuts.append((at, value, slow))
                history, shot, run = [], 0, 0
            else:
                flash = True
        against, outline = (open_[3], open_[3]) if flash else (last, edges)
        open_ = None
        if against is None:
            value, limit, moved = 0.0, o.hard, False
        else:
            h, m = hist(against, i), mad(against, i)
            value = min(0.5 * h + 0.4 * min((marks[outline] != marks[i]).mean(), 0.5) + 0.6 * m / 255, 1)
            recent = sorted(history[-o.window :])
            limit = o.hard
            if len(recent) >= 4:
                middle = recent[len(recent) // 2]
                limit = max(middle + o.k * sorted(abs(x - middle) for x in recent)[len(recent) // 2], o.floor)
            moved = m >= o.mad and (h >= o.hard or value >= limit)
        if moved and last is not None and (shot is None or shot >= o.min_shot):
            open_ = (i, value, run >= o.dissolve_run, last)
        else:
            shot = None if shot is None else shot + 1
            run = run + 1 if value >= limit * o.dissolve_level else 0
            history.append(value)
        if flash:
            last = edges = against
        else:
            last, edges = i, i if edges is None else edges
    return cuts


@pytest.mark.parametrize("batch", [10_000, 7])
def test_cuts_against_a_walk(spark, batch):
    size, rng, streams = 6, np.random.default_rng(12), {}
    for s in range(8):
        level, frames = 60.0, []
        for _ in range(150):
            u = rng.random()
            level = rng.integers(0, 250) if u < 0.06 else level + rng.normal(0, 4) if u < 0.8 else level
            shown = rng.integers(0, 250) if rng.random() < 0.04 else level
            frames.append(np.clip(shown + rng.integers(-9, 10, size * size) * (s % 3), 0, 255).astype(int).tolist())
        streams[s] = frames
    rows = [(s, i, size, size, d) for s, frames in streams.items() for i, d in enumerate(frames)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in V.detect_cuts(spark.createDataFrame(rows, "stream_id long, frame_idx long, w int, h int, data array<int>")).collect():
            got.setdefault(r.stream_id, []).append((r.cut_idx, round(r.score, 9), r.dissolve))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {s: [(int(i), round(float(v), 9), d) for i, v, d in walk(f, size)] for s, f in streams.items()}
    assert {s: sorted(c) for s, c in got.items()} == {s: c for s, c in want.items() if c} and sum(map(len, want.values())) > 20


def test_edges_wrap_like_bytes(spark):
    data = [0, 0, 0, 0, 0, 0, 0, 255, 0] + [0] * 0
    df = spark.createDataFrame([(data, 3, 3)], "data array<int>, w int, h int")
    assert df.select(V.edge_map(F.col("data"), F.col("w"), F.col("h"))).first()[0][4] == 1
    wrapped = [0, 0, 0, 0, 0, 10, 0, 250, 0]
    df = spark.createDataFrame([(wrapped, 3, 3)], "data array<int>, w int, h int")
    assert df.select(V.edge_map(F.col("data"), F.col("w"), F.col("h"))).first()[0][4] == 0
    assert df.select(V.edge_map(F.col("data"), F.col("w"), F.col("h"), wraps=False)).first()[0][4] == 1


def plan(n, allowed_cut, dissolves, m, window, guard=2):
    """Segments by walking the frames, for comparison."""
    starts = sorted({0, *allowed_cut, *dissolves})

    def shot(f):
        return max(i for i, s in enumerate(starts) if s <= f)

    def ok(p):
        return m > 1 and p + 1 < n and shot(p) == shot(p + 1) and not any(max(d - guard, 0) <= p < d + guard for d in dissolves)

    out, at = [], 0
    while at < n - 1:
        kind, end = ok(at), at + 1
        while end + 1 < n and ok(end) == kind and shot(end + 1) == shot(at) and (not kind or end - at + 2 < max(window, 2)):
            end += 1
        out.append(("synthesise" if kind else "hold", at, end))
        at = end
    return out or [("pass", 0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_segments_against_a_walk(spark, seed):
    rng = np.random.default_rng(seed)
    streams, cuts, want = [], [], {}
    window, m = [2, 3, 5, 2][seed], [2, 2, 3, 1][seed]
    for stream in range(12):
        n = int(rng.integers(1, 40))
        marks = sorted({int(x) for x in rng.integers(1, 40, 4) if x < n})
        slow = [bool(rng.integers(2)) for _ in marks]
        streams.append((stream, n))
        cuts += [(stream, c, 0.5, d) for c, d in zip(marks, slow)]
        want[stream] = plan(n, [c for c, d in zip(marks, slow) if not d], [c for c, d in zip(marks, slow) if d], m, window)
    shots = V.build_shots(spark.createDataFrame(cuts, "stream_id long, cut_idx long, score double, dissolve boolean"), spark.createDataFrame(streams, "stream_id long, total long"))
    segs = G.segments(shots, m, guard=2, window=window)
    got = {}
    for r in segs.orderBy("stream_id", "seq").collect():
        got.setdefault(r.stream_id, []).append((r.kind, r["first"], r["last"]))
    assert got == want
    assert all(r.exact for r in G.accounting(segs, shots, m).collect())


def test_lanczos_taps_sum_to_one():
    for src, dst in ((8, 12), (12, 5), (7, 7)):
        taps = V.lanczos_taps(src, dst)
        assert np.allclose(taps.groupby("dst").weight.sum(), 1.0)
        assert taps.src.between(0, src - 1).all()


def test_left_over_files_never_meet_a_long_streams_chunks(spark, monkeypatch):
    planned = spark.range(100_003).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("chunk"), G.chunk_path("/work", F.col("id")).alias("path"))
    monkeypatch.setattr(segment_queries, "chunks", lambda spark, sf_dir: planned)
    lines = segment_queries.concat_lists(spark, "").first().listing.split("\n")
    assert len(lines) == 100_003 and not any("left over" in x for x in lines) and lines[-1].endswith("chunk-100002.mkv'")


def test_padding_broadcasts_no_frames(spark, small):
    df = segment_queries.padding(spark, small)
    df.collect()
    assert "SortMergeJoin" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "BroadcastExchange" not in plan
