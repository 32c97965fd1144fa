import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import audio as A
from framewright.sources import parsers as P
from framewright.streaming import jobs as J


def test_wav_round_trip(spark, tmp_path):
    x = np.arange(10, dtype=np.float32) / 7
    (tmp_path / "a.wav").write_bytes(P.write_wav(48000, 2, x))
    rate, channels, y = P.parse_wav((tmp_path / "a.wav").read_bytes())
    assert (rate, channels) == (48000, 2) and np.array_equal(x, y)
    rows = P.wav(spark.read.format("binaryFile").load(f"{tmp_path}/*.wav")).orderBy("frame_idx", "ch").collect()
    assert np.allclose([r.sample for r in rows], x) and rows[-1].frame_idx == 4


def test_other_wav_formats_are_refused():
    bad = bytearray(P.write_wav(8000, 1, np.zeros(2)))
    bad[20] = 1
    with pytest.raises(ValueError):
        P.parse_wav(bytes(bad))
    with pytest.raises(ValueError):
        P.parse_wav(b"RIFF")


def test_partial_records_end_a_raster_stream(spark, tmp_path):
    (tmp_path / "r.raw").write_bytes(bytes(range(14)))
    rows = P.rasters(spark.read.format("binaryFile").load(f"{tmp_path}/*.raw"), 3, 2).orderBy("frame_idx").collect()
    assert [list(r.data) for r in rows] == [list(range(6)), list(range(6, 12))]
    pcm = P.pcm(spark.read.format("binaryFile").load(f"{tmp_path}/*.raw"), 2).collect()
    assert len(pcm) == 2 and {r.frame_idx for r in pcm} == {0}


def test_publish_replaces(spark, tmp_path):
    dest = f"{tmp_path}/out"
    P.publish(spark.range(3), dest)
    P.publish(spark.range(5), dest)
    assert spark.read.parquet(dest).count() == 5


def test_loudness_log(spark):
    lines = ["t: 1 M: -20 I: -23.0 LUFS", "  Integrated loudness:", "    I:         -22.5 LUFS", "    Threshold: -32.9 LUFS", "  Loudness range:", "    LRA:         9.5 LU", "    Threshold: -42.5 LUFS", "    LRA low:   -28.0 LUFS", "    LRA high:  -18.5 LUFS", "    Peak:       -1.2 dBFS"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "source string, line_no long, line string")
    r = P.loudness_report(df).first()
    assert (r.integrated, r.threshold, r.lra, r.lra_low, r.lra_high, r.peak) == (-22.5, -42.5, 9.5, -28.0, -18.5, -1.2)


def hangover(raw, least, hold):
    out, run, left = [False] * len(raw), 0, 0
    for i, a in enumerate(raw):
        if a:
            run += 1
            if run >= least:
                out[i - run + 1 : i + 1] = [True] * run
                left = hold
        else:
            run = 0
            if left:
                out[i], left = True, left - 1
    return out


def test_hangover_against_a_walk(spark):
    rng = np.random.default_rng(3)
    masks = [rng.random(60) < p for p in (0.2, 0.5, 0.8, 0.0, 1.0, 0.4)]
    df = spark.createDataFrame([(s, i, bool(v)) for s, m in enumerate(masks) for i, v in enumerate(m)], "stream_id long, chunk_idx long, raw boolean")
    got = A.hangover(df, hold=4).orderBy("stream_id", "chunk_idx").collect()
    for s, m in enumerate(masks):
        assert [r.mask for r in got if r.stream_id == s] == hangover(m.tolist(), 3, 4)


def test_filters_pass_and_stop():
    t = np.arange(4800) / 48000
    low, high = np.sin(2 * np.pi * 100 * t), np.sin(2 * np.pi * 10000 * t)
    f = A.low_pass(48000, 1000)
    assert np.abs(f.run(low)[2400:]).max() > 0.95 and np.abs(f.run(high)[2400:]).max() < 0.05
    bands = A.three_bands(low + high, 48000, 300, 6000)
    assert np.abs(bands[1][2400:]).max() < 0.4
    left, right = A.mid_side(low, low, 48000, 2.0, 0.5)
    assert np.allclose(left, 2 * low) and np.allclose(left, right)


def test_throttle_stream(spark, tmp_path):
    data = [(1, t, i, False) for i, t in enumerate([0, 100, 250, 300, 460])] + [(1, 470, 5, True), (2, 10, 6, False)]
    schema = "key long, at_ms long, seq long, is_end boolean"
    df = spark.createDataFrame(data, schema)
    want = sorted((r.key, r.seq) for r in J.throttle(df, 200).collect())
    assert want == [(1, 0), (1, 2), (1, 4), (1, 5), (2, 6)]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = J.throttle_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 200).writeStream.format("memory").queryName("throttled").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted((r.key, r.seq) for r in spark.table("throttled").collect()) == want
    finally:
        q.stop()


def test_stage_store_recomputes_what_does_not_decode(spark, tmp_path):
    store, calls = J.StageStore(spark, f"{tmp_path}/stages"), []

    def produce():
        calls.append(1)
        return "42"

    assert store.run("j", "probe", produce, int) == 42 == store.run("j", "probe", produce, int) and len(calls) == 1
    store.commit("j", "probe", "done", "junk")
    assert store.run("j", "probe", produce, int) == 42 and len(calls) == 2


def test_log_sink_failures_do_not_raise():
    failures = []

    def broken(batch):
        raise OSError("full")

    J.log_sink(broken, failures)(None, 7)
    assert failures == ["7: full"]


def test_refusal_raises(spark):
    from framewright.plans.decisions import refuse

    df = spark.createDataFrame([(True, True)], "missing boolean, wanted boolean")
    with pytest.raises(Exception, match="restoration"):
        df.select(refuse(F.col("missing"), F.col("wanted"), "restoration")).collect()


def test_a_dead_subscriber_is_dropped():
    bus, seen = J.Bus(), []

    def dead(event):
        raise OSError

    bus.subscribe(dead)
    bus.subscribe(seen.append)
    assert bus.emit(1) == 1 and bus.finish("j", "boom") == "failed"
    assert seen == [1, {"kind": "finished", "job_id": "j", "state": "failed"}]


def test_a_missing_chunk_is_an_error(spark):
    from framewright.plans import segments as G

    planned = spark.createDataFrame([(1, 0), (1, 1)], "stream_id long, chunk long")
    files = spark.createDataFrame([(1, 0, "a")], "stream_id long, chunk long, path string")
    with pytest.raises(Exception, match="chunk 1 of stream 1 is missing"):
        G.require_chunks(planned, files).collect()


def test_a_missing_source_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        P.read_probes(spark, f"{tmp_path}/none").collect()


def test_filters_carry_their_state_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1000)
    for f in (*A.k_weighting(48000.0), A.low_pass(48000, 300), A.high_pass(48000, 6000)):
        want, _ = f._walk(x, 0.0, 0.0)
        out, state = [], (0.0, 0.0)
        for part in np.split(x, [1, 65, 66, 300, 555]):
            y, state = f.carry(part, state)
            out.append(y)
        assert np.allclose(np.concatenate(out), want, atol=1e-10)


def test_a_cancelled_job_stops(spark):
    import time

    failed = []

    def run():
        spark.sparkContext.setJobGroup("job-7", "a job that is cancelled", interruptOnCancel=True)
        try:
            spark.range(0, 1 << 42, 1, 4).selectExpr("sum(hash(id))").collect()
        except Exception as error:  # noqa: BLE001
            failed.append(str(error))

    from pyspark import InheritableThread

    worker = InheritableThread(target=run)
    worker.start()
    until = time.time() + 60
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("job-7") and time.time() < until:
        time.sleep(0.1)
    J.cancel(spark, "job-7")
    worker.join(60)
    assert not worker.is_alive() and failed and "cancel" in failed[0].lower()
