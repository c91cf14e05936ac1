"""Recordings read by byte ranges, and frames across the borders of chunks, against the recording in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.operators import signal
from pagetrail.sources import wav

SIZE, HOP, RATE = 512, 256, 8000


def sound(n, seed=1):
    r = np.random.default_rng(seed)
    return np.clip(r.normal(0, 0.2, n) * np.sin(np.arange(n) / 700), -1, 0.99)


def whole(data):
    rate, x = signal.wav_samples(data)
    f = signal.features(x, rate, size=SIZE, hop=HOP, most=10**9)
    return [(i, *(float(f[k][i]) for k in ("rms", "zcr", "centroid", "flux"))) for i in range(len(f["rms"]))]


def of(frames, name):
    rows = frames.where(F.col("recording").endswith(name)).orderBy("frame").collect()
    return [(r.frame, r.rms, r.zcr, r.centroid, r.flux) for r in rows]


@pytest.fixture
def folder(tmp_path):
    for name, n in (("long", 60_013), ("exact", 8 * HOP * 15), ("short", 100), ("empty", 0)):
        (tmp_path / f"{name}.wav").write_bytes(signal.wav_bytes(sound(n, n + 1), RATE))
    (tmp_path / "broken.wav").write_bytes(b"RIFF but nothing else")
    data = (tmp_path / "long.wav").read_bytes()
    extra = b"LIST" + (5).to_bytes(4, "little") + b"words\0"
    (tmp_path / "chunked.wav").write_bytes(data[:12] + extra + data[12:])
    return tmp_path


@pytest.mark.parametrize("range_bytes", [7_001, 1 << 20])
@pytest.mark.parametrize("prefix", ["", "file://"])
def test_frames_of_ranges_are_those_of_the_whole(spark, folder, range_bytes, prefix):
    chunks = wav.read_wav_ranges(spark, prefix + str(folder), chunk_sec=0.5, size=SIZE, hop=HOP, range_bytes=range_bytes)
    if range_bytes < 10_000:
        assert chunks.rdd.getNumPartitions() > 40
    frames = signal.recording_frames(chunks, size=SIZE, hop=HOP).cache()
    for name in ("long", "exact", "short", "chunked"):
        got, want = of(frames, f"{name}.wav"), whole((folder / f"{name}.wav").read_bytes())
        assert len(got) == len(want) > 0
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    assert frames.where(F.col("recording").rlike("empty|broken")).count() == 0


def test_samples_without_overlap(spark, folder):
    rows = wav.read_wav_ranges(spark, str(folder / "long.wav"), chunk_sec=0.3, range_bytes=5_000).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(len(rows)))
    assert all(len(r.samples) == r.own and r.skip == 0 for r in rows)
    _, x = signal.wav_samples((folder / "long.wav").read_bytes())
    assert np.array_equal(np.concatenate([r.samples for r in rows]).astype(np.float32), x)


def test_rows_that_hold_whole_files(spark, folder):
    files = spark.createDataFrame([(p.name, p.read_bytes()) for p in folder.iterdir()], "recording string, content binary")
    frames = signal.recording_frames(signal.overlapped_wavs(files, chunk_sec=0.5, size=SIZE, hop=HOP), size=SIZE, hop=HOP)
    assert np.allclose(of(frames, "long.wav"), whole((folder / "long.wav").read_bytes()))


def test_no_such_file(spark, folder):
    with pytest.raises(Exception, match="nothing.wav"):
        wav.read_wav_ranges(spark, str(folder / "nothing.wav")).count()
