import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import media as op


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=900))
def test_round_trip(text):
    kept = op.stored(text)
    size, payload = op.payload_of(text)
    assert kept["back"] == payload and len(payload) % 192 == 0 and kept["n_bytes"] == len(text.encode())


@pytest.mark.parametrize("size", [0, 191, 192, 193, 3072, 3073, 100_000])
def test_sizes(size):
    text = "".join(chr(32 + i * i % 95) for i in range(size))
    assert op.stored(text)["back"] == op.payload_of(text)[1]


def slow_frame(frame):
    """Reads one lossless JPEG bit by bit, as the format's text has it."""
    height, width, tables, at = op.read_markers(frame)
    codes = {(code, length): value for code, length, value in op.codes_of(*tables[0])}
    data = frame[at:-2].replace(b"\xff\x00", b"\xff")
    bits = iter(np.unpackbits(np.frombuffer(data, np.uint8)).tolist())
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            code = length = 0
            while (code, length) not in codes:
                code, length = code << 1 | next(bits), length + 1
            n = codes[code, length]
            value = 0
            for _ in range(n):
                value = value << 1 | next(bits)
            step = value if not n or value >> n - 1 else value - (1 << n) + 1
            before = out[y, x - 1] if x else out[y - 1, 0] if y else 128
            out[y, x] = before + step
    return out


def test_frames_by_the_format(rng=np.random.default_rng(0)):
    samples = rng.integers(0, 256, (2, 6, 64)).astype(np.uint8)
    samples[1] = 255
    frames = [op.jpeg_head(64, 6) + c + b"\xff\xd9" for c in op.code_frames(samples)]
    for frame, sample in zip(frames, samples):
        assert (slow_frame(frame) == sample).all()
    assert (op.decode_frames(frames) == samples).all()


def test_riff_index():
    data = op.write_avi(b"x" * 9216)
    groups, length, seconds = op.read_avi(data)
    frames = np.concatenate(list(groups))
    assert data[:4] == b"RIFF" and data[8:12] == b"AVI " and frames.shape == (3, 48, 64) and length == 9216 and seconds == 0.04


def test_shots():
    dark, light = np.full((20, 48, 64), 40, np.uint8), np.full((15, 48, 64), 200, np.uint8)
    assert op.shots(op.histograms(np.concatenate((dark, light, dark)))) == [(0, 20), (20, 35), (35, 55)]
    assert op.shots(op.histograms(dark[:1])) == [(0, 1)]


def test_first_change_counts():
    dark, light = np.full((1, 48, 64), 40, np.uint8), np.full((20, 48, 64), 200, np.uint8)
    assert op.shots(op.histograms(np.concatenate((dark, light)))) == [(0, 1), (1, 21)]
    assert op.shots(op.histograms(np.concatenate((dark, light[:1])))) == [(0, 1), (1, 2)]


def test_groups_of_frames_make_the_whole(monkeypatch):
    text = "".join(chr(33 + i * i * 31 % 90) for i in range(200_000))
    whole = op.digests(text)
    monkeypatch.setattr(op, "GROUP", 7)
    assert op.digests(text) == whole


def test_memory_is_a_few_times_the_text():
    text = "word and more " * 400_000
    tracemalloc.start()
    op.digests(text)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    tracemalloc.stop()


def test_query(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (None, "", "x"), (3, "abc", "x"), (4, "é" * 90_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, feature string")
    got = {r.doc_id: r for r in op.media(df).collect()}
    assert got[1][1:] == got[3][1:] and got[2][1:] == got[None][1:]
    blank = b" " * 192
    assert (got[2].n_bytes, got[2].payload_bytes, got[2].payload_sha256) == (0, 192, hashlib.sha256(blank).hexdigest())
    assert got[2].tail_crc32 == zlib.crc32(blank[-16:]) and got[4].payload_bytes == 180_096
    file = op.files(df.filter("doc_id = 1")).first().avi
    assert hashlib.sha256(bytes(file)).hexdigest() == got[1].media_sha256 and len(file) == got[1].media_bytes
    assert op.clips(df).filter("doc_id = 4").count() >= 1
    assert op.media(df.limit(0)).count() == 0
