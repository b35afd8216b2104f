"""Media columns: AVI motion-JPEG, stored losslessly, read back, and cut into shots.

A payload becomes grey frames, WIDTH wide; each frame is a lossless JPEG (the
format's sequential predictive mode, SOF3, 8-bit samples, left prediction), and
the frames an AVI file with a RIFF tree, a 'movi' list and an 'idx1' index.
The Huffman table gives a difference of k bits a code of 9 - k bits, so that
every sample takes just 9 bits: frames are coded and decoded by numpy as a
whole.  The last frame is filled up; a chunk 'plen' holds the payload's length.

Reading parses the RIFF tree, follows the index to the frames, reads each
frame's own markers, table and size, decodes it, and checks nothing else of
how it was written.  Shots: the difference of neighbouring frames' grey
histograms starts a new clip where it is over its running mean by DEVIATIONS
deviations over the last SPAN differences, so the threshold follows the
material (the first difference, which has none before it, is held against those
that follow).  clips() gives one timed row per clip.

Defined cases: null and empty texts are a payload of 192 blanks, one frame, one
clip; repeated rows and equal texts give equal values; other columns are not
touched; an empty table gives an empty result.  Frames are coded, decoded and
counted GROUP at a time, so memory is a few times one text and its stored form.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import whole_text

UNIT, WIDTH, HEIGHT, RATE = 192, 64, 48, 25
TONES, SPAN, DEVIATIONS, LEAST = 16, 12, 2.5, 0.15
TAIL, GROUP = 16, 256


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw.ljust(size, b" ")


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def jpeg_head(width: int, height: int) -> bytes:
    """Markers up to the samples.  Code lengths 1 to 9 stand for differences of 8 to 0 bits."""
    frame = marker(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    table = marker(0xC4, bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    return b"\xff\xd8" + frame + table + marker(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def codes_of(lengths: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(code, its length, value) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, number in enumerate(lengths, 1):
        for _ in range(number):
            out.append((code, length, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def difference_codes() -> np.ndarray:
    """9-bit code of each difference from -255 to 255, at difference + 255."""
    codes = {value: (code, length) for code, length, value in codes_of(bytes([1] * 9), bytes(range(8, -1, -1)))}
    table = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        bits = abs(d).bit_length()
        code, _ = codes[bits]
        table[d + 255] = code << bits | (d if d >= 0 else d + (1 << bits) - 1)
    return table


CODES = difference_codes()


def code_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded samples of frames (n, height, width)."""
    n, height, width = samples.shape
    wide = samples.astype(np.int16)
    step = np.empty_like(wide)
    step[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    step[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    step[:, 0, 0] = wide[:, 0, 0] - 128
    fields = CODES[step.reshape(-1, 8) + 255]
    word = fields[:, 7] >> np.uint64(8)
    for k in range(7):
        word = word | fields[:, k] << np.uint64(64 - 9 * (k + 1))
    packed = np.empty((len(fields), 9), np.uint8)
    packed[:, :8] = word.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = (fields[:, 7] & np.uint64(0xFF)).astype(np.uint8)
    size = height * width * 9 // 8
    flat = packed.tobytes()
    return [flat[i : i + size].replace(b"\xff", b"\xff\x00") for i in range(0, n * size, size)]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def listed(kind: bytes, *parts: bytes) -> bytes:
    return chunk(b"LIST", kind + b"".join(parts))


def write_avi(payload: bytes) -> bytes:
    height = min(HEIGHT, len(payload) // WIDTH)
    per = WIDTH * height
    count = -(-len(payload) // per)
    samples = np.frombuffer(payload.ljust(count * per, b"\0"), np.uint8).reshape(count, height, WIDTH)
    head = jpeg_head(WIDTH, height)
    frames = [head + coded + b"\xff\xd9" for k in range(0, count, GROUP) for coded in code_frames(samples[k : k + GROUP])]
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, count, 0, 1, max(map(len, frames)), WIDTH, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, count, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", per, 0, 0, 0, 0)
    header = listed(b"hdrl", chunk(b"avih", main), listed(b"strl", chunk(b"strh", stream), chunk(b"strf", picture)), chunk(b"plen", struct.pack("<Q", len(payload))))
    entries, body, at = [], [], 4
    for frame in frames:
        body += [struct.pack("<4sI", b"00dc", len(frame)), frame, b"\0" * (len(frame) % 2)]
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += 8 + len(frame) + len(frame) % 2
    index = chunk(b"idx1", b"".join(entries))
    return b"".join([b"RIFF", struct.pack("<I", 4 + len(header) + 8 + at + len(index)), b"AVI ", header, b"LIST", struct.pack("<I", at), b"movi", *body, index])


def riff(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places; lists are named by their kind."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        start, stop = at + 8, at + 8 + size
        if name in (b"LIST", b"RIFF"):
            name, start = data[start : start + 4], start + 4
        yield name, start, stop
        at = stop + size % 2


def read_markers(frame: bytes) -> tuple[int, int, dict[int, tuple[bytes, bytes]], int]:
    """Height, width, Huffman tables and the place of the samples."""
    at, height, width, tables = 2, 0, 0, {}
    while True:
        code, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
        elif code == 0xC4:
            tables[body[0]] = (body[1:17], body[17:])
        elif code == 0xDA:
            return height, width, tables, at


def differences(lengths: bytes, values: bytes) -> np.ndarray:
    """The difference of every 9-bit field, from a table whose codes and bits make 9 together."""
    table = np.zeros(512, np.int64)
    for code, length, bits in codes_of(lengths, values):
        if length + bits != 9:
            raise ValueError("a table of other lengths")
        for low in range(1 << bits):
            table[code << bits | low] = low if not bits or low >> bits - 1 else low - (1 << bits) + 1
    return table


def decode_frames(frames: list[bytes]) -> np.ndarray:
    height, width, tables, at = read_markers(frames[0])
    head = frames[0][:at]
    if any(not f.startswith(head) for f in frames):
        raise ValueError("frames of several kinds")
    coded = b"".join(f[at:-2].replace(b"\xff\x00", b"\xff") for f in frames)
    packed = np.frombuffer(coded, np.uint8).reshape(-1, 9)
    word = np.ascontiguousarray(packed[:, :8]).view(">u8").astype(np.uint64).ravel()
    fields = np.empty((len(packed), 8), np.int64)
    for k in range(7):
        fields[:, k] = (word >> np.uint64(64 - 9 * (k + 1)) & np.uint64(0x1FF)).astype(np.int64)
    fields[:, 7] = (word & np.uint64(1)).astype(np.int64) << 8 | packed[:, 8]
    step = differences(*tables[0])[fields].astype(np.int32).reshape(len(frames), height, width)
    step[:, :, 0] = np.cumsum(step[:, :, 0], axis=1) + 128
    return np.cumsum(step, axis=2, dtype=np.int32).astype(np.uint8)


def read_avi(data: bytes) -> tuple[Iterator[np.ndarray], int, float]:
    """Frames by groups, the payload's length and the seconds of a frame."""
    ((_, start, end),) = riff(data, 0, len(data))
    parts = {name: (a, b) for name, a, b in riff(data, start, end)}
    header = {name: (a, b) for name, a, b in riff(data, *parts[b"hdrl"])}
    seconds = struct.unpack_from("<I", data, header[b"avih"][0])[0] / 1e6
    length = struct.unpack_from("<Q", data, header[b"plen"][0])[0]
    base = parts[b"movi"][0] - 4

    def frames() -> Iterator[np.ndarray]:
        first, last = parts[b"idx1"]
        for at in range(first, last, 16 * GROUP):
            entries = [struct.unpack_from("<4sIII", data, k) for k in range(at, min(last, at + 16 * GROUP), 16)]
            yield decode_frames([data[base + offset + 8 : base + offset + 8 + size] for _, _, offset, size in entries])

    return frames(), length, seconds


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of the grey tones in each frame."""
    count = len(frames)
    tone = frames.reshape(count, -1) >> 4
    places = tone.astype(np.int32) + np.arange(count, dtype=np.int32)[:, None] * TONES
    return np.bincount(places.ravel(), minlength=count * TONES).reshape(count, TONES) / tone.shape[1]


def shots(histogram: np.ndarray) -> list[tuple[int, int]]:
    """Clips as (first frame, frame after the last)."""
    change = np.abs(np.diff(histogram, axis=0)).sum(1) / 2
    starts = [0]
    for i in range(len(change)):
        recent = change[max(0, i - SPAN) : i] if i else change[1 : 1 + SPAN]
        if change[i] > LEAST and (not len(recent) or change[i] > recent.mean() + DEVIATIONS * recent.std()):
            starts.append(i + 1)
    return list(zip(starts, [*starts[1:], len(histogram)], strict=True))


def stored(text: str) -> dict:
    """A text's stored form, what is read back from it, and its clips."""
    size, payload = payload_of(text)
    data = write_avi(payload)
    groups, length, seconds = read_avi(data)
    back, tones = [], []
    for frames in groups:
        back.append(frames.tobytes())
        tones.append(histograms(frames))
    histogram = np.concatenate(tones)
    clips = [(a * seconds, b * seconds) for a, b in shots(histogram)]
    return {"n_bytes": size, "back": b"".join(back)[:length], "data": data, "clips": clips, "frames": len(histogram)}


def digests(text: str) -> tuple:
    kept = stored(text)
    back, data = kept["back"], kept["data"]
    feature = f"frames={kept['frames']};clips=" + ",".join(f"{a:.2f}-{b:.2f}" for a, b in kept["clips"])
    return kept["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature


def mapped(docs: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                made = make(text.as_py())
                rows += made
                ids += [i] * len(made)
            # A small batch at a time: what is kept of a text is short, but for stored files.
            table = {"doc_id": pa.array(ids, batch.schema.field("doc_id").type)}
            yield pa.RecordBatch.from_pydict(table | {n: [r[k] for r in rows] for k, n in enumerate(names)})

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {schema}")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, sizes and digests of what is stored and read back, feature."""
    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return mapped(docs, id_col, text_col, lambda text: [digests(text)], schema)


def clips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per clip: doc_id, clip, start_s, end_s."""
    return mapped(docs, id_col, text_col, lambda text: [(k, a, b) for k, (a, b) in enumerate(stored(text)["clips"])], "clip bigint, start_s double, end_s double")


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, avi (the stored file)."""
    return mapped(docs, id_col, text_col, lambda text: [(stored(text)["data"],)], "avi binary")
