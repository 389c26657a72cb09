"""Media columns: AVI files with motion-JPEG frames.

A payload of bytes becomes a grey film. Each byte is one 8-bit sample, drawn as one 8 x 8 block of a
baseline JPEG frame: the block has only its DC coefficient, with a quantiser of 8, so every decoder
shows the block in exactly that shade and nothing is lost. The Huffman table gives the DC category
``s`` a code of ``9 - s`` bits, so that code and amplitude together always take 9 bits, and one bit
ends the block. Encoding and decoding are therefore table look-ups over whole frames in numpy.

Reading parses the RIFF chunks and the ``idx1`` index, decodes the intra frames, and detects shots
where the histogram difference of neighbouring frames exceeds an adaptive threshold: mean plus
``SIGMAS`` deviations of the differences around it. Frames with this module's own headers are decoded
by the look-ups; all others as baseline JPEG: quantisers, Huffman tables, restarts, subsampled
components, cosine transform. Of a film that others wrote, the payload is the grey planes of its frames.

Defined results: a null text is an empty payload; an empty text gives 64 zero bytes, one frame and
one clip. Texts of any length are stored whole. Repeated rows give repeated results. Extra columns
are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, text_of

ACROSS, DOWN = 32, 16  # blocks of a frame
PER_FRAME = ACROSS * DOWN
FPS = 25
HELD = 4_000_000  # bytes of texts or films worked on together
UNIT = 64  # payloads are padded to a positive multiple of it
BINS, NEAR, SIGMAS, FLOOR = 16, 5, 3.0, 0.25


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 10-bit code of each DC difference + 255, and the difference of each code."""
    codes, back = np.zeros(511, np.uint64), np.full(1024, -1000, np.int16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = (1 << (9 - size)) - 2  # category 8 is 0, 7 is 10, ..., 0 is 111111110
        amplitude = diff if diff >= 0 else diff + (1 << size) - 1
        code = ((prefix << size) | amplitude) << 1  # and 0, the end of the block
        codes[diff + 255], back[code] = code, diff
    return codes, back


CODES, BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, DOWN * 8, ACROSS * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1))))
    + _segment(0xC4, bytes([0x10] + [1] + [0] * 15 + [0]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _frames(payload: bytes) -> list[bytes]:
    samples = np.frombuffer(payload, np.uint8).astype(np.int16)
    n = -(-len(samples) // PER_FRAME)
    held = np.zeros(n * PER_FRAME, np.int16)
    held[: len(samples)] = samples
    held = held.reshape(n, PER_FRAME)
    diffs = np.empty_like(held)
    diffs[:, 0] = held[:, 0] - 128
    np.subtract(held[:, 1:], held[:, :-1], out=diffs[:, 1:])
    quads = CODES[diffs + 255].reshape(n, PER_FRAME // 4, 4)
    word = (quads[..., 0] << 30) | (quads[..., 1] << 20) | (quads[..., 2] << 10) | quads[..., 3]
    scans = word.astype(">u8").view(np.uint8).reshape(n, PER_FRAME // 4, 8)[..., 3:].reshape(n, -1)
    return [HEADER + s.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for s in scans]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file of the payload, whose length must be a positive multiple of ``UNIT``."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    frames = _frames(payload)
    width, height, n = ACROSS * 8, DOWN * 8, len(frames)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    body = b"AVI " + headers + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, size
        at += 8 + size + size % 2


def _zigzag() -> np.ndarray:
    """The place in a block, row by row, of each coefficient of a scan."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


ZIGZAG = _zigzag()
_ROW, _COLUMN = np.mgrid[0:8, 0:8]
COSINES = np.cos((2 * _COLUMN + 1) * _ROW * np.pi / 16) * np.where(_ROW == 0, np.sqrt(1 / 8), 0.5)  # frequency x place


@lru_cache(64)
def _codes(table: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits ahead: the length of the code that they begin with (0 for none), and its symbol."""
    lengths, symbols, code, at = [0] * 65536, [0] * 65536, 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            first, many = code << (16 - size), 1 << (16 - size)
            lengths[first : first + many], symbols[first : first + many] = [size] * many, [table[at]] * many
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


class _Bits:
    """The bits of a scan between two restarts; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data) + 32

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, codes: tuple[list[int], list[int]]) -> int:
        ahead = self.peek()
        size = codes[0][ahead]
        if not size or self.at > self.end:
            raise ValueError("a scan is broken")
        self.at += size
        return codes[1][ahead]

    def number(self, size: int) -> int:
        if not size:
            return 0
        value = self.peek() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def decode_jpeg(frame: bytes) -> list[np.ndarray]:
    """The planes of a baseline JPEG image, each height x width of its component, uint8."""
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, bytes] = {}
    parts, interval, at = [], 0, 2
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quantisers[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                many = 17 + sum(body[1:17])
                tables[body[0]] = body[1:many]
                body = body[many:]
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            parts = [[body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2], None, None] for k in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            for k in range(1, 1 + 2 * body[0], 2):
                part = next(p for p in parts if p[0] == body[k])
                part[4], part[5] = _codes(tables[body[k + 1] >> 4]), _codes(tables[16 + (body[k + 1] & 15)])
            break
    if not parts or any(p[4] is None for p in parts):
        raise ValueError("a frame must have its components in one scan")
    # Bytes of the scan up to the end marker; stuffed zeros go, restarts cut.
    scan = re.split(rb"\xff[\xd0-\xd7]", frame[at : frame.rindex(b"\xff\xd9")] if b"\xff\xd9" in frame[at:] else frame[at:])
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    held = [np.zeros((down * p[2], across * p[1], 64)) for p in parts]
    step = interval or across * down
    for n, piece in enumerate(scan):
        bits, before = _Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for unit in range(n * step, min((n + 1) * step, across * down)):
            y, x = divmod(unit, across)
            for c, (_, h, v, _, dc, ac) in enumerate(parts):
                for k in range(h * v):
                    block = held[c][y * v + k // h, x * h + k % h]
                    before[c] += bits.number(bits.symbol(dc))
                    block[0] = before[c]
                    place = 1
                    while place < 64:
                        s = bits.symbol(ac)
                        if not s:
                            break
                        place += s >> 4
                        if s & 15:
                            if place > 63:
                                raise ValueError("a scan is broken")
                            block[place] = bits.number(s & 15)
                        place += 1
    planes = []
    for (_, h, v, q, _, _), coded in zip(parts, held, strict=True):
        natural = np.zeros_like(coded)
        natural[..., ZIGZAG] = coded * quantisers[q]
        shown = np.einsum("fy,rcfg,gx->rycx", COSINES, natural.reshape(*coded.shape[:2], 8, 8), COSINES) + 128
        plane = np.clip(np.rint(shown), 0, 255).astype(np.uint8).reshape(coded.shape[0] * 8, coded.shape[1] * 8)
        planes.append(plane[: -(-height * v // most_v), : -(-width * h // most_h)])
    return planes


def _own(scans: list[bytes]) -> np.ndarray:
    """The samples of frames that this module wrote (frames x PER_FRAME, uint8)."""
    five = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, 3:] = five
    word = wide.view(">u8").astype(np.uint64)[:, 0]
    codes = np.empty((len(word), 4), np.uint16)
    for k in range(4):
        codes[:, k] = (word >> np.uint64(30 - 10 * k)) & np.uint64(1023)
    diffs = BACK[codes].reshape(len(scans), PER_FRAME).astype(np.int32)
    diffs[:, 0] += 128
    return np.cumsum(diffs, axis=1).astype(np.uint8)


def _shades(plane: np.ndarray) -> np.ndarray:
    """The mean of each 8 x 8 block of a plane."""
    tall = np.pad(plane, [(0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)], "edge")
    return np.rint(tall.reshape(tall.shape[0] // 8, 8, tall.shape[1] // 8, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


def frames_of(view: memoryview, movi: int, end: int, index: bytes) -> list[bytes]:
    """The video frames of a film, by its index, whose offsets may count from the list or from the file; or in order."""
    if not index:
        return [bytes(view[a : a + s]) for kind, a, s in _chunks(view, movi + 4, end) if kind[2:] in (b"dc", b"db") and s]
    entries = [(kind, offset, size) for kind, _, offset, size in struct.iter_unpack("<4sIII", index) if kind[2:] in (b"dc", b"db") and size]
    base = movi if entries and bytes(view[movi + entries[0][1] : movi + entries[0][1] + 4]) == entries[0][0] else 0
    return [bytes(view[base + offset + 8 : base + offset + 8 + size]) for _, offset, size in entries]


def decode_avi(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload, the shades of each frame (frames x blocks, uint8), and the microseconds of a frame."""
    view = memoryview(media)
    riff, size, form = struct.unpack_from("<4sI4s", view)
    if riff != b"RIFF" or form != b"AVI ":
        raise ValueError("not an AVI file")
    length, movi, end, index, lasts = None, None, 0, b"", 1_000_000 // FPS
    for kind, at, size in _chunks(view, 12, 8 + size):
        if kind == b"LIST" and view[at : at + 4] == b"INFO":
            for name, a, s in _chunks(view, at + 4, at + size):
                note = bytes(view[a : a + s]).rstrip(b"\0")
                if name == b"ICMT" and note.startswith(b"payload="):
                    length = int(note.removeprefix(b"payload="))
        elif kind == b"LIST" and view[at : at + 4] == b"hdrl":
            for name, a, _ in _chunks(view, at + 4, at + size):
                if name == b"avih":
                    lasts = struct.unpack_from("<I", view, a)[0] or lasts
        elif kind == b"LIST" and view[at : at + 4] == b"movi":
            movi, end = at, at + size
        elif kind == b"idx1":
            index = bytes(view[at : at + size])
    if movi is None:
        raise ValueError("a film without frames")
    frames = frames_of(view, movi, end, index)
    if length is not None and frames and all(f.startswith(HEADER) for f in frames):
        samples = _own([f[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") for f in frames])
        return samples.tobytes()[:length], samples, lasts
    planes = [decode_jpeg(f)[0] for f in frames]
    if len({p.shape for p in planes}) != 1:
        raise ValueError("a film has frames of one size")
    return b"".join(p.tobytes() for p in planes), np.stack([_shades(p) for p in planes]), lasts


def detect_shots(samples: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The frames at which a shot begins (0 is one), and the histogram differences."""
    n = len(samples)
    keys = (samples >> 4).astype(np.int64) + np.arange(n, dtype=np.int64)[:, None] * BINS
    hist = np.bincount(keys.ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    diffs = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    if not len(diffs):
        return [0], diffs
    ones, width = np.ones(2 * NEAR + 1), len(diffs)
    count = np.convolve(np.ones(width), ones, "full")[NEAR : NEAR + width]
    mean = np.convolve(diffs, ones, "full")[NEAR : NEAR + width] / count
    square = np.convolve(diffs**2, ones, "full")[NEAR : NEAR + width] / count
    limit = np.maximum(FLOOR, mean + SIGMAS * np.sqrt(np.maximum(square - mean**2, 0)))
    return [0, *(np.flatnonzero(diffs > limit) + 1).tolist()], diffs


STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """One AVI file per row of ``docs`` (doc_id, text): doc_id, n_bytes (unpadded), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                datas = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in datas], pa.int64()), pa.array([encode_avi(padded(x)) for x in datas], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).mapInArrow(run, STORED)


READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, "
    "feature string, clips array<struct<clip:int,start_ms:long,end_ms:long,mean:double>>"
)


def _read(media: bytes) -> dict:
    payload, samples, lasts = decode_avi(media)
    starts, diffs = detect_shots(samples)
    ends = [*starts[1:], len(samples)]
    means = samples.mean(axis=1)
    clips = [{"clip": k, "start_ms": a * lasts // 1000, "end_ms": b * lasts // 1000, "mean": round(float(means[a:b].mean()), 4)} for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    most = float(diffs.max()) if len(diffs) else 0.0
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": len(samples),
        "feature": f"frames={len(samples)};shots={len(starts)};mean={means.mean():.4f};cut={most:.4f}", "clips": clips,
    }


def read_back(stored: DataFrame) -> DataFrame:
    """Parses and decodes the stored files: digests of what was read, a feature, and the clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = {"clips": pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean", pa.float64())])), "n_frames": pa.int32()}
        types |= {k: pa.string() for k in ("payload_sha256", "media_sha256", "feature")}
        for batch in batches:
            for part in slices(batch, "media", HELD):
                rows = [_read(x.as_py()) for x in part.column("media")]
                made = {k: pa.array([r[k] for r in rows], types.get(k, pa.int64())) for k in names[2:]}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *made.values()], names)

    return bounded(stored.select("doc_id", "n_bytes", "media")).mapInArrow(run, READ)


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip, start_ms, end_ms, mean."""
    return read_back(stored).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
