import hashlib
import zlib

import numpy as np
import pytest

from loomsheet.llm import media
from loomsheet.llm.queries_media import op7_media

ODD = [b"", b"a", b"x" * 64, bytes(range(256)) * 3, b"\xff" * 5000, "é😀".encode() * 700, b"!!" * 40_000, bytes(np.random.default_rng(1).integers(0, 256, 10_001, dtype=np.uint8))]


@pytest.mark.parametrize("data", ODD)
def test_payload_survives(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload.startswith(data) and len(payload) - len(data) <= 64
    film = media.encode_avi(payload)
    back, samples, lasts = media.decode_avi(film)
    assert lasts == 40_000
    assert back == payload and samples.tobytes()[: len(payload)] == payload


def generic_decode(frame):
    """A plain bit-by-bit baseline decoder of one grey frame: the shade of each block."""
    assert frame[:2] == b"\xff\xd8" and frame[-2:] == b"\xff\xd9"
    at, tables, quantiser = 2, {}, None
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quantiser = body[1:]
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = table
        at += 2 + size
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in frame[at:-2].replace(b"\xff\x00", b"\xff"))
    pos, dc, out = 0, 0, []

    def symbol(table):
        nonlocal pos
        for length in range(1, 17):
            if (found := table.get((length, int(bits[pos : pos + length], 2)))) is not None:
                pos += length
                return found
        raise ValueError

    for _ in range(width * height // 64):
        size = symbol(tables[0x00])
        value = int(bits[pos : pos + size] or "0", 2)
        pos += size
        dc += value if not size or value >> (size - 1) else value - (1 << size) + 1
        assert symbol(tables[0x10]) == 0
        out.append(dc * quantiser[0] // 8 + 128)
    return out


def test_frames_are_baseline_jpeg():
    payload = media.padded(bytes(np.random.default_rng(2).integers(0, 256, 1000, dtype=np.uint8)))
    frames = media._frames(payload)
    shown = [x for f in frames for x in generic_decode(f)]
    assert bytes(shown[: len(payload)]) == payload


def test_shots_are_found():
    calm = np.full((30, media.PER_FRAME), 40, np.uint8)
    calm[12:20] = 200
    starts, _ = media.detect_shots(calm)
    assert starts == [0, 12, 20]


def test_query_and_clips(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    found = op7_media(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        payload = media.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    clips = media.clips(media.store(docs)).collect()
    assert {c["doc_id"] for c in clips} == set(texts) and all(c["end_ms"] > c["start_ms"] for c in clips)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, "x", 7)], "doc_id long, text string, media int")
    rows = media.read_back(media.store(docs)).collect()
    assert len(rows) == 4 and len({r["payload_sha256"] for r in rows}) == 2
    assert media.store(docs.where("false")).count() == 0


def test_bad_input():
    with pytest.raises(ValueError):
        media.encode_avi(b"abc")
    with pytest.raises(ValueError):
        media.decode_avi(b"RIFF0000WAVE")


ORDER = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def other_jpeg(planes, factors, interval=0, step=3):
    """A baseline frame by another encoder: colour, subsampling, restarts, 4-bit DC and 8-bit AC codes; and what it shows."""
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    height, width = planes[0].shape
    quantiser = np.array([step + k // 8 for k in range(64)], float)
    symbols = [r << 4 | s for r in range(16) for s in range(11)]
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, bytes([0, *quantiser.astype(int)[[0] + list(range(1, 64))]]))
    parts = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))
    out += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + parts)
    out += segment(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([0x10, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    if interval:
        out += segment(0xDD, interval.to_bytes(2, "big"))
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + bytes([0, 63, 0]))
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    basis = np.array([[(0.125**0.5 if f == 0 else 0.5) * np.cos((2 * x + 1) * f * np.pi / 16) for x in range(8)] for f in range(8)])
    grids, shown = [], []
    for plane, (h, v) in zip(planes, factors, strict=True):
        padded = np.pad(plane.astype(float), [(0, down * v * 8 - plane.shape[0]), (0, across * h * 8 - plane.shape[1])], "edge") - 128
        grid, back = {}, np.zeros_like(padded)
        for y in range(down * v):
            for x in range(across * h):
                block = padded[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8]
                coded = np.rint((basis @ block @ basis.T).ravel()[ORDER] / quantiser)
                grid[y, x] = coded.astype(int)
                natural = np.zeros(64)
                natural[ORDER] = coded * quantiser
                back[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis.T @ natural.reshape(8, 8) @ basis + 128
        grids.append(grid)
        shown.append(np.clip(back, 0, 255)[: plane.shape[0], : plane.shape[1]])
    amplitude = lambda n: "" if not n else f"{n if n > 0 else n + (1 << abs(n).bit_length()) - 1:0{abs(n).bit_length()}b}"
    pieces, bits, before = [], "", [0] * len(planes)
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            pieces.append(bits)
            bits, before = "", [0] * len(planes)
        for c, (h, v) in enumerate(factors):
            for k in range(h * v):
                block = grids[c][unit // across * v + k // h, unit % across * h + k % h]
                diff, before[c] = block[0] - before[c], block[0]
                bits += f"{abs(int(diff)).bit_length():04b}" + amplitude(int(diff))
                run = 0
                last = max([i for i in range(1, 64) if block[i]], default=0)
                for value in block[1 : last + 1].tolist():
                    if not value:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + f"{symbols.index(0xF0):08b}", run - 16
                    bits, run = bits + f"{symbols.index(run << 4 | abs(value).bit_length()):08b}" + amplitude(value), 0
                if last < 63:
                    bits += f"{symbols.index(0):08b}"
    pieces.append(bits)
    for k, b in enumerate(pieces):
        b += "1" * (-len(b) % 8)
        out += int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(pieces) else b"")
    return out + b"\xff\xd9", shown


@pytest.mark.parametrize(("size", "factors", "interval"), [((24, 40), [(1, 1)], 0), ((37, 51), [(2, 2), (1, 1), (1, 1)], 0), ((33, 20), [(2, 1), (1, 1), (1, 1)], 2)])
def test_frames_of_another_encoder(size, factors, interval):
    rng = np.random.default_rng(7)
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    planes = [np.clip(np.add.outer(np.arange(-(-size[0] * v // most_v)) * 5, np.arange(-(-size[1] * h // most_h)) * 3) + rng.integers(0, 60, (-(-size[0] * v // most_v), -(-size[1] * h // most_h))), 0, 255) for h, v in factors]
    frame, shown = other_jpeg(planes, factors, interval)
    decoded = media.decode_jpeg(frame)
    assert [p.shape for p in decoded] == [p.shape for p in planes]
    assert all(np.abs(d.astype(float) - s).max() <= 0.51 for d, s in zip(decoded, shown, strict=True))


def test_a_film_of_another_writer(spark):
    dark, light = (other_jpeg([np.full((40, 56), shade)], [(1, 1)])[0] for shade in (20, 230))
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    frames = [dark] * 10 + [light] * 8 + [dark] * 12
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", (20_000).to_bytes(4, "little") + bytes(52)))
    for absolute in (False, True):
        movi, index = b"movi", b""
        for f in frames:
            at = len(movi) + (12 + len(head) + 8 if absolute else 0)
            index += b"00dc" + (16).to_bytes(4, "little") + at.to_bytes(4, "little") + len(f).to_bytes(4, "little")
            movi += chunk(b"00dc", f) + chunk(b"01wb", b"sound")
        body = b"AVI " + head + chunk(b"LIST", movi) + chunk(b"JUNK", b"xx") + chunk(b"idx1", index)
        film = b"RIFF" + len(body).to_bytes(4, "little") + body
        payload, samples, lasts = media.decode_avi(film)
        assert samples.shape == (30, 35) and lasts == 20_000 and len(payload) == 30 * 40 * 56
    stored = spark.createDataFrame([(1, 0, bytearray(film))], "doc_id long, n_bytes long, media binary")
    assert [(r["start_ms"], r["end_ms"]) for r in media.clips(stored).orderBy("clip").collect()] == [(0, 200), (200, 360), (360, 600)]


def test_broken_frames_are_told():
    frame, _ = other_jpeg([np.full((16, 16), 90)], [(1, 1)])
    for bad in (frame[:2] + frame[3:], frame.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            media.decode_jpeg(bad)
