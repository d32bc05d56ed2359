import hashlib
import struct
import zlib

import numpy as np
import pytest

from rentloom.llm.avi_mjpeg import ZIGZAG, avi_header, clips, decode_frame, default_tables, padded, read_avi, read_index, shots, store_texts, write_avi


def test_zigzag_begins_as_the_standard_has_it():
    assert ZIGZAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and ZIGZAG[-1] == (7, 7)


def test_round_trip_of_all_bytes():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 9).astype(np.uint8)
    data = write_avi(payload)
    fps, means = read_avi(data)
    assert fps == 25 and means.tobytes() == payload.tobytes()
    without_index = data[: data.rindex(b"idx1")]
    assert read_avi(without_index)[1].tobytes() == payload.tobytes()


def test_the_general_decoder_sees_the_same_samples():
    payload = np.random.default_rng(2).integers(0, 256, 64).astype(np.uint8)
    data = write_avi(payload)
    _, index = read_index(data)
    at, n = index[0]
    pixels = decode_frame(data[at : at + n])[:64, :64]
    assert (pixels[::8, ::8].ravel() == payload).all() and (pixels[7::8, 7::8].ravel() == payload).all()


def test_shots():
    dark, light = np.full((20, 64), 10, np.uint8), np.full((20, 64), 200, np.uint8)
    assert shots(np.concatenate([dark, light])).tolist() == [0, 20]
    assert shots(dark).tolist() == [0] and shots(dark[:1]).tolist() == [0] and shots(dark[:0]).tolist() == []


def test_not_avi():
    with pytest.raises(ValueError):
        read_avi(b"")


def test_documents(spark, documents):
    rows = [(1, None), (2, ""), (3, "été"), (4, "x" * 64), (5, "x" * 65), (6, "y" * 100_000), (6, "y" * 100_000), (None, "z")]
    docs = documents(rows).withColumnRenamed("lang", "feature")
    got = sorted(store_texts(docs, with_media=True).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        raw = (t or "").encode()
        want = padded(np.frombuffer(raw, np.uint8)).tobytes()
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(want)) and len(want) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxxAVI ")), (3, bytearray(write_avi(np.zeros(64, np.uint8))[:300]))], "doc_id long, media binary")
    assert all(r.error and r.clip is None for r in clips(broken).collect()) and clips(broken).count() == 3
    timed = clips(store_texts(docs, with_media=True)).where("doc_id = 4").collect()
    assert [(c.clip, c.first_frame, c.n_frames, c.start_s, c.end_s) for c in timed] == [(0, 0, 1, 0.0, 0.04)] and timed[0].error is None
    assert store_texts(docs.limit(0)).count() == 0


def encode_colour(luma, sampling, restart, tables, wide_quant):
    """A baseline colour frame of quantised luma blocks (block rows x block columns x 64 in zigzag order) with flat colour,
    coded with the standard's tables. tables: whether the frame carries them; all in one segment then."""
    (h, v), (rows, cols) = sampling, (luma.shape[0], luma.shape[1])
    codes = {k: {symbol: (value, length) for (length, value), symbol in t.items()} for k, t in default_tables().items()}
    bits, scan, dc = [], [], [0, 0, 0]

    def put(value, n):
        bits.extend((value >> k) & 1 for k in range(n - 1, -1, -1))

    def number(x):
        n = abs(x).bit_length()
        return n, x if x >= 0 else x + (1 << n) - 1

    def block(z, part):
        own = 0 if part == 0 else 1
        n, raw = number(int(z[0]) - dc[part])
        dc[part] = int(z[0])
        put(*codes[own][n])
        put(raw, n)
        run = 0
        last = max([k for k in range(1, 64) if z[k]], default=0)
        for k in range(1, last + 1):
            if not z[k]:
                run += 1
                continue
            while run > 15:
                put(*codes[0x10 | own][0xF0])
                run -= 16
            n, raw = number(int(z[k]))
            put(*codes[0x10 | own][16 * run + n])
            put(raw, n)
            run = 0
        if last < 63:
            put(*codes[0x10 | own][0])

    def flush():
        put(127, (-len(bits)) % 8)
        raw = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        bits.clear()
        return raw

    units = [(r, c) for r in range(rows // v) for c in range(cols // h)]
    for k, (r, c) in enumerate(units):
        if restart and k and k % restart == 0:
            scan.append(flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8]))
            dc[:] = [0, 0, 0]
        for y in range(v):
            for x in range(h):
                block(luma[r * v + y, c * h + x], 0)
        for part in (1, 2):
            block([k % 5 - 2, *[0] * 62, 1], part)
    scan.append(flush())
    mark = lambda code, body: bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body
    quant = bytes([0x10]) + struct.pack(">64H", *range(3, 67)) if wide_quant else bytes([0, *range(3, 67)])
    out = b"\xff\xd8" + mark(0xFE, b"a comment") + mark(0xDB, quant + bytes([1, *[9] * 64]))
    out += mark(0xC0, b"\x08" + struct.pack(">HH", 8 * rows - 3, 8 * cols - 2) + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1]))
    if tables:
        body = b""
        for key, t in default_tables().items():
            lengths = [n for n, _ in t]
            body += bytes([key, *(lengths.count(n) for n in range(1, 17))]) + bytes(s for _, s in sorted(t.items()))
        out += mark(0xC4, body)
    if restart:
        out += mark(0xDD, struct.pack(">H", restart))
    return out + mark(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"".join(scan) + b"\xff\xd9"


@pytest.mark.parametrize("sampling, restart, tables, wide", [((2, 2), 0, False, False), ((2, 1), 1, True, False), ((1, 1), 3, False, True), ((2, 2), 2, True, True)])
def test_colour_frames(sampling, restart, tables, wide):
    rng = np.random.default_rng(4)
    luma = np.where(rng.random((4, 4, 64)) < 0.2, rng.integers(-9, 10, (4, 4, 64)), 0)
    luma[..., 0] = rng.integers(-100, 100, (4, 4))
    got = decode_frame(encode_colour(luma, sampling, restart, tables, wide))
    k = np.arange(8)
    for r in range(4):
        for c in range(4):
            plain = np.zeros((8, 8))
            for z, (u, v) in enumerate(ZIGZAG):
                scale = (np.sqrt(1 / 8) if u == 0 else 0.5) * (np.sqrt(1 / 8) if v == 0 else 0.5)
                plain += luma[r, c, z] * (z + 3) * scale * np.outer(np.cos((2 * k + 1) * u * np.pi / 16), np.cos((2 * k + 1) * v * np.pi / 16))
            want = np.clip(np.rint(plain + 128), 0, 255)
            assert np.abs(got[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] - want).max() <= 1


def test_colour_files_with_rec_lists_and_segments(spark):
    frames = [encode_colour(np.stack([[[x, *[0] * 63]] * 2] * 2), (2, 2), 0, False, False) for x in [-20] * 12 + [60] * 12]
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    rec = b"".join(chunk(b"LIST", b"rec " + chunk(b"01wb", b"sound") + chunk(b"00dc", f)) for f in frames)
    data = chunk(b"RIFF", b"AVI " + avi_header(24, 10) + chunk(b"JUNK", b"avih" * 3) + chunk(b"LIST", b"movi" + rec))
    fps, means = read_avi(data)
    assert fps == 10 and len(means) == 24
    rows = clips(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(r.first_frame, r.n_frames, r.start_s) for r in rows] in ([(0, 24, 0.0)], [(0, 12, 0.0), (12, 12, 1.2)])
    payload = np.random.default_rng(6).integers(0, 256, 64 * 25).astype(np.uint8)
    parts = write_avi(payload, segment=7)
    assert parts.count(b"AVIX") == 3 and read_avi(parts)[1].tobytes() == payload.tobytes() and len(read_index(parts)[1]) == 25
