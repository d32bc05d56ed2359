"""Media columns: AVI files of motion JPEG.

``write_avi`` stores bytes as grey 8 x 8 blocks of baseline JPEG frames, one sample a block, 64 a frame. A block is its
mean alone (quantiser 8, so the coefficient is the sample less 128). The Huffman table gives category s a code of 10 - s
bits, so each difference takes ten bits in all and, with six for the end of the block, each block two bytes, which never
need stuffing. ``read_avi`` walks the RIFF chunks, takes the frames from the index (or from the movi lists, where there
is none that fits) and decodes them: frames of that form all at once, the luma of any other sequential frame bit by bit,
with colour in any sampling, several tables a segment, the standard's tables where a frame has none, and restart markers.
``shots`` compares the frames' histograms with what is usual around them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import buffer_of, quoted, slices

SIDE = 8
SAMPLES = SIDE * SIDE
FPS = 25
BINS = 16
LOOK_BACK = 8
DEVIATIONS = 3.0
LEAST_CHANGE = 16
SEGMENT_FRAMES = 4_000_000

# The zigzag order of JPEG, as (row, column) along the diagonals.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))

# The Huffman tables of the JPEG standard's annex K, as counts by length and the symbols of the shorter codes.
DEFAULT_HUFFMAN = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), "000102030405060708090a0b"),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), "000102030405060708090a0b"),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


def _difference_codes() -> np.ndarray:
    """Ten bits for each difference -255..255: the category's code, then the category's bits."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2 if s < 8 else 0
        out[d + 255] = (code << s) | (d if d >= 0 else d + (1 << s) - 1)
    return out


_CODES = _difference_codes()
_VALUES = np.full(1024, 999, np.int16)
_VALUES[_CODES] = np.arange(-255, 256)


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body


def jpeg_header(side: int = SIDE) -> bytes:
    dc = bytes([0]) + bytes([0, *[1] * 9, *[0] * 6]) + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes([0] * 5 + [1] + [0] * 10) + b"\0"
    size = struct.pack(">HH", 8 * side, 8 * side)
    return b"\xff\xd8" + _marker(0xDB, bytes([0] + [8] * 64)) + _marker(0xC0, b"\x08" + size + b"\x01\x01\x11\x00") + _marker(0xC4, dc) + _marker(0xC4, ac) + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")


_HEAD = jpeg_header()
_FRAME = len(_HEAD) + 2 * SAMPLES + 2
_CHUNK = 8 + _FRAME


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_header(frames: int, fps: int = FPS, side: int = SIDE) -> bytes:
    edge = 8 * side
    avih = struct.pack("<14I", 1_000_000 // fps, _CHUNK * fps, 0, 0x10, frames, 0, 1, _CHUNK, edge, edge, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, frames, _CHUNK, 0xFFFFFFFF, 0, 0, 0, edge, edge)
    strf = struct.pack("<IiiHH4sIiiII", 40, edge, edge, 1, 24, b"MJPG", edge * edge * 3, 0, 0, 0, 0)
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))


def _segment(value: np.ndarray, first: bool, head: bytes) -> list[bytes]:
    """One RIFF segment of frames: the first has the headers and an index, later ones (AVIX) continue it."""
    n = len(value)
    words = _CODES[np.diff(value, axis=1, prepend=np.int16(128)) + 255] << np.uint16(6)
    movi = np.empty((n, _CHUNK), np.uint8)
    movi[:, : 8 + len(_HEAD)] = np.frombuffer(b"00dc" + struct.pack("<I", _FRAME) + _HEAD, np.uint8)
    movi[:, 8 + len(_HEAD) : -2] = words.astype(">u2").view(np.uint8).reshape(n, -1)
    movi[:, -2:] = (0xFF, 0xD9)
    body = [b"LIST", struct.pack("<I", 4 + movi.size), b"movi", movi.tobytes()]
    if not first:
        return [b"RIFF", struct.pack("<I", 4 + 12 + movi.size), b"AVIX", *body]
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.arange(n) * _CHUNK, _FRAME
    size = 4 + len(head) + 12 + movi.size + 8 + index.nbytes
    return [b"RIFF", struct.pack("<I", size), b"AVI ", head, *body, b"idx1", struct.pack("<I", index.nbytes), index.tobytes()]


def write_avi(payload: np.ndarray, fps: int = FPS, segment: int = SEGMENT_FRAMES) -> bytes:
    """An AVI file of a payload whose length is a positive multiple of 64. Sizes in a RIFF segment have 32 bits, so a long
    payload goes on in further segments."""
    if not len(payload) or len(payload) % SAMPLES:
        raise ValueError("the payload has to be a positive multiple of 64 bytes")
    frames = payload.reshape(-1, SAMPLES)
    head = avi_header(len(frames), fps)
    return b"".join(x for k in range(0, len(frames), segment) for x in _segment(frames[k : k + segment].astype(np.int16), k == 0, head))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, list's kind, start of the data, its size) of the chunks in a stretch; a size that goes beyond it is cut."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12] if name in (b"LIST", b"RIFF") else b""
        yield name, kind, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def _frames_of(data: bytes, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, size) of the video chunks of a movi list, those in rec lists too, in order."""
    for name, kind, start, n in _chunks(data, at, at + size):
        if kind == b"rec ":
            yield from _frames_of(data, start + 4, n - 4)
        elif name[2:] in (b"dc", b"db"):
            yield start, n


def read_index(data: bytes) -> tuple[int, np.ndarray]:
    """Frames a second, and (start, size) of each video frame's data: by the index of the first segment where its entries
    point at such chunks, else by walking the movi lists; those of further segments are always walked."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, found, any_movi = FPS, [], False
    for _, kind, start, size in _chunks(data, 0, len(data)):
        if kind not in (b"AVI ", b"AVIX"):
            continue
        movi, index = None, None
        for name, inner, a, n in _chunks(data, start + 4, start + size):
            if inner == b"hdrl":
                for head, _, b, _ in _chunks(data, a + 4, a + n):
                    if head == b"avih":
                        fps = round(1_000_000 / max(1, struct.unpack_from("<I", data, b)[0]))
            elif inner == b"movi":
                movi, any_movi = (a, n), True
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", n // 16 * 4, a).reshape(-1, 4)
        if movi is None:
            continue
        by_index = _indexed(data, index, movi[0]) if index is not None else None
        found.append(by_index if by_index is not None else np.array(list(_frames_of(data, movi[0] + 4, movi[1] - 4)), np.int64).reshape(-1, 2))
    if not any_movi:
        raise ValueError("no movi list")
    return fps, np.concatenate(found)


def _indexed(data: bytes, index: np.ndarray, movi: int) -> np.ndarray | None:
    """The frames that an index lists, or None where it doesn't fit the file. Offsets count from the list's kind, or from
    the file's start in some writers."""
    kind = index[:, 0] >> 16
    first = index[(kind == int.from_bytes(b"dc", "little")) | (kind == int.from_bytes(b"db", "little"))].astype(np.int64)
    if not len(first):
        return None
    for base in (movi, 0):
        ends = first[:, 2] + base + 8 + first[:, 3]
        if ends.max() <= len(data) and all(data[x + 2 : x + 4] in (b"dc", b"db") for x in (first[[0, -1], 2] + base).tolist()):
            return np.stack([first[:, 2] + base + 8, first[:, 3]], 1)
    return None


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, codes in order of their lengths."""
    k, value, codes = 0, 0, {}
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes[length, value] = symbols[k]
            k, value = k + 1, value + 1
        value <<= 1
    return codes


@lru_cache(1)
def default_tables() -> dict[int, dict[tuple[int, int], int]]:
    """The Huffman tables that motion JPEG means where a frame has none: by class and number."""
    out = {}
    for key, (counts, symbols) in DEFAULT_HUFFMAN.items():
        raw = bytes.fromhex(symbols)
        given = set(raw)
        # AC symbols of the longest codes come in ascending order of run and size.
        rest = [16 * run + size for run in range(16) for size in range(1, 11) if 16 * run + size not in given] if key & 0x10 else []
        out[key] = _huffman(bytes(counts), raw + bytes(rest))
    return out


def _tables(frame: bytes) -> dict:
    """What a frame's markers say: size, components (id, sampling, quantiser), tables, restart interval, and its scan."""
    out: dict = {"huff": dict(default_tables()), "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        code, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if code == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                kind = ">u2" if wide else np.uint8
                out["quant"][body[k] & 15] = np.frombuffer(body, kind, 64, k + 1).astype(float)
                k += 1 + (128 if wide else 64)
        elif code in (0xC0, 0xC1):
            out["h"], out["w"] = struct.unpack_from(">HH", body, 1)
            out["parts"] = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
        elif 0xC2 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only sequential frames are decoded")
        elif code == 0xC4:
            k = 0
            while k < len(body):
                many = sum(body[k + 1 : k + 17])
                out["huff"][body[k]] = _huffman(body[k + 1 : k + 17], body[k + 17 : k + 17 + many])
                k += 17 + many
        elif code == 0xDD:
            out["restart"] = struct.unpack_from(">H", body)[0]
        elif code == 0xDA:
            out["scan_of"] = {body[1 + 2 * c]: (body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(body[0])}
            if "parts" not in out:
                raise ValueError("a scan without a frame")
            return out | {"scan": at + 2 + size}
        at += 2 + size
    raise ValueError("a frame without a scan")


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.value, self.left = raw, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.at == len(self.raw):
                raise ValueError("a scan ends early")
            self.value = (self.value << 8) | self.raw[self.at]
            self.at, self.left = self.at + 1, self.left + 8
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def symbol(self, codes: dict) -> int:
        value = 0
        for length in range(1, 17):
            value = (value << 1) | self.take(1)
            if (length, value) in codes:
                return codes[length, value]
        raise ValueError("a code that the table doesn't have")

    def signed(self, s: int) -> int:
        value = self.take(s) if s else 0
        return value if not s or value >> (s - 1) else value - (1 << s) + 1


def _intervals(raw: bytes) -> list[bytes]:
    """The parts of a scan between restart markers, without stuffing."""
    out, first, at = [], 0, raw.find(b"\xff")
    while at >= 0:
        code = raw[at + 1] if at + 1 < len(raw) else 0xD9
        if 0xD0 <= code <= 0xD7 or code == 0xD9:
            out.append(raw[first:at])
            first = at + 2
            if code == 0xD9:
                break
        at = raw.find(b"\xff", at + 2)
    else:
        out.append(raw[first:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def decode_frame(frame: bytes) -> np.ndarray:
    """The luma of any sequential Huffman frame, grey or colour in any sampling, by Huffman decoding, dequantising and the
    inverse cosine transform. Other components are decoded as far as the bits have to be passed."""
    t = _tables(frame)
    parts = [p for p in t["parts"] if p[0] in t["scan_of"]]
    if not parts:
        raise ValueError("the scan names no component")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-t["w"] // (8 * wide)), -(-t["h"] // (8 * high))
    luma, lh, lv, quant = parts[0]
    if quant not in t["quant"]:
        raise ValueError("a quantiser is missing")
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    held = np.zeros((rows * lv, cols * lh, 8, 8))
    per = t["restart"] or rows * cols
    spans = _intervals(frame[t["scan"] :])
    for number in range(-(-rows * cols // per)):
        if number >= len(spans):
            raise ValueError("a scan ends early")
        bits, dc = _Bits(spans[number]), dict.fromkeys((p[0] for p in parts), 0)
        for unit in range(number * per, min((number + 1) * per, rows * cols)):
            for name, h, v, _ in parts:
                dc_codes, ac_codes = t["huff"][t["scan_of"][name][0]], t["huff"][0x10 | t["scan_of"][name][1]]
                for b in range(h * v):
                    dc[name] += bits.signed(bits.symbol(dc_codes))
                    block = held[unit // cols * lv + b // h, unit % cols * lh + b % h] if name == luma else np.zeros((8, 8))
                    block[0, 0] = dc[name] * t["quant"][quant][0]
                    z = 1
                    while z < 64:
                        rs = bits.symbol(ac_codes)
                        if rs == 0:
                            break
                        z += rs >> 4
                        if rs & 15:
                            if z > 63:
                                raise ValueError("a block is too long")
                            block[ZIGZAG[z]] = bits.signed(rs & 15) * t["quant"][quant][z]
                        z += 1
    pixels = (basis @ held @ basis.T + 128).transpose(0, 2, 1, 3).reshape(8 * rows * lv, 8 * cols * lh)
    return np.clip(np.rint(pixels), 0, 255).astype(np.uint8)


def read_avi(data: bytes) -> tuple[int, np.ndarray]:
    """Frames a second, and each frame's blocks' mean luma (frames x blocks). Frames that the codec of this module has
    written are decoded all at once, others one by one; a frame of no bytes repeats the one before."""
    fps, index = read_index(data)
    if len(index) and (index[:, 1] == _FRAME).all():
        step = np.diff(index[:, 0])
        if (step == _CHUNK).all():
            frames = np.frombuffer(data, np.uint8, len(index) * _CHUNK - 8, int(index[0, 0]))
            frames = np.lib.stride_tricks.as_strided(frames, (len(index), _FRAME), (_CHUNK, 1))
        else:
            frames = np.stack([np.frombuffer(data, np.uint8, _FRAME, int(a)) for a in index[:, 0]])
        if (frames[:, : len(_HEAD)] == np.frombuffer(_HEAD, np.uint8)).all():
            words = np.ascontiguousarray(frames[:, len(_HEAD) : -2]).view(">u2")
            return fps, (np.cumsum(_VALUES[words >> 6], axis=1, dtype=np.int16) + 128).astype(np.uint8)
    grids: list[np.ndarray] = []
    for a, n in index.tolist():
        if not n and grids:
            grids.append(grids[-1])
            continue
        pixels = decode_frame(data[a : a + n])
        grids.append(pixels.reshape(pixels.shape[0] // 8, 8, -1, 8).mean((1, 3)).round().ravel().astype(np.uint8))
    if len({len(g) for g in grids}) > 1:
        raise ValueError("frames of different sizes")
    return fps, np.stack(grids) if grids else np.zeros((0, SAMPLES), np.uint8)


def shots(means: np.ndarray) -> np.ndarray:
    """First frames of the shots. A cut is where the histogram changes by more than the mean of the LOOK_BACK changes
    before, plus DEVIATIONS of their spread, and by LEAST_CHANGE blocks at least."""
    n = len(means)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    hist = np.bincount((np.arange(n)[:, None] * BINS + (means >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(hist, axis=0)).sum(1)
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change * change)])
    k = np.arange(n - 1)
    first = np.maximum(k - LOOK_BACK, 0)
    many = np.maximum(k - first, 1)
    mean = (sums[k] - sums[first]) / many
    spread = np.sqrt(np.maximum((squares[k] - squares[first]) / many - mean * mean, 0))
    cut = (change >= LEAST_CHANGE) & (change > mean + DEVIATIONS * spread) & (k > 0)
    return np.concatenate([[0], 1 + np.flatnonzero(cut)])


def padded(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(max(1, -(-len(raw) // SAMPLES)) * SAMPLES, np.uint8)
    out[: len(raw)] = raw
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, bytes, media, fps, block means) of each row's text, stored and read back."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[1]):
            data, at = buffer_of(part.column(1))
            for k, doc in enumerate(part.column(0).to_pylist()):
                raw = data[at[k] : at[k + 1]]
                media = write_avi(padded(raw))
                yield doc, len(raw), media, *read_avi(media)


def _batched(rows: Iterator[tuple], schema: pa.Schema, many: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row per document: its bytes stored as AVI, read back, and the read-back payload's digests and shots.

    A null or empty text is one frame of zeros. Ids are passed on, whatever they are. A long text's file has several RIFF
    segments; what bounds it is the size of a binary cell.
    """
    fields = [("id", docs.schema[id_col].dataType.simpleString()), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    fields += [("media", "binary")] * with_media

    def task(batches):
        def rows():
            for doc, n, media, _, means in _rows(batches):
                payload = means.tobytes()
                cuts = shots(means)
                feature = f"frames={len(means)};shots={len(cuts)};cuts={zlib.crc32(cuts.astype('<i8').tobytes()):08x};luma={int(means.sum(dtype=np.int64))}"
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLES:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                yield row + (media,) * with_media

        yield from _batched(rows(), schema, 500 if with_media else 5000)

    ddl = ", ".join(f"{k} {t}" for k, t in fields)
    schema = _arrow(docs, ddl)
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(task, ddl).withColumnRenamed("id", id_col)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI columns: id, clip, first_frame, n_frames, start_s, end_s, error.

    A file that can't be read or decoded, a null one too, gives one row with the reason in ``error`` and nulls beside it;
    a file without frames gives none.
    """
    kind = media.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, clip long, first_frame long, n_frames long, start_s double, end_s double, error string"
    schema = _arrow(media, ddl)

    def task(batches):
        def rows():
            for batch in batches:
                for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    try:
                        fps, means = read_avi(data.as_py() or b"")
                    except (ValueError, KeyError, IndexError, struct.error) as e:
                        yield doc, None, None, None, None, None, f"{type(e).__name__}: {e}"
                        continue
                    cuts = [*shots(means).tolist(), len(means)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        yield doc, k, a, b - a, a / max(fps, 1), b / max(fps, 1), None

        yield from _batched(rows(), schema)

    rows = media.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(media_col)).alias("media"))
    return rows.mapInArrow(task, ddl).withColumnRenamed("id", id_col)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def op2_avi_mjpeg(spark, sf_dir):
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def media_clips(spark, sf_dir):
    """The timed clips of all documents' media: id, clip, first_frame, n_frames, start_s, end_s, error."""
    return clips(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=True))
