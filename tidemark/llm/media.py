"""Media columns: AVI files of motion-JPEG frames held in a binary column.

A frame is a lossless JPEG (process 14, SOF3: 8-bit grey samples, left predictor, Huffman-coded differences) with a
restart interval of one row, so every row is an independent entropy-coded segment. Both directions work on many rows
at once with numpy: the decoder advances one symbol in all segments of a batch per step. Every frame is intra-coded.
Shots are found from differences between the grey histograms of neighbouring frames; the threshold adapts to the mean
and deviation of the differences that went before.
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

from .common import id_and_text, pieces, raw_texts, spans_of, tidy

WIDTH = 64
MAX_HEIGHT = 64
FPS = 25
BATCH_ROWS = 32768
BINS = 32
# The usual luminance DC code of baseline JPEG (number of codes of each length 1..16, then the symbols).
CODE_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
CODE_SYMBOLS = tuple(range(12))


def canonical_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a JPEG Huffman table."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


@lru_cache(1)
def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of every difference from -255 to 255."""
    codes = canonical_codes(CODE_COUNTS, CODE_SYMBOLS)
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = codes[size]
        bits[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
        sizes[d + 255] = length + size
    return bits, sizes


@lru_cache(8)
def _decode_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window: (difference + 65536) * 32 + bits used; -1 where no code starts or it is longer."""
    table = np.full(65536, -1, np.int64)
    for size, (code, length) in canonical_codes(counts, symbols).items():
        if (used := length + size) > 16:
            continue
        extra = np.arange(1 << size)
        diff = np.where(extra >> max(size - 1, 0) > 0, extra, extra - (1 << size) + 1) if size else np.zeros(1, int)
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = np.repeat((diff + 65536) * 32 + used, 1 << (16 - used))
    return table


@lru_cache(64)
def _jpeg_header(height: int) -> bytes:
    dht = bytes([0, *CODE_COUNTS, *CODE_SYMBOLS])
    return b"".join((
        b"\xff\xd8", b"\xff\xc4", struct.pack(">H", 2 + len(dht)), dht,
        b"\xff\xc3", struct.pack(">HBHHB3B", 11, 8, height, WIDTH, 1, 1, 0x11, 0),
        b"\xff\xdd", struct.pack(">HH", 4, WIDTH),
        b"\xff\xda", struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0),
    ))


def _encode_rows(rows: np.ndarray, closes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all rows with restart markers, and the bytes of each row.

    closes: the row is the last of its frame; number: its place in the frame.
    """
    table, sizes = _encode_tables()
    at = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    bits, used = table[at], sizes[at]
    ends = np.cumsum(used, axis=1)
    pos = ends - used
    stride = 58  # 64 symbols of 14 bits at most, in units of 16 bits, and one to spare
    unit = (np.arange(len(rows)) * stride)[:, None] + (pos >> 4)
    lane = bits << (32 - used - (pos & 15))
    total = len(rows) * stride
    packed = np.bincount(unit.ravel(), (lane >> 16).ravel(), total)
    packed += np.bincount(unit.ravel() + 1, (lane & 0xFFFF).ravel(), total + 1)[:total]
    data = np.zeros((len(rows), stride * 2 + 2), np.uint8)
    data[:, : stride * 2] = packed.astype(">u2").view(np.uint8).reshape(len(rows), -1)
    n_bits = ends[:, -1]
    n_bytes = (n_bits + 7) >> 3
    each = np.arange(len(rows))
    data[each, n_bytes - 1] |= ((1 << (n_bytes * 8 - n_bits)) - 1).astype(np.uint8)
    column = np.arange(data.shape[1])[None, :]
    coded = column < n_bytes[:, None]
    stuffed = (data == 255) & coded
    data[each, n_bytes], data[each, n_bytes + 1] = 255, 0xD0 + number % 8
    keep = column < (n_bytes + np.where(closes, 0, 2))[:, None]
    flat = data[keep]
    if stuffed.any():
        flat = np.insert(flat, np.flatnonzero(stuffed[keep]) + 1, 0)
    return flat, n_bytes + np.where(closes, 0, 2) + stuffed.sum(axis=1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], height: int, n_bytes: int, n_payload: int) -> bytes:
    biggest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d payload=%d\0" % (n_bytes, n_payload)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(c := _chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def encode_many(contents: list[bytes]) -> list[bytes]:
    """An AVI file for each content: padded with bytes 0 to a positive multiple of 64, 64 samples a row."""
    plans, blocks, shape = [], [], []
    for content in contents:
        n_rows = max(1, -(-len(content) // WIDTH))
        n_frames = -(-n_rows // MAX_HEIGHT)
        height = -(-n_rows // n_frames)
        plans.append((height, n_frames, len(content), n_rows * WIDTH))
        blocks.append(content.ljust(n_frames * height * WIDTH, b"\0"))
        shape.append((n_frames, height))
    samples = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, WIDTH)
    frame_rows = np.concatenate([np.full(n, h) for n, h in shape])
    row_ends = np.cumsum(frame_rows)
    frames: list[bytes] = []
    first = 0
    while first < len(frame_rows):  # whole frames, BATCH_ROWS rows at most, or one frame
        row0 = row_ends[first] - frame_rows[first]
        last = max(first + 1, int(np.searchsorted(row_ends, row0 + BATCH_ROWS, "right")))
        counts = frame_rows[first:last]
        ends = np.cumsum(counts)
        closes = np.zeros(ends[-1], bool)
        closes[ends - 1] = True
        number = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        flat, sizes = _encode_rows(samples[row0 : row0 + ends[-1]], closes, number)
        cuts, raw = spans_of(sizes)[np.concatenate(([0], ends))], flat.tobytes()
        frames += [_jpeg_header(int(h)) + raw[a:b] + b"\xff\xd9" for h, a, b in zip(counts, cuts[:-1], cuts[1:], strict=True)]
        first = last
    out, at = [], 0
    for height, n, n_bytes, n_payload in plans:
        out.append(_avi(frames[at : at + n], height, n_bytes, n_payload))
        at += n
    return out


class Avi:
    """What parse_avi finds: frames (byte ranges of the file, in the order of the index), timing, notes."""

    __slots__ = ("fps", "frames", "height", "notes", "width")


def parse_avi(media: bytes) -> Avi:
    """Walks the RIFF chunks; frames come from idx1, or from movi itself where the index is missing."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = Avi()
    out.fps, out.frames, out.notes, out.width, out.height = float(FPS), [], {}, 0, 0
    movi, movi_end, index = 0, 0, []

    def walk(at: int, end: int) -> None:
        nonlocal movi, movi_end, index
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST" and media[body : body + 4] == b"movi":
                movi, movi_end = body, body + size
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"strh" and media[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", media, body + 20)
                out.fps = rate / max(scale, 1)
            elif name == b"strf":
                out.width, out.height = struct.unpack_from("<ii", media, body + 4)
            elif name == b"ICMT":
                out.notes = dict(x.split("=") for x in media[body : body + size].rstrip(b"\0").decode().split() if "=" in x)
            elif name == b"idx1":
                index = [x[2:] for x in struct.iter_unpack("<4sIII", media[body : body + size // 16 * 16]) if x[0][2:] in (b"dc", b"db")]
            at = body + size + (size & 1)

    walk(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))
    if not index and movi:
        at = movi + 4
        while at + 8 <= movi_end:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            if media[at + 2 : at + 4] in (b"dc", b"db"):
                index.append((at - movi, size))
            at += 8 + size + (size & 1)
    out.frames = [(movi + offset + 8, movi + offset + 8 + size) for offset, size in index]
    return out


@lru_cache(256)
def _jpeg_geometry(head: bytes) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
    """(height, width, code counts, symbols) of the markers from SOI to SOS; raises for other JPEG processes."""
    at, height, width, restart, counts, symbols, predictor = 2, 0, 0, 0, (), (), 0
    while at < len(head):
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if kind == 0xC4:
            counts = tuple(body[1:17])
            symbols = tuple(body[17 : 17 + sum(counts)])
        elif kind == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit frames of one component")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only lossless sequential frames")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            predictor = body[3]
        at += 2 + size
    if not width or restart != width or predictor != 1:
        raise ValueError("only frames with a restart interval of one row and predictor 1")
    return height, width, counts, symbols


def _scan_start(jpeg: bytes) -> int:
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Samples (height x width, uint8) of every frame; frames of one width and Huffman table are decoded together."""
    out: list = [None] * len(jpegs)
    groups: dict[tuple, list[tuple[int, int, bytes]]] = {}
    for k, jpeg in enumerate(jpegs):
        start = _scan_start(jpeg)
        height, width, counts, symbols = _jpeg_geometry(jpeg[:start])
        groups.setdefault((width, counts, symbols), []).append((k, height, jpeg[start:-2]))
    for (width, counts, symbols), members in groups.items():
        rows = _decode_rows([x[2] for x in members], [x[1] for x in members], width, _decode_table(counts, symbols))
        at = 0
        for k, height, _ in members:
            out[k] = rows[at : at + height]
            at += height
    return out


def _decode_rows(scans: list[bytes], heights: list[int], width: int, table: np.ndarray) -> np.ndarray:
    begins = spans_of(np.array([len(x) for x in scans]))
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0\0", np.uint8)
    ff = np.flatnonzero(raw == 255)
    after = raw[np.minimum(ff + 1, len(raw) - 1)]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.sort(np.concatenate((ff[after == 0] + 1, marks, marks + 1)))
    starts = np.sort(np.concatenate((begins[:-1], marks + 2)))
    if len(starts) != sum(heights):
        raise ValueError("rows are missing")
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    clean = raw[keep].astype(np.uint32)
    window = np.zeros(len(clean), np.uint32)
    window[:-2] = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    pos = (starts - np.searchsorted(drop, starts)) * 8
    diffs = np.empty((width, len(pos)), np.int32)
    for x in range(width):
        found = table[window[np.minimum(pos >> 3, len(window) - 1)] >> (8 - (pos & 7)).astype(np.uint32) & 0xFFFF]
        if found.min() < 0:
            raise ValueError("broken entropy-coded data")
        diffs[x] = (found >> 5) - 65536
        pos += found & 31
    return np.ascontiguousarray((np.cumsum(diffs, axis=0) + 128).astype(np.uint8).T)


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Share of samples in each of BINS grey levels, a row for each frame."""
    sizes = np.array([f.size for f in frames])
    level = np.concatenate([f.ravel() for f in frames]) >> 3
    counts = np.bincount(np.repeat(np.arange(len(frames)) * BINS, sizes) + level, minlength=len(frames) * BINS)
    return counts.reshape(-1, BINS) / sizes[:, None]


def shot_starts(hist: np.ndarray, window: int = 8, k: float = 3.0, least: float = 0.12) -> list[int]:
    """Frames that begin a shot: the histogram differs from the last frame's by more than the mean plus k deviations
    of up to `window` differences since the shot began, and by `least` (half the L1 distance) at least."""
    starts, recent = [0], []
    for t in range(1, len(hist)):
        d = float(np.abs(hist[t] - hist[t - 1]).sum()) / 2
        if d > max(least, (np.mean(recent) + k * np.std(recent)) if recent else least):
            starts.append(t)
            recent = []
        else:
            recent = [*recent[1 - window :], d]
    return starts


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as an AVI file; null and empty texts give one row of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                yield pa.record_batch([part.column(0), pa.array(encode_many(raw_texts(part.column(1))), pa.binary())], ["doc_id", "media"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of (doc_id, media): one row for each shot. A null file yields no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                avi = parse_avi(data)
                if not avi.frames:
                    continue
                starts = shot_starts(histograms(decode_frames([data[a:b] for a, b in avi.frames])))
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(avi.frames)], strict=True)):
                    rows.append({"doc_id": doc_id, "clip": n, "start_s": a / avi.fps, "end_s": b / avi.fps, "n_frames": b - a})
            yield pa.RecordBatch.from_pylist(rows, schema=_CLIP)

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, clip int, start_s double, end_s double, n_frames int")


_CLIP = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("n_clips", pa.int32())])


def read_back(media: list[bytes]) -> list[tuple]:
    """For each file: its features, from what is stored in it alone."""
    parsed = [parse_avi(x) for x in media]
    frames: list[np.ndarray] = []
    flat = [m[a:b] for m, p in zip(media, parsed, strict=True) for a, b in p.frames]
    first, budget = 0, 0
    for k, jpeg in enumerate(flat):
        budget += len(jpeg)
        if budget >= 4 << 20 or k == len(flat) - 1:
            frames += decode_frames(flat[first : k + 1])
            first, budget = k + 1, 0
    hist = histograms(frames)
    out, at = [], 0
    for data, p in zip(media, parsed, strict=True):
        own, h = frames[at : at + len(p.frames)], hist[at : at + len(p.frames)]
        at += len(p.frames)
        payload = b"".join(f.tobytes() for f in own)[: int(p.notes["payload"])]
        starts = shot_starts(h)
        mean = h.mean(axis=0)
        feature = f"fps={p.fps:g};size={p.width}x{p.height};frames={len(own)};cuts={','.join(map(str, starts))};peak={int(mean.argmax())};hist={','.join(str(round(v * 1000)) for v in mean)}"
        out.append((int(p.notes["bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(own), len(starts)))
    return out


def media_features(docs: DataFrame) -> DataFrame:
    """Every text stored as an AVI file and read back from it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames,
    n_clips. A null text counts as empty and is stored as 64 zero samples; equal texts give equal values; a null doc_id
    stays null; an empty table gives no rows. Batches hold about 2 MB of text, and a longer text goes alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                found = read_back(encode_many(raw_texts(part.column(1))))
                columns = list(zip(*found, strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_FEATURES)[1:], strict=True))], schema=_FEATURES)

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_clips int")
