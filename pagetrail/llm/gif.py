"""GIF columns: a writer for 8-bit samples, and a decoder of LZW streams, palettes, disposal, transparency and frame times.

The decoder gives whole composed frames with colour histograms. A code's width in a GIF stream follows from its place after the last
clear code alone, so codes are cut from the bit stream by NumPy and only the table walk is a loop.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import per_row, text_or_empty

WIDTH = 64
#: Rows of a frame at most; longer payloads take several frames.
ROWS = 1024
DELAY_CS = 10
BINS = 8
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first n codes after a clear code, with palettes of ``bits`` bits."""
    table = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(table + 1)).astype(np.int64), bits + 1, 12)


_W8 = _widths(4096, 8)


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as GIF LZW codes, packed; the table is cleared when it is full."""
    if not data:
        return _pack([256, 257], [0, 1])
    codes, places = [256], [0]
    out, table, free, first = [], {}, 258, 0
    it = iter(data)
    prefix = next(it)
    get = table.get
    for c in it:
        key = prefix << 8 | c
        code = get(key)
        if code is not None:
            prefix = code
            continue
        out.append(prefix)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            out.append(256)
            codes += out
            places.extend(range(len(out)))
            out, free = [], 258
            table.clear()
        prefix = c
    out += [prefix, 257]
    codes += out
    places.extend(range(len(out)))
    return _pack(codes, places, first)


def _pack(codes: list[int], places: list[int], _first: int = 0) -> bytes:
    v, w = np.array(codes, np.int64), _W8[np.minimum(np.array(places), 4095)]
    w[0] = 9
    bits = (v[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < w[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """The samples of a packed stream: ``size`` at most, fewer if the stream ends or breaks earlier."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out, got = len(data) * 8, 0, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, place = base[:], b"", 0
    while at < total and got < size:
        w = _W8[place : place + 4096] if bits == 8 and place == 0 else _widths(place + 4096, bits)[place:]
        o = at + np.concatenate(([0], np.cumsum(w)))
        n = int(np.searchsorted(o, total, side="right")) - 1
        if n < 1:
            break
        w, o, stops = w[:n], o[: n + 1], o[:n]
        b = stops >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (stops & 7)) & ((1 << w) - 1)
        mark = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(mark[0]) if len(mark) else n
        add, put, free = table.append, out.append, len(table)
        for c in codes[:upto].tolist():
            if c < free:
                e = table[c]
            elif c == free and prev:
                e = prev + prev[:1]
            else:
                return b"".join(out)[:size]
            put(e)
            got += len(e)
            if prev and free < 4096:
                add(prev + e[:1])
                free += 1
            prev = e
        if not len(mark):
            at, place = int(o[n]), place + n
            continue
        if codes[upto] == end:
            break
        at, table, prev, place = int(o[upto + 1]), base[:], b"", 0
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, *, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames hold ``payload`` in order, ``width`` grey samples a row; its length is a positive multiple of ``width``."""
    step = width * rows
    tall = min(rows, len(payload) // width)
    parts = [b"GIF89a", width.to_bytes(2, "little"), tall.to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        parts += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join([*parts, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def gif_frames(data: bytes) -> Iterator[dict]:
    """Composed frames in order: ``frame_no, start_ms, delay_ms, disposal, left, top, width, height, rgb`` (the canvas, rows by columns by
    3), ``area`` (the frame's own part of it) and ``hist`` (3 by BINS counts of the area). Frames before damage are still given."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return
    wide, tall, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common, at = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((tall, wide, 3), np.uint8)
    disposal, delay, clear, no, start = 0, 0, None, 0, 0
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10, body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(data):
            return
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
        flags, at = data[at + 8], at + 9
        palette = common
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3), at + n
        if palette is None or at >= len(data) or not 2 <= data[at] <= 8:
            return
        bits = data[at]
        body, at = _sub_blocks(data, at + 1)
        got = lzw_decode(body, bits, w * h)
        index = np.frombuffer(got.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index, packed = np.empty_like(index), index
            index[order] = packed
        full = palette if len(palette) == 256 else np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])
        colour = full[index]
        before = canvas.copy() if disposal == 3 else None
        seen_h, seen_w = max(0, min(h, tall - top)), max(0, min(w, wide - left))
        area = canvas[top : top + seen_h, left : left + seen_w]
        if clear is None:
            area[:] = colour[:seen_h, :seen_w]
        else:
            shown = index[:seen_h, :seen_w] != clear
            area[shown] = colour[:seen_h, :seen_w][shown]
        counts = np.bincount((area >> 5).reshape(-1, 3).astype(np.int64).ravel() * 3 + np.tile(np.arange(3), area.shape[0] * area.shape[1]), minlength=3 * BINS)
        yield {"frame_no": no, "start_ms": start, "delay_ms": delay, "disposal": disposal, "left": left, "top": top, "width": w, "height": h, "rgb": canvas, "area": area, "hist": counts.reshape(BINS, 3).T, "whole": len(got) == w * h}
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        no, start, disposal, delay, clear = no + 1, start + delay, 0, 0, None


FRAME = "frame_no int, start_ms long, delay_ms int, disposal int, left_px int, top_px int, width int, height int, whole boolean, rgb binary, hist_red array<long>, hist_green array<long>, hist_blue array<long>"


def frame_rows(data: bytes | None) -> Iterator[dict]:
    """The frames of a GIF as rows of FRAME."""
    for f in gif_frames(bytes(data or b"")):
        red, green, blue = (x.tolist() for x in f["hist"])
        yield {k: f[k] for k in ("frame_no", "start_ms", "delay_ms", "disposal", "width", "height", "whole")} | {"left_px": f["left"], "top_px": f["top"], "rgb": f["rgb"].tobytes(), "hist_red": red, "hist_green": green, "hist_blue": blue}


def decode_frames(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF: ``doc_id`` and the columns of FRAME: times, geometry, disposal, the composed canvas as RGB bytes
    and three histograms of the frame's area.

    Transparent samples leave what is below; disposal 2 clears the frame's area to black and disposal 3 restores what was there. Null or
    empty media, and what isn't a GIF, give no frame; a damaged stream gives the frames before the damage and one with ``whole`` false,
    its missing samples as palette entry 0. Null ids stay null, repeated rows repeat, an empty table gives an empty result. Other
    columns play no part. A worker holds one frame and its canvas at a time.
    """
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(FRAME)])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for f in frame_rows(b.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([f[x.name]], x.type) for x in list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(decode, schema)


def to_gif(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, stored as a GIF of grey samples.

    A null text counts as empty and gives one row of zeros; null ids stay null. One row goes in and one comes out, so repeated rows stay
    repeated and an empty table stays empty. Other columns play no part.
    """

    def make():
        return lambda data: {"media": [encode_gif(x.ljust(max(WIDTH, -(-len(x) // WIDTH) * WIDTH), b"\0")) for x in data]}

    data = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"))
    return per_row(rows, make, "media binary", passed=("doc_id", "n_bytes"))


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, hist_grey array<long>"


def read_back(media: DataFrame) -> DataFrame:
    """Decode what :func:`to_gif` stored, frame by frame: digests of the samples read back and of the stored form, the number of timed
    frames and their time, their summed colour histogram (of greys, so one for all colours), and a feature of all that.

    A row for a row of ``doc_id, n_bytes, media``: null ids stay null, repeated rows repeat, an empty table gives an empty result. Null or
    damaged media give the samples before the damage.
    """

    def make():
        def read(media):
            out = {x.split()[0]: [] for x in READ.split(", ")}
            for data in media:
                data, digest, size, tail, greys, frames, ms = bytes(data or b""), hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0, 0
                for f in gif_frames(data):
                    part = f["area"][:, :, 0].tobytes()
                    digest.update(part)
                    size, tail, greys, frames, ms = size + len(part), part[-64:], greys + f["hist"][0], frames + 1, f["start_ms"] + f["delay_ms"]
                feature = f"{WIDTH}x{size // WIDTH};frames={frames};ms={ms};grey=" + ",".join(map(str, greys.tolist()))
                told = (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, frames, ms, greys.tolist())
                for column, value in zip(out.values(), told, strict=True):
                    column.append(value)
            return out

        return read

    return per_row(media.select("doc_id", "n_bytes", "media"), make, READ, passed=("doc_id", "n_bytes"))
