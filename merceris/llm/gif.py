"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ids_and_texts

CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
#: Canvas of a stored payload: rows of 64 samples, at most so many rows in one frame.
WIDTH, ROWS = 64, 512
DELAY = 4  # hundredths of a second for each frame

#: Bit width of the k-th data code after a clear, and where its bits start.
_TABLE = np.maximum(9, np.minimum(12, np.ceil(np.log2(np.maximum(FIRST, FIRST - 1 + np.arange(FULL - FIRST + 1)) + 1)))).astype(np.int64)
_STARTS = np.concatenate([[0], np.cumsum(_TABLE)])
_MASKS = (1 << _TABLE) - 1
#: The same for codes that follow a full table.
_LATE = np.arange(FULL + 1) * 12
_LATE_MASKS = np.full(FULL, 4095)
_LITERAL = [bytes([c]) for c in range(256)] + [b"", b""]
_GREY = bytes(c for c in range(256) for _ in range(3))


def lzw_encode(samples: bytes) -> bytes:
    """The code stream (8-bit samples): clear, codes, end; cleared again whenever the table is full."""
    codes, widths = [CLEAR], [_TABLE[:1]]
    # a phrase is a dict of the phrases one sample longer; its own code is under -1
    root = [{-1: c} for c in range(256)]
    begun, free, add = 1, FIRST, codes.append
    phrase = root[samples[0]]
    for c in samples[1:]:
        if c in phrase:
            phrase = phrase[c]
            continue
        add(phrase[-1])
        if free == FULL - 1:
            add(CLEAR)
            widths.append(_TABLE[: len(codes) - begun])
            begun, free = len(codes), FIRST
            root = [{-1: c} for c in range(256)]
        else:
            phrase[c] = {-1: free}
            free += 1
        phrase = root[c]
    codes += [phrase[-1], END]
    widths.append(_TABLE[: len(codes) - begun])
    return pack(np.array(codes, np.int64), np.concatenate(widths))


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits, least significant bit first."""
    starts = np.cumsum(widths) - widths
    at, spread = starts >> 3, codes << (starts & 7)
    out = np.zeros(int(at[-1]) + 4, np.int64)
    for k in range(3):
        out += np.bincount(at + k, weights=(spread >> (8 * k)) & 255, minlength=len(out)).astype(np.int64)
    return out[: (int(starts[-1] + widths[-1]) + 7) >> 3].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, minimum: int = 8) -> bytes:
    """Samples of a code stream; any clears, and full tables that go on at 12 bits."""
    if minimum != 8:
        return _decode_any(stream, minimum)
    bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    words = bits[:-2] | bits[1:-1] << 8 | bits[2:] << 16
    end, at, out = len(stream) * 8, 0, []
    literal = _LITERAL
    table, last, full, put = list(literal), b"", False, out.append
    while at + 9 <= end:
        template, masks = (_LATE, _LATE_MASKS) if full else (_STARTS, _MASKS)
        keep = int(np.searchsorted(template, end - at, side="right")) - 1
        starts = at + template[:keep]
        codes = words[starts >> 3] >> (starts & 7) & masks[:keep]
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else len(codes)
        data = codes[:stop].tolist()
        if data and not last:
            last = table[data[0]]
            put(last)
            data = data[1:]
        room = FULL - len(table)
        add = table.append
        for code in data[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("broken LZW stream") from None
                entry = last + last[:1]
            put(entry)
            add(last + entry[:1])
            last = entry
        if room < len(data):
            out += map(table.__getitem__, data[room:])
        if stop == len(codes):
            if not len(codes):
                break
            at, full = at + int(template[keep]), True
        elif codes[stop] == END:
            break
        else:
            at += int(template[stop + 1])
            table, last, full = list(literal), b"", False
    return b"".join(out)


def _decode_any(stream: bytes, minimum: int) -> bytes:
    clear, end = 1 << minimum, (1 << minimum) + 1
    number, at, out, last = int.from_bytes(stream, "little"), 0, [], b""
    table, width = [bytes([c]) for c in range(clear)] + [b"", b""], minimum + 1
    while at + width <= len(stream) * 8:
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == end:
            break
        if code == clear:
            table, width, last = table[: clear + 2], minimum + 1, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("broken LZW stream")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last and len(table) < FULL:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = entry
    return b"".join(out)


@dataclass
class Frame:
    """A timed picture: the canvas (rows, columns, RGB) after the frame was drawn, and the frame's own samples."""

    delay: int
    canvas: np.ndarray
    samples: np.ndarray
    colours: np.ndarray


def decode_gif(data: bytes) -> list[Frame]:
    """All frames of a GIF, with palettes, transparency, offsets and disposal applied. Raises ValueError if it is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, ground, at = data[10], data[11], 13
    shared = None
    if flags & 128:
        size = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
        at += size
    blank = shared[ground] if shared is not None and ground < len(shared) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[...] = blank
    frames: list[Frame] = []
    delay, disposal, clear = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else -1
        elif data[at] == 0x2C:
            left, top, wide, high = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            own, at = data[at + 9], at + 10
            colours = shared
            if own & 128:
                size = 3 << ((own & 7) + 1)
                colours = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
                at += size
            if colours is None:
                raise ValueError("no palette")
            minimum = data[at]
            stream, at = blocks(at + 1)
            flat = np.frombuffer(lzw_decode(stream, minimum), np.uint8)
            if len(flat) < wide * high:
                raise ValueError("short frame")
            samples = flat[: wide * high].reshape(high, wide)
            if own & 64:  # interlaced
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, high, step)]
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            before = canvas.copy() if disposal == 3 else None
            window = canvas[top : top + high, left : left + wide]
            drawn = colours[samples]
            seen = drawn[: window.shape[0], : window.shape[1]]
            window[...] = np.where((samples != clear)[: window.shape[0], : window.shape[1], None], seen, window) if clear >= 0 else seen
            frames.append(Frame(delay, canvas.copy(), samples, drawn))
            if disposal == 2:
                canvas[top : top + high, left : left + wide] = blank
            elif before is not None:
                canvas = before
            delay, disposal, clear = 0, 0, -1
        else:
            raise ValueError("unknown block")
    return frames


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A payload (a positive multiple of ``width``) as grey samples in frames of at most ``rows`` rows."""
    high = len(payload) // width
    word = lambda n: n.to_bytes(2, "little")
    out = [b"GIF89a", word(width), word(min(high, rows)), b"\xf7\0\0", _GREY]
    for first in range(0, high, rows):
        part = payload[first * width : (first + rows) * width]
        out += [b"\x21\xf9\x04", bytes([1 << 2]), word(delay), b"\0\0", b"\x2c\0\0\0\0", word(width), word(len(part) // width), b"\0\x08"]
        stream = lzw_encode(part)
        out += [bytes([len(x := stream[k : k + 255])]) + x for k in range(0, len(stream), 255)] + [b"\0"]
    return b"".join(out) + b";"


def histogram(frames: list[Frame], bins: int = 8) -> list[int]:
    """Counts of the drawn pixels by brightness."""
    total = np.zeros(256, np.int64)
    for frame in frames:
        total += np.bincount((frame.colours.sum(axis=2, dtype=np.int32) // 3).ravel(), minlength=256)
    return total.reshape(bins, -1).sum(axis=1).tolist()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, duration_cs long, histogram array<long>, feature string"


def gif_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text's padded bytes as a GIF, decode the stored bytes and describe what was read.

    The payload is the UTF-8 text with bytes 0 up to the next positive multiple of 64 (an empty or null text: 64 bytes
    0). Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (both of the bytes read back), media_bytes,
    media_sha256, frames, duration_cs, histogram (8 brightness bins of drawn pixels), feature, and media with
    ``keep_media``. Equal texts have equal values; rows are kept as they come, other columns are ignored, and an empty
    table gives no rows. One narrow pass, no shuffle; a task holds one GIF at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows, made = batch.iloc[at : at + 500], [], {}
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    if text in made:
                        rows.append((doc, *made[text]))
                        continue
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    media = encode_gif(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
                    frames = decode_gif(media)
                    back = b"".join(f.colours[:, :, 0].tobytes() for f in frames)
                    bins, long = histogram(frames), sum(f.delay for f in frames)
                    feature = f"frames={len(frames)};cs={long};hist={','.join(map(str, bins))}"
                    made[text] = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(frames), long, bins, feature, *([media] * keep_media))
                    rows.append((doc, *made[text]))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = SCHEMA + ", media binary" * keep_media
    names = [x.split()[0] for x in schema.split(", ")]
    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema)
