"""GIF media columns: texts as palette images, and the decoder that reads GIF files into timed frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

ROW = 192  # samples in a row of the images that hold texts
ROWS = 256  # rows of a frame at most
BINS = 16
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _widths(min_size: int, count: int) -> np.ndarray:
    """Bits of each code after a clear code. The table gets an entry with every code but the first."""
    entries = (1 << min_size) + 1 + np.arange(count)
    return np.clip(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, min_size + 1, 12)


_SCHEDULE = {m: _widths(m, 4096) for m in range(2, 9)}
_ENDS = {m: np.cumsum(w) for m, w in _SCHEDULE.items()}
_ROOTS = {m: [bytes([i]) for i in range(1 << m)] + [b"", b""] for m in _SCHEDULE}


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """The code stream of the samples, with a clear code whenever the table is full."""
    clear, end, schedule = 1 << min_size, (1 << min_size) + 1, _SCHEDULE[min_size]
    codes: list[int] = []
    widths: list[np.ndarray] = [np.array([min_size + 1])]
    all_codes: list[np.ndarray] = [np.array([clear])]
    table: dict[int, int] = {}
    free, prefix, find = end + 1, -1, table.get
    for byte in samples:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = find(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = byte
        table[key] = free
        free += 1
        if free == 4096:  # the table is full: flush, clear and begin anew
            codes.append(prefix)
            prefix = -1
            codes.append(clear)
            all_codes.append(np.array(codes))
            widths.append(schedule[: len(codes)])
            codes, free = [], end + 1
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end)
    all_codes.append(np.array(codes))
    widths.append(schedule[: len(codes)])
    code, width = np.concatenate(all_codes).astype(np.uint16), np.concatenate(widths)
    bits = np.unpackbits(code.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_size: int, expected: int) -> bytes:
    """The samples of a code stream: any legal stream, with deferred or repeated clear codes."""
    clear, end, schedule = 1 << min_size, (1 << min_size) + 1, _SCHEDULE[min_size]
    size, base = 8 * len(stream), _ROOTS[min_size]
    words = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    words = words[:-2] | words[1:-1] << 8 | words[2:] << 16  # 24 bits from each byte on
    out: list[bytes] = []
    at, got = 0, 0
    while at < size and got < expected:
        # the codes up to the next clear code, each as wide as its place since the last one says
        n = int(np.searchsorted(_ENDS[min_size], size - at, "right"))
        if not n:
            break
        width, ends = schedule[:n], at + _ENDS[min_size][:n]
        begins = ends - width
        codes = words[begins >> 3] >> (begins & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            table, last = base.copy(), b""
            add, put = table.append, out.append
            first, *rest = codes[:stop].tolist()
            last = table[first]
            put(last)
            got += len(last)
            for code in rest:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("code beyond the table")
                if len(table) < 4096:
                    add(last + entry[:1])
                put(entry)
                last = entry
                got += len(entry)
        if len(stops):
            if codes[stop] == end:
                break
            at = int(ends[stop])
        elif n < len(schedule):
            break
        else:  # more than 4096 codes without a clear code: the table stays as it is, all codes have 12 bits
            at = int(ends[-1])
            while at + 12 <= size:
                code = int(words[at >> 3]) >> (at & 7) & 4095
                at += 12
                if code in (clear, end):
                    break
                put(table[code])
                got += len(table[code])
            if code == end:
                break
    return b"".join(out)[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b)]) + b for b in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(payload: bytes, delay: int = 4) -> bytes:
    """A GIF whose palette is the 256 greys and whose frames, laid over one another, hold the payload row by row.

    The payload's length is a positive multiple of 192; each frame but the last has 256 rows.
    """
    step = ROW * ROWS
    height = min(ROWS, len(payload) // ROW)
    parts = [b"GIF89a", struct.pack("<HHBBB", ROW, height, 0xF7, 0, 0), GREY.tobytes()]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """pixels: the canvas (height, width, 4) once this frame is drawn; indices: what the frame itself stores."""

    delay: int
    box: tuple[int, int, int, int]
    indices: np.ndarray
    palette: np.ndarray
    pixels: np.ndarray


def read_gif(data: bytes, canvas: bool = True) -> Iterator[Frame]:
    """The frames in order: palettes (local before global), interlacing, transparency, and disposal (keep, background, previous).

    canvas=False skips the drawing; pixels is then the frame's own rectangle with its palette applied. Damaged or truncated data
    raises ValueError at the place of the damage, after the whole frames before it.
    """
    try:
        yield from _frames(data, canvas)
    except (IndexError, struct.error, KeyError) as error:
        raise ValueError("truncated GIF") from error


def _frames(data: bytes, canvas: bool) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8) if canvas else None
    delay, disposal, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label, at = data[at], at + 1
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 1)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = shared
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            min_size, at = data[at], at + 1
            pieces = []
            while data[at]:
                pieces.append(data[at + 1 : at + 1 + data[at]])
                at += data[at] + 1
            at += 1
            raw = lzw_decode(b"".join(pieces), min_size, w * h) if 2 <= min_size <= 8 else b""
            if len(raw) < w * h or palette is None or not 2 <= min_size <= 8:
                raise ValueError("truncated or damaged image")
            indices = np.frombuffer(raw, np.uint8).reshape(h, w)
            if packed & 0x40:
                order = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(palette), :3] = palette
            colours[:, 3] = 255
            drawn = colours.view(np.uint32)[:, 0][indices].view(np.uint8).reshape(h, w, 4)
            if canvas:
                before = screen.copy() if disposal == 3 else None
                area = screen[y : y + h, x : x + w]
                part = drawn[: area.shape[0], : area.shape[1]]
                seen = np.ones(part.shape[:2], bool) if clear_index is None else indices[: area.shape[0], : area.shape[1]] != clear_index
                area[seen] = part[seen]
                yield Frame(delay, (x, y, w, h), indices, colours[:, :3], screen.copy())
                if disposal == 2:
                    area[:] = 0
                elif disposal == 3:
                    screen = before
            else:
                yield Frame(delay, (x, y, w, h), indices, colours[:, :3], drawn)
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError("unknown block")
    if at >= len(data):
        raise ValueError("no end of file mark")


def colour_histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Pixels of the frame's own rectangle by colour: `bins` classes of luminance, from palette counts."""
    counts = np.bincount(frame.indices.ravel(), minlength=256)
    light = (frame.palette.astype(np.int64) @ np.array([299, 587, 114])) // 1000
    return np.bincount(light * bins // 256, counts, minlength=bins).astype(np.int64)


def frame_table(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Decode a binary column of GIF files: one row for each frame: id, frame, at_cs (start in hundredths), delay_cs, width, height, histogram, rgba (the drawn canvas), error.

    A null or empty file gives no row. A damaged one gives its whole frames and one more row that has only frame, at_cs and
    error, so a bad file neither ends the job nor passes for a good one. Repeated rows give repeated frames.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def decode(batches):
        for batch in batches:
            for key, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                at, rows = 0, []
                try:
                    for k, f in enumerate(read_gif(data) if data else ()):
                        rows.append((key, k, at, f.delay, f.pixels.shape[1], f.pixels.shape[0], colour_histogram(f).tolist(), f.pixels.tobytes(), None))
                        at += f.delay
                except ValueError as damage:
                    rows.append((key, len(rows), at, None, None, None, None, None, str(damage)))
                if rows:
                    names = ["id", "frame", "at_cs", "delay_cs", "width", "height", "histogram", "rgba", "error"]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names).cast(target)

    target = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()), ("frame", pa.int32()), ("at_cs", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64())), ("rgba", pa.binary()), ("error", pa.string())])
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(decode, f"id {kind}, frame int, at_cs int, delay_cs int, width int, height int, histogram array<bigint>, rgba binary, error string").withColumnRenamed("id", id_col)


def _padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each whole text as a GIF and read it back: id, n_bytes, media columns, and the media itself if wanted.

    payload_* are taken from the drawn canvas of each decoded frame, media_* from the stored file; `feature` is frames, playing
    time and the luminance histogram over all frames, which sums to the payload's length; `frames` are the timed frames, each
    with its own histogram. Null text counts as empty (one row of blanks). Each row depends on its own whole text alone, so
    repeated rows and equal texts give equal values. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    timed_type = pa.list_(pa.struct([("at_cs", pa.int32()), ("delay_cs", pa.int32()), ("rows", pa.int32()), ("histogram", pa.list_(pa.int64()))]))

    def store(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for text in texts.slice(lo, 256):
                    text = text.as_py()
                    media = write_gif(_padded(text))
                    frames, hist, time, read = 0, np.zeros(BINS, np.int64), 0, []
                    timed = []
                    for f in read_gif(media):
                        x, y, w, h = f.box
                        own = colour_histogram(f)
                        timed.append({"at_cs": time, "delay_cs": f.delay, "rows": h, "histogram": own.tolist()})
                        frames, time, hist = frames + 1, time + f.delay, hist + own
                        read.append(f.pixels[y : y + h, x : x + w, 0].tobytes())
                    payload = b"".join(read)
                    feature = f"{frames}:{time}:" + ",".join(map(str, hist))
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, timed, media if keep_media else None))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), timed_type, pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "media"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames array<struct<at_cs:int,delay_cs:int,rows:int,histogram:array<bigint>>>, media binary"
    return rows.mapInArrow(store, schema).withColumnRenamed("id", id_col)
