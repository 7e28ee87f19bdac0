"""Media columns: baseline JPEG.  Markers are parsed, scans Huffman-decoded, and luminance thumbnails rebuilt from the DC
coefficients alone, one pixel a block.

``decode`` takes any baseline (SOF0, 8-bit, Huffman, one interleaved scan) stream: any sampling factors, tables and restart intervals.  All restart
segments of all images of a batch that share tables are decoded in step by numpy, a symbol of each at a time.

``store`` keeps bytes losslessly in a baseline JPEG: a byte is the DC level of one 8 x 8 block (quantizer 8, so a block
is flat in that grey), AC is empty, and each row of 24 blocks is a restart segment.  The DC thumbnail is the payload.  An
image has 8000 rows at most; payloads of more become several streams in a row.

Feature: dimensions in pixels and a thumbnail hash: 64 bits, of an 8 x 8 grid of mean thumbnail grey levels, set where
above the mean of the grid.

Memory.  A task holds one row's text or media and the arrays of ``AT_ONCE`` payload bytes, some 60 times that.

Cases.  Null text: empty.  Empty text: 576 bytes of 255.  Null doc_id stays null; rows that repeat one are rows of their own.
Very long texts: several streams, in turn.  Damaged streams, and those of another kind than above, raise ValueError.  Empty
table: empty result.  Equal texts give equal values.  Other columns, whatever their names, aren't carried.  Ties with the
mean of a grid: not set.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfield.llm import runtime
from gridfield.llm.runtime import release

runtime.ship(sys.modules[__name__])

UNIT, WIDE, MOST_ROWS = 576, 24, 8000
#: Code lengths 1 to 16 and symbols of the luminance DC table in ITU T.81, table K.3 (fixed values).
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
#: One AC symbol: end of block.
AC_COUNTS, AC_SYMBOLS = (1, *(0,) * 15), (0,)
#: Payload bytes that are packed or decoded at a time.
AT_ONCE = 400_000


def canonical(counts, symbols) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0: no code."""
    table = np.zeros(1 << 16, np.int32)
    for code, length, symbol in canonical(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int) -> bytes:
    """All before the scan's data, for a grey image of width x height blocks."""
    tables = b"".join(bytes([kind << 4]) + bytes(c) + bytes(s) for kind, c, s in ((0, DC_COUNTS, DC_SYMBOLS), (1, AC_COUNTS, AC_SYMBOLS)))
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 1) + b"\x01\x11\x00") + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", width)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _level_codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 256: a block's code (DC symbol, bits, end of block), left-aligned in 32 bits, and its length."""
    by_size = {s: (c, n) for c, n, s in canonical(DC_COUNTS, DC_SYMBOLS)}
    codes, lengths = np.zeros(513, np.uint32), np.zeros(513, np.int64)
    for d in range(-256, 257):
        size = abs(d).bit_length()
        code, n = by_size[size]
        bits = d if d >= 0 else d + (1 << size) - 1
        length = n + size + 1
        codes[d + 256], lengths[d + 256] = (code << size | bits) << 1 << (32 - length), length
    return codes, lengths


def encode_rows(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """levels: rows x blocks of bytes.  The stuffed bytes of all rows, and how many each row has."""
    codes, lengths = _level_codes()
    rows, wide = levels.shape
    d = np.diff(levels.astype(np.int16) - 128, axis=1, prepend=0) + 256
    code, length = np.empty((rows, wide + 1), np.uint32), np.empty((rows, wide + 1), np.int64)
    code[:, :-1], length[:, :-1] = codes[d], lengths[d]
    bits = length[:, :-1].sum(axis=1)
    code[:, -1], length[:, -1] = 0xFFFFFFFF, -bits % 8
    most = int(length.max(initial=1))
    cells = code.astype(">u4").view(np.uint8).reshape(-1, 4)[:, : (most + 7) // 8]
    picked = (np.arange(8 * cells.shape[1])[None, :] < np.arange(most + 1)[:, None])[length.reshape(-1)]
    data = np.packbits(np.unpackbits(np.ascontiguousarray(cells), axis=1)[picked])
    size = (bits + 7) // 8
    full = data == 0xFF
    row = np.repeat(np.arange(rows), size)
    stuffed = np.bincount(row[full], minlength=rows)
    out = np.zeros(len(data) + int(full.sum()), np.uint8)
    out[np.arange(len(data)) + np.cumsum(full) - full] = data
    return out, size + stuffed


def store(payloads: list[bytes]) -> list[bytes]:
    """Baseline JPEG streams that hold the payloads (multiples of 576 bytes)."""
    out, plan = [b""] * len(payloads), []
    for k, p in enumerate(payloads):
        plan += [(k, p[at : at + WIDE * MOST_ROWS]) for at in range(0, len(p), WIDE * MOST_ROWS)]
    for held in _slices(plan, lambda x: len(x[1])):
        levels = np.frombuffer(b"".join(x for _, x in held), np.uint8).reshape(-1, WIDE)
        data, sizes = encode_rows(levels)
        rows_of = [len(x) // WIDE for _, x in held]
        # two bytes after each row: a restart marker, or the end of the image
        spread = np.zeros(len(data) + 2 * len(sizes), np.uint8)
        spread[np.arange(len(data)) + 2 * np.repeat(np.arange(len(sizes)), sizes)] = data
        in_image = np.concatenate([np.arange(r) for r in rows_of])
        last = np.concatenate([np.arange(r) == r - 1 for r in rows_of])
        tail = np.cumsum(sizes) + 2 * np.arange(len(sizes))
        spread[tail], spread[tail + 1] = 0xFF, np.where(last, 0xD9, 0xD0 + in_image % 8)
        edge, raw = np.r_[0, tail[last] + 2], spread.tobytes()
        for (k, _), r, a, b in zip(held, rows_of, edge[:-1], edge[1:], strict=True):
            out[k] += header(WIDE, r) + raw[a:b]
    return out


def parse(stream: bytes) -> list[dict]:
    """The images of concatenated streams: dimensions, components, tables, and the scan's bytes."""
    try:
        return _parse(stream)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"a damaged stream: {e!r}") from e


def _parse(stream: bytes) -> list[dict]:
    images, at, n = [], 0, len(stream)
    now: dict = {}
    while at < n:
        if stream[at] != 0xFF or at + 1 >= n:
            raise ValueError("no marker where one should be")
        marker = stream[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0xD8:
            now, at = {"quant": {}, "tables": {}, "restart": 0}, at + 2
            continue
        if marker == 0xD9:
            if not {"width", "scan"} <= now.keys():
                raise ValueError("an image without its frame or scan")
            images.append(now)
            now, at = {}, at + 2
            continue
        size = struct.unpack_from(">H", stream, at + 2)[0]
        body, at = stream[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                step = 2 if body[k] >> 4 else 1
                now["quant"][body[k] & 15] = int.from_bytes(body[k + 1 : k + 1 + step], "big")  # of DC
                k += 1 + 64 * step
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                now["tables"][body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xC0:
            _, now["height"], now["width"], parts = struct.unpack_from(">BHHB", body)
            now["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            now["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if "scan" in now or body[0] != len(now["parts"]):
                raise ValueError("more than one scan")
            now["uses"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            end = at
            while True:
                end = stream.find(b"\xff", end)
                if end < 0 or end + 1 >= n:
                    raise ValueError("a scan without an end")
                if stream[end + 1] == 0 or 0xD0 <= stream[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            now["scan"], at = stream[at:end], end
    if now:
        raise ValueError("an image without an end")
    return images


def _find_end(stream: np.ndarray) -> np.ndarray:
    """Places of restart markers."""
    return np.flatnonzero((stream[:-1] == 0xFF) & (stream[1:] >= 0xD0) & (stream[1:] <= 0xD7))


def thumbnails(images: list[dict]) -> list[np.ndarray]:
    """Luminance, a byte a block, of each image."""
    out: list = [None] * len(images)
    groups: dict = {}
    for k, m in enumerate(images):
        parts = tuple((h, v, m["tables"][m["uses"][i][0]], m["tables"][16 + m["uses"][i][1]]) for i, h, v, _ in m["parts"])
        groups.setdefault(parts, []).append(k)
    for parts, members in groups.items():
        for held in _slices(members, lambda k: len(images[k]["scan"])):
            for k, t in zip(held, _decode(parts, [images[k] for k in held]), strict=True):
                out[k] = t
    return out


def _decode(parts, images: list[dict]) -> list[np.ndarray]:
    across, down = max(p[0] for p in parts), max(p[1] for p in parts)
    single = len(parts) == 1
    if single:
        across = down = 1
    blocks = [(0, 1)] if single else [(c, h * v) for c, (h, v, _, _) in enumerate(parts)]
    mcus = [(-(-m["width"] // (8 * across)), -(-m["height"] // (8 * down))) for m in images]
    raw = np.frombuffer(b"".join(m["scan"] for m in images), np.uint8)
    begin = np.cumsum([0] + [len(m["scan"]) for m in images])
    marks = _find_end(np.r_[raw, np.uint8(0)])
    cuts = np.union1d(begin, marks)
    # segments: unstuffed bytes between restart markers
    keep = np.ones(len(raw), bool)
    keep[1:] &= ~((raw[1:] == 0) & (raw[:-1] == 0xFF))
    keep[marks] = False
    keep[marks + 1] = False
    before = np.r_[0, np.cumsum(keep)]
    data = raw[keep]
    first = before[cuts[:-1]]
    image_of = np.searchsorted(begin, cuts[:-1], side="right") - 1
    nth = np.arange(len(first)) - np.searchsorted(cuts, begin[:-1])[image_of]
    each = np.array([m["restart"] or x * y for m, (x, y) in zip(images, mcus, strict=True)])[image_of]
    total = np.array([x * y for x, y in mcus])[image_of]
    todo = np.clip(total - nth * each, 0, each)
    padded = np.r_[data, np.full(8, 255, np.uint8)].astype(np.uint64)
    window = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        window |= padded[k : k + len(data) + 1] << np.uint64(56 - 8 * k)
    tables = [(lookup(*p[2]), lookup(*p[3])) for p in parts]
    flat_at = np.cumsum([0] + [x * y * blocks[0][1] for x, y in mcus])
    flat = np.zeros(flat_at[-1], np.int32)
    where = flat_at[image_of] + nth * each * blocks[0][1]
    pos = first.astype(np.int64) * 8
    dc = np.zeros((len(parts), len(pos)), np.int64)
    live, turn = np.flatnonzero(todo > 0), 0

    def symbol(table, who):
        p = pos[who]
        w = window[np.minimum(p >> 3, len(data))] << (p & 7).astype(np.uint64)
        hit = table[(w >> np.uint64(48)).astype(np.int64)]
        if (hit == 0).any() or (p >> 3 > len(data)).any():
            raise ValueError("no such code in the scan")
        n = hit >> 8
        return w << n.astype(np.uint64), n, hit & 255

    while len(live):
        for c, many in blocks:
            dc_table, ac_table = tables[c]
            for b in range(many):
                w, n, size = symbol(dc_table, live)
                bits = np.where(size > 0, w >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64)), 0).astype(np.int64)
                dc[c, live] += np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)
                pos[live] += n + size
                if c == 0:
                    flat[where[live] + turn * many + b] = dc[c, live]
                who, done = live, np.zeros(len(live), np.int64)
                while len(who):
                    _, n, run = symbol(ac_table, who)
                    pos[who] += n + (run & 15)
                    done = np.where(run == 0, 63, done + (run >> 4) + 1)
                    who, done = who[done < 63], done[done < 63]
        turn += 1
        live = live[todo[live] > turn]
    out = []
    for k, (m, (x, y)) in enumerate(zip(images, mcus, strict=True)):
        level = np.clip(np.rint(flat[flat_at[k] : flat_at[k + 1]] * m["quant"][m["parts"][0][3]] / 8) + 128, 0, 255).astype(np.uint8)
        h, v = (1, 1) if single else parts[0][:2]
        level = level.reshape(y, x, v, h).transpose(0, 2, 1, 3).reshape(y * v, x * h)
        out.append(level[: -(-m["height"] * v // (8 * down)), : -(-m["width"] * h // (8 * across))])
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits of an 8 x 8 grid of means; grids of fewer pixels repeat them."""
    rows, columns = (np.linspace(0, n, 9).astype(int) for n in grey.shape)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    total[1:, 1:] = grey.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    top, left = np.minimum(rows[:-1], grey.shape[0] - 1), np.minimum(columns[:-1], grey.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(columns[1:], left + 1)
    mean = (total[low][:, right] - total[top][:, right] - total[low][:, left] + total[top][:, left]) / np.outer(low - top, right - left)
    return np.packbits((mean > mean.mean()).reshape(-1)).tobytes().hex()


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def _slices(rows, size, most: int = AT_ONCE):
    """Lists of rows of so much together, the last one's more."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(batch: pa.RecordBatch):
    """One by one."""
    return (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows))


def _store(batches):
    release()
    for batch in batches:
        for part in _slices(_rows(batch), lambda r: len(r[1])):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[1]) for r in part], pa.int64()), pa.array(store([payload(r[1]) for r in part]), pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches):
    import hashlib
    import zlib

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    release()
    for batch in batches:
        for part in _slices(_rows(batch), lambda r: len(r[2])):
            images = [parse(m) for _, _, m in part]
            grey = iter(thumbnails([m for ms in images for m in ms]))
            out = []
            for (i, n, media), ms in zip(part, images, strict=True):
                own = [next(grey) for _ in ms]
                raw = b"".join(g.tobytes() for g in own)
                size = f"{ms[0]['width']}x{sum(m['height'] for m in ms)}"
                out.append((i, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{size}:{thumbnail_hash(np.concatenate(own))}"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa.schema([(c, pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c in names]))


def to_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, media (JPEG streams)."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: payload and media digests, dimensions and thumbnail hash."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
