"""Media: round trips of any bytes, and images of other encoders, written here bit by bit."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from common import SCHEMA, frame, write_tables
from pyspark.sql import functions as F

from gridfield.llm import media
from gridfield.llm.queries import QUERIES


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 24 * 8000, 24 * 8000 + 1, 2_000_003])
def test_any_bytes(size):
    for raw in (random.Random(size).randbytes(size), b"\xff" * size, bytes(size)):
        whole = media.payload(raw)
        assert len(whole) % 576 == 0 and whole.startswith(raw)
        (stream,) = media.store([whole])
        assert b"".join(g.tobytes() for g in media.thumbnails(media.parse(stream))) == whole


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        out = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
        return out.replace(b"\xff", b"\xff\x00")


def picture(rng, width, height, factors, restart, quant=(3, 7)):
    """A baseline stream of random coefficients, and the luminance levels that its DC stands for."""
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    if len(factors) == 1:
        factors, across, down = [(1, 1)], 1, 1
    mx, my = -(-width // (8 * across)), -(-height // (8 * down))
    dc_table = ((0, 2, 2, 3, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (3, 0, 1, 2, 4, 5, 6, 7, 8, 9, 10))
    ac_table = ((0, 1, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x01, 0x00, 0x11, 0x02, 0xF0, 0x23, 0x31))
    dc_code, ac_code = ({x: (c, n) for c, n, x in media.canonical(*t)} for t in (dc_table, ac_table))
    size = lambda x: abs(x).bit_length()
    extra = lambda x: x if x >= 0 else x + (1 << size(x)) - 1
    h0, v0 = factors[0]
    luma = np.zeros((my * v0, mx * h0), int)
    scan, out, before = Bits(), b"", [0] * len(factors)
    for m in range(mx * my):
        if restart and m and m % restart == 0:
            out += scan.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            scan, before = Bits(), [0] * len(factors)
        for c, (h, v) in enumerate(factors):
            for b in range(h * v):
                level = rng.randint(-250, 250)
                d, before[c] = level - before[c], level
                scan.put(*dc_code[size(d)])
                scan.put(extra(d), size(d))
                at = 0
                while at < 63:
                    symbol = rng.choice(ac_table[1])
                    run, bits = symbol >> 4, symbol & 15
                    if symbol == 0 or at + run + 1 > 63:
                        scan.put(*ac_code[0])
                        break
                    scan.put(*ac_code[symbol])
                    if bits:
                        scan.put(rng.getrandbits(bits), bits)
                    at += run + 1
                if c == 0:
                    luma[m // mx * v0 + b // h, m % mx * h0 + b % h] = level
    out += scan.bytes()
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    tables = bytes([0x00, *dc_table[0], *dc_table[1]]) + bytes([0x10, *ac_table[0], *ac_table[1]])
    parts = b"".join(bytes([c + 1, h << 4 | v, int(c > 0)]) for c, (h, v) in enumerate(factors))
    stream = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xFE, b"a remark \xff\xd9")
    stream += segment(0xDB, bytes([0] + [quant[0]] * 64)) + segment(0xDB, bytes([0x11]) + struct.pack(">64H", *[quant[1]] * 64))
    stream += b"\xff" + segment(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + parts) + segment(0xC4, tables)
    stream += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    stream += segment(0xDA, bytes([len(factors)]) + b"".join(bytes([c + 1, 0]) for c in range(len(factors))) + b"\x00\x3f\x00") + out + b"\xff\xd9"
    grey = np.clip(np.rint(luma * quant[0] / 8) + 128, 0, 255).astype(np.uint8)
    return stream, grey[: -(-height * v0 // (8 * down)), : -(-width * h0 // (8 * across))]


COLOUR = [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (1, 1)]]


@pytest.mark.parametrize("factors", COLOUR)
@pytest.mark.parametrize("restart", [0, 1, 5])
def test_images_of_other_encoders(factors, restart):
    rng = random.Random(f"{factors}{restart}")
    made = [picture(rng, w, h, factors, restart) for w, h in ((64, 48), (61, 37), (8, 8), (1, 1), (200, 9))]
    got = media.thumbnails([m for stream, _ in made for m in media.parse(stream)])
    for (_, want), grey in zip(made, got, strict=True):
        assert grey.shape == want.shape and (grey == want).all()


def test_damaged_and_other_streams():
    good, _ = picture(random.Random(3), 40, 40, COLOUR[2], 2)
    assert media.parse(b"") == []
    for bad in (b"no image", good[:-2], good[:30], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xd9", good[2:]):
        with pytest.raises(ValueError):
            media.thumbnails(media.parse(bad))


def odd_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc déß\n", k=rng.randint(1, 4000)))) for i in range(25)]
    return rows + [(None, None), (None, "x"), (3, "x"), (3, "y"), (40, ""), (41, "é" * 300_000), (42, "a" * 576)]


def test_query(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).withColumns({"media": F.lit("x"), "n_bytes": F.lit(1)})
    write_tables(spark, tmp_path, documents=docs)
    out = QUERIES["op6_jpeg_media"](spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        (stored,) = media.store([whole])
        want.append((i, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in out), key=str) == sorted(want, key=str)
    feature = {r["payload_sha256"]: r["feature"] for r in out}
    assert len({(r["payload_sha256"], r["feature"]) for r in out}) == len(feature)
    assert media.media_features(media.to_media(frame(spark, []))).count() == 0


def test_feature_by_hand():
    """The hash of an 8 x 8 grid whose cells are one block each."""
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert media.thumbnail_hash(grey) == "00000000ffffffff"
    assert media.thumbnail_hash(np.full((3, 24), 9, np.uint8)) == "0" * 16
