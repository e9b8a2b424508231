import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tiff


def test_lzw_known_codes():
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.pack_lzw(data) == packed
    assert tiff.unpack_lzw(packed, 9) == data


def test_packbits_known_bytes():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_packbits(packed, 24) == plain
    assert tiff.unpack_packbits(tiff.pack_packbits(plain), 24) == plain


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=4000), st.integers(1, 30))
def test_round_trips(data, times):
    data = data * times
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    assert tiff.unpack_packbits(tiff.pack_packbits(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16, 64])
def test_files(compression, predictor, tile):
    image = np.random.default_rng(3).integers(0, 5, (133, 64)).astype(np.uint8)
    (page,) = tiff.read_pages(tiff.write_gray(image, compression, predictor, tile, strip_rows=50))
    assert page["error"] is None and page["pixels"] == image.tobytes() and page["height"] == 133


def build(order, tags, body, following=0):
    """A file by hand: tags are (tag, kind, values); offsets in the body count from 8."""
    codes = {3: "H", 4: "I"}
    at = 8 + len(body)
    extra_at, extra, fields = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}{codes[kind]}", *values)
        if len(packed) > 4:
            fields += struct.pack(order + "HHII", tag, kind, len(values), extra_at + len(extra))
            extra += packed
        else:
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(tags)) + fields + struct.pack(order + "I", following) + extra


def test_big_endian_16_bit_rgb_with_predictor_and_planes():
    image = np.random.default_rng(5).integers(0, 65536, (9, 7, 3)).astype(np.uint16)
    chunky = np.diff(image, axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()
    body = zlib.compress(chunky)
    base = [(256, 3, [7]), (257, 3, [9]), (258, 3, [16] * 3), (259, 3, [8]), (262, 3, [2]), (277, 3, [3]), (278, 3, [9]), (317, 3, [2])]
    (page,) = tiff.read_pages(build(">", [*base, (273, 4, [8]), (279, 4, [len(body)])], body))
    assert page["pixels"] == image.astype("<u2").tobytes()
    planes = [zlib.compress(np.diff(image[:, :, i], axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()) for i in range(3)]
    at = [8 + sum(map(len, planes[:i])) for i in range(3)]
    (page,) = tiff.read_pages(build(">", [*base, (284, 3, [2]), (273, 4, at), (279, 4, [len(p) for p in planes])], b"".join(planes)))
    assert page["pixels"] == image.astype("<u2").tobytes()


def test_floating_point_predictor():
    image = np.random.default_rng(6).normal(size=(5, 6)).astype(np.float32)
    rows = image.astype(">f4").view(np.uint8).reshape(5, 6, 4).transpose(0, 2, 1).reshape(5, 24)
    body = zlib.compress(np.diff(rows, axis=1, prepend=np.uint8(0)).tobytes())
    tags = [(256, 3, [6]), (257, 3, [5]), (258, 3, [32]), (259, 3, [8]), (278, 3, [5]), (317, 3, [3]), (273, 4, [8]), (279, 4, [len(body)])]
    (page,) = tiff.read_pages(build("<", tags, body))
    assert np.array_equal(np.frombuffer(page["pixels"], "<f4").reshape(5, 6), image)


def test_two_pages_and_a_loop():
    one = tiff.write_gray(np.zeros((2, 64), np.uint8), tiff.NONE)
    (at,) = struct.unpack_from("<I", one, 4)
    (count,) = struct.unpack_from("<H", one, at)
    copy = one[at : at + 2 + 12 * count]
    second = len(one) + len(one) % 2
    link = at + 2 + 12 * count
    linked = one[:link] + struct.pack("<I", second) + one[link + 4 :] + b"\0" * (len(one) % 2) + copy + struct.pack("<I", at)
    pages = list(tiff.read_pages(linked))
    assert [p["page"] for p in pages] == [0, 1] and all(p["pixels"] == b"\0" * 128 for p in pages)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(0, 255), st.sampled_from(tiff.STORED_AS))
def test_damage_never_crashes(at, byte, stored):
    whole = bytearray(tiff.write_gray(np.arange(640, dtype=np.uint8).reshape(10, 64), *stored))
    whole[at % len(whole)] = byte
    for page in tiff.read_pages(bytes(whole)):
        assert "error" in page
    for page in tiff.read_pages(bytes(whole[: at % len(whole)])):
        assert "error" in page


def test_a_bomb_is_refused():
    tags = [(256, 4, [1 << 20]), (257, 4, [1 << 20]), (258, 3, [8]), (259, 3, [8]), (278, 4, [1 << 20]), (273, 4, [8]), (279, 4, [4])]
    (page,) = tiff.read_pages(build("<", tags, b"abcd"))
    assert "cannot hold" in page["error"]


def test_query_reads_back_every_text(spark, tmp_path):
    texts = [None, "", "a", "é" * 31, "x" * 64, "x" * 65, "same text", "same text", "aaaa" * 40_000, "Prose with   runs... " * 400]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, page int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in tiff.query(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert r.feature and r.media_bytes > 0 and len(r.media_sha256) == 64
    assert rows[6][3:] == rows[7][3:]


def test_null_and_foreign_media_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a")), (None, bytearray(b""))], "doc_id bigint, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert len(rows) == 3 and all(r.page == -1 and r.error and r.pixels is None for r in rows)
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_files_of_many_pages(spark):
    """A file of each number of pages up to 14, its pages stored in all ways, read as a row per page and joined again."""
    rng = np.random.default_rng(8)
    texts = [None, ""] + ["".join(map(chr, rng.integers(32, 800, n))) for n in (10, 9000, 40_000, 200_000)] + ["run " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (5, texts[5])], "doc_id long, text string").repartition(2)
    pages = tiff.tiff_pages(tiff.store_texts(df))
    rows = pages.collect()
    by_file = {}
    for r in rows:
        assert r.error is None and r.width == 64 and r.height <= tiff.PAGE_ROWS
        if r.doc_id is not None and r.doc_id != 5:
            by_file.setdefault(r.doc_id, {})[r.page] = bytes(r.pixels)
    for i, own in by_file.items():
        assert sorted(own) == list(range(len(own))) and b"".join(own[p] for p in sorted(own)) == tiff.payload(texts[i])
    assert max(r.page for r in rows) >= 14 and len({(r.compression, r.predictor, r.tiled) for r in rows}) == len(tiff.STORED_AS)
    whole = tiff.whole_pixels(pages, ("doc_id",)).collect()
    assert len(whole) == len(texts) + 2
    for r in whole:
        want = tiff.payload(texts[4 if r.doc_id is None else r.doc_id])
        assert bytes(r.pixels) == want and r.errors == 0 and r.feature == tiff.gray_feature(want, 64)


def test_bytes_written_by_hand():
    """A file of three pages put together here, byte by byte, without the writer: strips, raw, PackBits and LZW."""
    import struct

    strips = [b"ABCDEF", bytes([254, 65, 2, 66, 67, 68]), None]  # AAA BCD as PackBits
    bits = "".join(format(c, "09b") for c in (256, 65, 258, 66, 67, 68, 257))  # A, AA, B, C, D by LZW
    bits += "0" * (-len(bits) % 8)
    strips[2] = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    body, directories, at = b"", [], 8
    for strip in strips:
        directories.append((at, len(strip)))
        body += strip
        at += len(strip)
    parts, where = [], at
    for i, (code, (start, size)) in enumerate(zip((1, 32773, 5), directories)):
        fields = [(256, 3), (257, 2), (258, 8), (259, code), (262, 1), (273, start), (277, 1), (278, 2), (279, size)]
        after = where + 2 + 12 * len(fields) + 4
        parts.append(struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in fields) + struct.pack("<I", after if i < 2 else 0))
        where = after
    got = list(tiff.read_pages(b"II*\0" + struct.pack("<I", at) + body + b"".join(parts)))
    assert [(p["page"], p["error"], p["pixels"]) for p in got] == [(0, None, b"ABCDEF"), (1, None, b"AAABCD"), (2, None, b"AAABCD")]


def test_a_damaged_file_still_gives_its_row(spark):
    good = tiff.stored_text("a text " * 9000)
    files = [(1, good), (2, None), (3, b"II*"), (4, good[: len(good) // 2]), (5, good)]
    whole = tiff.whole_pixels(tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, media binary")), ("doc_id",)).collect()
    assert sorted(r.doc_id for r in whole) == [1, 2, 3, 4, 5]
    assert [r.errors > 0 for r in sorted(whole, key=lambda r: r.doc_id)] == [False, True, True, True, False]
