"""TIFF pages: a reader that walks the image directories of a file and yields one row per page, and a plain writer.

The reader takes both byte orders, classic and 64-bit files, strips and tiles, chunky and planar samples, no compression,
PackBits, LZW (most significant bit first) and deflate (both codes), the horizontal predictor for 8, 16, 32 and 64 bits and
the floating-point predictor for 16, 32 and 64 bits, both fill orders, and samples of 1, 2, 4, 8, 16, 32 or 64 bits.
Pixels come out row by row, chunky, least significant byte first for samples over 8 bits; samples under 8 bits stay
packed, each row filled up to whole bytes.

Defined cases: a null or damaged file gives one row with page -1 and the error; a damaged page gives its row with the
error and no pixels, and the pages after it are still read; a directory that was already read ends the walk; a file
that stops early is an error of the page it touches; a page's declared size is checked against what its data can
expand to before anything is allocated; repeated rows are read one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.batches import kept_names, map_batches
from quillon.session import table

# Fixed values of the format: field types (bytes each), tags and compression codes.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = (
    256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317,
)
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, STOP, FIRST_FREE = 256, 257, 258

#: A compressed byte stands for at most so many: LZW strings of the last code, a deflate match, a PackBits run.
MOST_EXPANSION = {NONE: 1, LZW: 3840, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


class Damaged(ValueError):
    """The file does not hold what it declares."""


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)


def pack_packbits(row: bytes) -> bytes:
    """One row: runs of three or more equal bytes as runs, what lies between as literals."""
    x = np.frombuffer(row, np.uint8)
    if not len(x):
        return b""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.concatenate([starts, [len(x)]]))
    out, plain = [], 0

    def literal(upto: int) -> None:
        for at in range(plain, upto, 128):
            part = row[at : min(at + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for i in np.flatnonzero(lengths >= 3):
        start, end = int(starts[i]), int(starts[i] + lengths[i])
        literal(start)
        for at in range(start, end, 128):
            n = min(128, end - at)
            out.append(bytes([257 - n if n > 1 else 0, row[start]]))
        plain = end
    literal(len(row))
    return b"".join(out)


def pack_packbits_block(block: np.ndarray) -> bytes:
    """All rows of a block; rows without a run of three, the most common kind in prose, go out as literals at once."""
    height, width = block.shape
    if width > 128 or width < 3:
        return b"".join(pack_packbits(r.tobytes()) for r in block)
    same = block[:, 1:] == block[:, :-1]
    runs = np.flatnonzero((same[:, 1:] & same[:, :-1]).any(axis=1))
    plain = np.empty((height, width + 1), np.uint8)
    plain[:, 0], plain[:, 1:] = width - 1, block
    out, at = [], 0
    for row in runs.tolist():
        out += [plain[at:row].tobytes(), pack_packbits(block[row].tobytes())]
        at = row + 1
    return b"".join([*out, plain[at:].tobytes()])


def _code_widths(count: int) -> np.ndarray:
    """Bits of the codes after a clear code, the clear code itself left out: a width grows one code early."""
    entries = FIRST_FREE + np.arange(count) - 1
    return np.select([entries < 511, entries < 1023, entries < 2047], [9, 10, 11], 12)


#: Widths of as many codes as a table can fill, and where they start.
_WIDTHS = _code_widths(4096)
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def _codes(bits: np.ndarray, at: int) -> tuple[list[int], int]:
    """The codes from bit ``at`` up to the next clear or stop code, that code included, and the bit after it."""
    n = int(np.searchsorted(_STARTS, len(bits) * 8 - 32 - at, side="right")) - 1
    n = max(0, min(n, len(_WIDTHS)))
    if not n:
        return [], at
    where, width = at + _STARTS[:n], _WIDTHS[:n]
    first = where >> 3
    word = (
        (bits[first].astype(np.uint32) << 24)
        | (bits[first + 1].astype(np.uint32) << 16)
        | (bits[first + 2].astype(np.uint32) << 8)
        | bits[first + 3]
    )
    codes = (word >> (32 - (where & 7) - width)) & ((1 << width) - 1)
    ends = np.flatnonzero((codes == CLEAR) | (codes == STOP))
    if len(ends):
        n = int(ends[0]) + 1
    return codes[:n].tolist(), at + int(_STARTS[n])


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes between two clear codes have known widths, so they are cut out together; strings follow one by one."""
    bits = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    have, at = 0, 0
    while have < size:
        codes, at = _codes(bits, at)
        if not codes:
            break
        last = codes[-1]
        if last in (CLEAR, STOP):
            codes.pop()
        strings, previous = list(fresh), None
        add, emit = strings.append, out.append
        for code in codes:
            if previous is None:
                if code >= 256:
                    raise Damaged("LZW: a string before any")
                previous = strings[code]
            else:
                if code < len(strings):
                    string = strings[code]
                elif code == len(strings):
                    string = previous + previous[:1]
                else:
                    raise Damaged("LZW: a code that is not yet defined")
                add(previous + string[:1])
                previous = string
            emit(previous)
            have += len(previous)
        if last == STOP:
            break
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """Codes with the early change of width, a clear code first and whenever the table is full."""
    runs: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    free, string = FIRST_FREE, -1
    find, emit = known.get, codes.append
    for byte in data:
        if string < 0:
            string = byte
            continue
        key = string << 8 | byte
        code = find(key)
        if code is not None:
            string = code
            continue
        emit(string)
        known[key] = free
        free += 1
        string = byte
        if free == 4094:
            emit(string)
            emit(CLEAR)
            runs.append(codes)
            codes, string, free = [], -1, FIRST_FREE
            emit = codes.append
            known.clear()
    if string >= 0:
        emit(string)
    emit(STOP)
    runs.append(codes)
    parts = [np.array([CLEAR]), *(np.array(r) for r in runs)]
    widths = np.concatenate([[9], *(_code_widths(len(r)) for r in runs)])
    codes_all = np.concatenate(parts).astype(np.uint16)
    spread = np.unpackbits(codes_all.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(spread[np.arange(16) >= (16 - widths)[:, None]]).tobytes()


def _expand(data: bytes, code: int, size: int) -> bytes:
    if size > len(data) * MOST_EXPANSION.get(code, 0) + 64:
        raise Damaged(f"{len(data)} bytes under compression {code} cannot hold {size}")
    if code == NONE:
        out = data[:size]
    elif code == PACKBITS:
        out = unpack_packbits(data, size)
    elif code == LZW:
        out = unpack_lzw(data, size)
    else:
        out = zlib.decompressobj().decompress(data, size) if size else b""
    if len(out) < size:
        raise Damaged(f"a strip or tile of {len(out)} bytes, not {size}")
    return out[:size]


def undo_predictor(block: np.ndarray, predictor: int, samples: int, order: str) -> np.ndarray:
    """block: rows x (pixels * samples) of the stored kind."""
    if predictor == 1:
        return block
    rows = block.shape[0]
    if predictor == 2:
        shaped = block.reshape(rows, -1, samples)
        return np.cumsum(shaped, axis=1, dtype=block.dtype).reshape(rows, -1)
    if predictor == 3 and block.dtype.kind == "u" and block.dtype.itemsize > 1:
        size = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, -1)
        whole = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}")
        return whole.reshape(rows, -1).astype(f"<u{size}")
    raise Damaged(f"predictor {predictor}")


class Reader:
    """One file."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise Damaged("not a TIFF file")
        self.order = "<" if data[:2] == b"II" else ">"
        (version,) = self._get("H", 2)
        if version == 42:
            self.big, (self.first,) = False, self._get("I", 4)
        elif version == 43 and self._get("HH", 4) == (8, 0):
            self.big, (self.first,) = True, self._get("Q", 8)
        else:
            raise Damaged(f"version {version}")

    def _get(self, code: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + code, self.data, at)
        except struct.error:
            raise Damaged(f"the file ends before byte {at}") from None

    def directories(self) -> Iterator[dict[int, tuple] | Damaged]:
        at, seen = self.first, set()
        while at and at not in seen:
            seen.add(at)
            try:
                if self.big:
                    (count,), size, at_fields = self._get("Q", at), 20, at + 8
                else:
                    (count,), size, at_fields = self._get("H", at), 12, at + 2
                if at_fields + count * size > len(self.data):
                    raise Damaged("the directory passes the end of the file")
                tags = {}
                for i in range(count):
                    tag, values = self._field(at_fields + i * size)
                    if values is not None:
                        tags[tag] = values
                (following,) = self._get("Q" if self.big else "I", at_fields + count * size)
            except Damaged as e:
                yield e
                return
            yield tags
            at = following

    def _field(self, at: int) -> tuple[int, tuple | None]:
        tag, kind = self._get("HH", at)
        (count,) = self._get("Q" if self.big else "I", at + 4)
        inline, where = (8, at + 12) if self.big else (4, at + 8)
        if kind not in TYPE_CODES:
            return tag, None
        if count * TYPE_BYTES[kind] > inline:
            (where,) = self._get("Q" if self.big else "I", where)
        if where + count * TYPE_BYTES[kind] > len(self.data):
            raise Damaged(f"field {tag} passes the end of the file")
        return tag, self._get(f"{count}{TYPE_CODES[kind]}", where)

    def page(self, tags: dict[int, tuple]) -> dict:
        one = lambda tag, default=None: (tags.get(tag) or (default,))[0]
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        if not width or not height or not samples:
            raise Damaged("no width, height or samples")
        bits = tags.get(BITS, (1,) * samples)
        if len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16, 32, 64):
            raise Damaged(f"bits {bits}")
        bits, code, predictor, planar = bits[0], one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
        if code not in MOST_EXPANSION:
            raise Damaged(f"compression {code}")
        tiled = TILE_AT in tags
        if tiled:
            block_width, block_height = one(TILE_WIDTH), one(TILE_HEIGHT)
            at, sizes = tags[TILE_AT], tags.get(TILE_BYTES)
        else:
            block_width, block_height = width, min(one(STRIP_ROWS, height), height)
            at, sizes = tags.get(STRIP_AT), tags.get(STRIP_BYTES)
        if not at or not sizes or len(at) != len(sizes) or not block_width or not block_height:
            raise Damaged("no strips or tiles")
        planes, own = (samples, 1) if planar == 2 else (1, samples)
        across, down = -(-width // block_width), -(-height // block_height)
        if len(at) < across * down * planes:
            raise Damaged("too few strips or tiles")
        block_row = -(-block_width * own * bits // 8)
        tall = down * block_height if tiled else height
        if planes * across * block_row * tall > sum(sizes) * MOST_EXPANSION[code] + 64 * len(at):
            raise Damaged("the data cannot hold the declared size")
        size = max(1, bits // 8)
        made = []
        for plane in range(planes):
            rows = []
            for y in range(down):
                line = []
                for x in range(across):
                    i = (plane * down + y) * across + x
                    tall = block_height if tiled else min(block_height, height - y * block_height)
                    line.append(self._block(at[i], sizes[i], code, block_row, tall, bits, own, predictor, one(FILL_ORDER, 1)))
                rows.append(line[0] if len(line) == 1 else np.concatenate(line, axis=1))
            made.append(np.concatenate(rows, axis=0) if len(rows) > 1 else rows[0])
        row = -(-width * own * bits // 8) if bits < 8 else width * own
        made = [m[:height, :row] for m in made]
        pixels = made[0] if planes == 1 else np.stack(made, axis=2).reshape(height, -1)
        return {
            "width": width, "height": height, "bits": bits, "samples": samples, "compression": code, "predictor": predictor,
            "photometric": one(PHOTOMETRIC), "tiled": tiled, "blocks": len(at), "pixels": np.ascontiguousarray(pixels, f"<u{size}").tobytes(),
        }

    def _block(self, at, stored, code, row, tall, bits, own, predictor, fill) -> np.ndarray:
        if at + stored > len(self.data):
            raise Damaged("a strip or tile passes the end of the file")
        data = self.data[at : at + stored]
        if fill == 2:
            data = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).tobytes()
        raw = _expand(data, code, row * tall)
        if bits < 8:
            if predictor != 1:
                raise Damaged("a predictor on packed samples")
            return np.frombuffer(raw, np.uint8).reshape(tall, row)
        kind = "<" if predictor == 3 else self.order
        block = np.frombuffer(raw, f"{kind}u{bits // 8}").reshape(tall, -1)
        return undo_predictor(block.astype(f"<u{bits // 8}") if predictor != 3 else block, predictor, own, self.order)

    def pages(self) -> Iterator[dict]:
        for number, tags in enumerate(self.directories()):
            try:
                if isinstance(tags, Damaged):
                    raise tags
                page = self.page(tags)
                gray = page["bits"] == 8 and page["samples"] == 1
                yield {"page": number, "error": None, "feature": gray_feature(page["pixels"], page["width"]) if gray else None, **page}
            except (Damaged, zlib.error, MemoryError, ValueError) as e:
                yield {"page": number, "error": f"{type(e).__name__}: {e}"}


def read_pages(data: bytes | None) -> Iterator[dict]:
    try:
        yield from Reader(data or b"").pages()
    except Damaged as e:
        yield {"page": -1, "error": f"Damaged: {e}"}


def _gray_blocks(rows: np.ndarray, compression: int, predictor: int, tile: int | None, strip_rows: int) -> list[bytes]:
    height, width = rows.shape
    if tile:
        tall, wide = -(-height // tile) * tile, -(-width // tile) * tile
        filled = np.zeros((tall, wide), np.uint8)
        filled[:height, :width] = rows
        blocks = [filled[y : y + tile, x : x + tile] for y in range(0, tall, tile) for x in range(0, wide, tile)]
    else:
        blocks = [rows[y : y + strip_rows] for y in range(0, height, strip_rows)]
    stored = []
    for block in blocks:
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=np.uint8(0))
        raw = np.ascontiguousarray(block).tobytes()
        if compression == DEFLATE:
            stored.append(zlib.compress(raw, 1))
        elif compression == LZW:
            stored.append(pack_lzw(raw))
        elif compression == PACKBITS:
            stored.append(pack_packbits_block(block))
        else:
            stored.append(raw)
    return stored


def write_gray_pages(pages: list[tuple[np.ndarray, int, int, int | None]], strip_rows: int = 1024) -> bytes:
    """A file of 8-bit gray pages, each (samples as height x width, compression, predictor, side of its square tiles or none)."""
    out, size = [b"II*\0", b""], 8
    links = []
    for rows, compression, predictor, tile in pages:
        stored = _gray_blocks(rows, compression, predictor, tile, strip_rows)
        lengths = [len(s) for s in stored]
        starts = (size + np.cumsum(lengths) - lengths).tolist()
        tags: dict[int, list[int]] = {
            WIDTH: [rows.shape[1]], HEIGHT: [rows.shape[0]], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor],
        }
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_AT: starts, TILE_BYTES: lengths} if tile else {STRIP_ROWS: [strip_rows], STRIP_AT: starts, STRIP_BYTES: lengths}
        pad = b"\0" * (sum(lengths) % 2)
        directory = size + sum(lengths) + len(pad)
        extra_at = directory + 2 + 12 * len(tags) + 4
        fields, extra = [], b""
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                fields.append(struct.pack("<HHII", tag, 4, len(values), extra_at + len(extra)))
                extra += packed
            else:
                fields.append(struct.pack("<HHI", tag, 4, 1) + packed)
        links.append((len(out), directory))
        out += [*stored, pad, struct.pack("<H", len(tags)), *fields, b"", extra]
        size = extra_at + len(extra)
    # What points to a directory comes before it: the file's head, or the directory before.
    spots = [1, *((links[i + 1][0] if i + 1 < len(links) else len(out)) - 2 for i in range(len(links)))]
    for spot, where in zip(spots, [*(d for _, d in links), 0], strict=True):
        out[spot] = struct.pack("<I", where)
    return b"".join(out)


def write_gray(
    rows: np.ndarray, compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, strip_rows: int = 1024
) -> bytes:
    """A one-page file of 8-bit gray samples (height x width), in strips or in square tiles."""
    return write_gray_pages([(rows, compression, predictor, tile)], strip_rows)


_PAGE_FIELDS = {
    "page": pa.int32(), "error": pa.string(), "width": pa.int64(), "height": pa.int64(), "bits": pa.int32(), "samples": pa.int32(),
    "compression": pa.int32(), "predictor": pa.int32(), "photometric": pa.int32(), "tiled": pa.bool_(), "blocks": pa.int64(), "pixels": pa.binary(), "feature": pa.string(),
}
_PAGE_SCHEMA = (
    "page int, error string, width bigint, height bigint, bits int, samples int, compression int, predictor int, photometric int,"
    " tiled boolean, blocks bigint, pixels binary, feature string"
)
#: Pixels that one batch of rows carries, at most by one page more.
OUT_BYTES = 8 << 20


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of each file: the ``keep`` columns, the page's fields and pixels; a kept column named like a field gets ``input_`` before its name."""
    read = df.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(media).alias("media"))
    names = read.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for i, data in enumerate(batch.column(len(names)).to_pylist()):
                for page in read_pages(data):
                    at.append(i)
                    rows.append(page)
                    size += len(page.get("pixels") or b"")
                    if size > OUT_BYTES:
                        yield _pages(batch, names, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield _pages(batch, names, at, rows)

    pages = map_batches(read, work, f"{schema}, {_PAGE_SCHEMA}")
    return pages.toDF(*kept_names(keep, tuple(_PAGE_FIELDS)), *_PAGE_FIELDS)


def _pages(batch: pa.RecordBatch, names: list[str], at: list[int], rows: list[dict]) -> pa.RecordBatch:
    kept = [batch.column(i).take(pa.array(at)) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(
        [*kept, *(pa.array([r.get(n) for r in rows], t) for n, t in _PAGE_FIELDS.items())], [*names, *_PAGE_FIELDS]
    )


ROW_BYTES = 64
#: Rows of samples on a page of a stored text.
PAGE_ROWS = 256
#: How pages are stored, by the payload's checksum and then in turn: compression, predictor and tile.
STORED_AS = ((DEFLATE, 2, None), (LZW, 1, None), (PACKBITS, 1, 64), (LZW, 2, 64), (DEFLATE, 1, 64), (PACKBITS, 2, None))


def payload(text: str | None) -> bytes:
    """UTF-8, filled with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES) - len(raw))


def stored_text(text: str | None) -> bytes:
    """The payload as a file of gray pages 64 samples wide and at most ``PAGE_ROWS`` high, each page stored in another way."""
    whole = payload(text)
    rows, first = np.frombuffer(whole, np.uint8).reshape(-1, ROW_BYTES), zlib.crc32(whole)
    return write_gray_pages([(rows[at : at + PAGE_ROWS], *STORED_AS[(first + i) % len(STORED_AS)]) for i, at in enumerate(range(0, len(rows), PAGE_ROWS))])


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text alone) and media: each text as a file of pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [stored_text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    read = df.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes")
    )
    return map_batches(read, work, "key bigint, n_bytes bigint, media binary").withColumnRenamed("key", key)


def whole_pixels(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns, pages (their number), pixels of all pages one after another, and their feature: a row per file.

    ``pages`` are tiff_pages' rows, narrowed at most: a file's pages stand one after another, page 0 first, so a task joins
    what it reads and nothing is shuffled. A page in error adds no pixels; a file's last row says so by ``errors``.
    """
    read = pages.select("page", "error", "width", "pixels", *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    names = read.columns[4:]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[4:])
    kinds = "pages int, errors int, pixels binary, feature string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, width, errors = None, [], 0, 0

        def done() -> pa.RecordBatch:
            pixels = b"".join(parts)
            feature = gray_feature(pixels, width) if pixels and width and len(pixels) % width == 0 else None
            rest = [pa.array([len(parts)], pa.int32()), pa.array([errors], pa.int32()), pa.array([pixels], pa.binary()), pa.array([feature], pa.string())]
            return pa.RecordBatch.from_arrays([*own, *rest], [*names, "pages", "errors", "pixels", "feature"])

        ready, size = [], 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for i, (page, error, wide, pixels) in enumerate(rows):
                if page <= 0:
                    if own is not None:
                        ready.append(done())
                        size += ready[-1].nbytes
                        if size > OUT_BYTES:
                            yield _one_batch(ready)
                            ready, size = [], 0
                    own, parts, width, errors = [batch.column(4 + c).slice(i, 1) for c in range(len(names))], [], wide or 0, 0
                errors += error is not None
                parts.append(pixels or b"")
        if own is not None:
            ready.append(done())
        if ready:
            yield _one_batch(ready)

    return map_batches(read, work, f"{schema}, {kinds}").toDF(*kept_names(keep, ("pages", "errors", "pixels", "feature")), "pages", "errors", "pixels", "feature")


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def gray_feature(pixels: bytes, width: int) -> str:
    """Mean, spread and a difference hash over an 8 x 9 grid of block means."""
    x = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    rows = np.linspace(0, x.shape[0], 9).astype(int)
    columns = np.linspace(0, width, 10).astype(int)
    upto = np.zeros((x.shape[0] + 1, 10), np.int64)
    upto[1:] = np.cumsum(np.stack([x[:, a:b].sum(axis=1) for a, b in zip(columns[:-1], columns[1:], strict=True)] + [x.sum(axis=1)], axis=1), axis=0)
    sums = np.diff(upto[rows], axis=0)[:, :9] / np.maximum(np.diff(rows), 1)[:, None] / np.diff(columns)
    bits = np.packbits(sums[:, 1:] > sums[:, :-1]).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};dhash={bits}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    keep = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    return whole_pixels(tiff_pages(stored, keep=keep), keep).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("bigint").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -ROW_BYTES, ROW_BYTES)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "pages",
    )
