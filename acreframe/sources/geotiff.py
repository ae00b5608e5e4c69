"""GeoTIFF: a decoder and encoder of blocks and directories; ``sources/windows`` reads files with it, a block at a time.

Classic and big files, stripped and tiled images, of whole numbers and floats in either byte order; uncompressed, LZW, Deflate
or PackBits, with horizontal or floating-point prediction. The affine transform comes from the pixel scale and tie point or
from the transformation matrix, the reference system from the geographic keys, the value for missing cells and the bands'
descriptions from their tags. What is not supported raises ValueError.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

# Tag numbers and type sizes of the TIFF format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, KEYS, DESCRIPTIONS, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048  # keys that hold the number of the reference system
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}


@dataclass
class Metadata:
    """What a file tells besides its pixels."""

    width: int
    height: int
    bands: int
    dtype: str
    transform: tuple[float, ...]  # (a, b, c, d, e, f): x = a * col + b * row + c, y = d * col + e * row + f
    nodata: float | None = None
    epsg: int | None = None
    descriptions: list[str | None] = field(default_factory=list)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(left, bottom, right, top) of a north-up raster."""
        a, _, c, _, e, f = self.transform
        return c, f + e * self.height, c + a * self.width, f


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width codes from 9 to 12 bits, most significant bit first, 256 to clear and 257 to end."""
    out, table = bytearray(), []
    bits = value = 0
    width, last = 9, b""
    for byte in data:
        value, bits = value << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, value = value >> bits, value & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The codes that ``unpack_lzw`` reads; the table is cleared before its last code would need 13 bits."""
    out, value, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal value, bits
        value, bits = value << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1

    def clear() -> None:
        nonlocal width, table, following
        put(256)
        table, following, width = {bytes([i]): i for i in range(256)}, 258, 9

    following = 258
    clear()
    held = b""
    for byte in data:
        more = held + bytes([byte])
        if more in table:
            held = more
            continue
        put(table[held])
        table[more] = following
        following += 1
        if following == 4095:
            clear()
        else:
            # The reader's table is one entry behind the writer's.
            width = 9 + (following > 511) + (following > 1023) + (following > 2047)
        held = bytes([byte])
    if held:
        put(table[held])
        width = 9 + (following + 1 > 511) + (following + 1 > 1023) + (following + 1 > 2047)
    put(257)
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs of literal and of repeated bytes, each behind its signed length."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def undo_prediction(raw: bytes, kind: np.dtype, predictor: int, rows: int, width: int, depth: int) -> np.ndarray:
    """(rows, width, depth) of a block whose rows hold differences (2), or differences of bytes by significance (3)."""
    if predictor == 1:
        return np.frombuffer(raw, kind, rows * width * depth).reshape(rows, width, depth)
    if predictor == 2:
        if kind.kind == "f":
            raise ValueError("horizontal prediction of floats")
        return np.cumsum(np.frombuffer(raw, kind, rows * width * depth).reshape(rows, width, depth), axis=1, dtype=kind.newbyteorder("="))
    if predictor == 3:
        if kind.kind != "f":
            raise ValueError("floating-point prediction of whole numbers")
        size = kind.itemsize
        parts = np.frombuffer(raw, np.uint8, rows * width * depth * size).reshape(rows, -1, depth)
        parts = np.cumsum(parts, axis=1, dtype=np.uint8).reshape(rows, size, width * depth)
        return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, depth)
    raise ValueError(f"predictor {predictor}")


def predicted(block: np.ndarray, predictor: int) -> bytes:
    """The bytes of a (rows, width, depth) block in little-endian order, as ``undo_prediction`` reads them."""
    rows, width, depth = block.shape
    if predictor == 2:
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
    elif predictor == 3:
        size = block.itemsize
        parts = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, width * depth, size).transpose(0, 2, 1).reshape(rows, -1, depth)
        return np.concatenate([parts[:, :1], parts[:, 1:] - parts[:, :-1]], axis=1).astype(np.uint8).tobytes()
    return block.astype(block.dtype.newbyteorder("<")).tobytes()


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, the first directory's tags) of a classic or big file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    version = struct.unpack(f"{order}H", data[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    count, entry, room = ("Q", 20, 8) if big else ("H", 12, 4)
    start = at + struct.calcsize("<" + count)
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + count, data[at:start])[0]):
        place = start + entry * k
        tag, kind = struct.unpack(order + "HH", data[place : place + 4])
        n = struct.unpack(order + ("Q" if big else "I"), data[place + 4 : place + 4 + room])[0]
        if kind not in TYPES:
            continue
        form = order + TYPES[kind] * n if kind != 2 else f"{n}s"
        size, where = struct.calcsize(form), place + 4 + room
        if size > room:
            where = struct.unpack(order + ("Q" if big else "I"), data[where : where + room])[0]
        tags[tag] = struct.unpack(form, data[where : where + size])
    return order, tags


def _kind(order: str, tags: dict[int, tuple]) -> np.dtype:
    bits, form = tags.get(BITS, (1,)), tags.get(FORMAT, (1,))
    if len(set(bits)) > 1 or len(set(form)) > 1 or bits[0] % 8 or form[0] not in (1, 2, 3):
        raise ValueError(f"samples of {bits} bits and formats {form}")
    return np.dtype(order + {1: "u", 2: "i", 3: "f"}[form[0]] + str(bits[0] // 8))


def metadata(data: bytes) -> Metadata:
    return metadata_of(tags_of(data)[1])


def metadata_of(tags: dict[int, tuple]) -> Metadata:
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    else:
        sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
        tie = tags.get(TIE, (0.0,) * 6)
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    text = lambda tag: tags[tag][0].rstrip(b"\0").decode("utf-8", "replace").strip() if tag in tags else None
    keys = tags.get(KEYS, ())
    of = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    bands = tags.get(SAMPLES, (1,))[0]
    names: list[str | None] = [None] * bands
    for m in re.finditer(r"<Item\b([^>]*)>([^<]*)</Item>", text(DESCRIPTIONS) or ""):
        given = dict(re.findall(r'(\w+)="([^"]*)"', m.group(1)))
        if given.get("role") == "description" and int(given.get("sample", -1)) in range(bands):
            names[int(given["sample"])] = m.group(2)
    missing = text(NODATA)
    return Metadata(tags[WIDTH][0], tags[HEIGHT][0], bands, _kind("<", tags).name, transform, float(missing) if missing else None, of.get(PROJECTED, of.get(GEOGRAPHIC)), names)


@dataclass
class Blocks:
    """How a file's pixels lie in strips or tiles: ``places`` and ``sizes`` of their bytes, plane by plane if the file is planar."""

    width: int
    height: int
    depth: int
    kind: np.dtype
    packed: int
    predictor: int
    planar: bool
    tiled: bool
    block_width: int
    block_height: int
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, order: str, tags: dict[int, tuple]) -> Blocks:
        w, h, tiled = tags[WIDTH][0], tags[HEIGHT][0], TILES in tags
        wide, high = tags.get(TILE_WIDTH, (w,))[0], tags[TILE_HEIGHT][0] if TILE_HEIGHT in tags else min(tags.get(ROWS_PER_STRIP, (h,))[0], h)
        places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
        return cls(w, h, tags.get(SAMPLES, (1,))[0], _kind(order, tags), tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0] == 2, tiled, wide, high, places, sizes)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def cells(self) -> int:
        """Blocks of a plane."""
        return self.across * -(-self.height // self.block_height)

    def numbers(self, cell: int, bands: Sequence[int]) -> list[int]:
        """The blocks that hold the bands of a cell of the grid of blocks."""
        return [band * self.cells + cell for band in bands] if self.planar else [cell]

    def unpack(self, raw: bytes, cell: int) -> np.ndarray:
        """(planes of the block, rows, columns) of the bytes of a block, without what lies beyond the file's edge."""
        if self.packed == LZW:
            raw = unpack_lzw(raw)
        elif self.packed in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif self.packed == PACKBITS:
            raw = unpack_bits(raw)
        elif self.packed != NONE:
            raise ValueError(f"compression {self.packed}")
        r, c = self.origin(cell)
        rows = self.block_height if self.tiled else min(self.block_height, self.height - r)
        block = undo_prediction(raw, self.kind, self.predictor, rows, self.block_width, 1 if self.planar else self.depth)
        return block.transpose(2, 0, 1)[:, : self.height - r, : self.width - c]

    def origin(self, cell: int) -> tuple[int, int]:
        return cell // self.across * self.block_height, cell % self.across * self.block_width

    def read(self, data, cell: int, bands: Sequence[int]) -> np.ndarray:
        """(bands, rows, columns) of a cell; ``data`` is the file's bytes, or what reads a slice of them."""
        parts = [self.unpack(data[self.places[k] : self.places[k] + self.sizes[k]], cell) for k in self.numbers(cell, bands)]
        return np.concatenate(parts) if self.planar else parts[0][list(bands)]


def decode(data: bytes, bands: Sequence[int] | None = None) -> tuple[np.ndarray, tuple[float, ...]]:
    """(array of bands, rows, columns; affine transform (a, b, c, d, e, f)); ``bands`` picks some, from 0.

    Of files that hold band by band, only the blocks of those bands are unpacked.
    """
    image, found = decoded(data, bands)
    return image, found.transform


def decoded(data: bytes, bands: Sequence[int] | None = None) -> tuple[np.ndarray, Metadata]:
    """(array of bands, rows, columns; what the file tells besides), from one reading of its directory."""
    order, tags = tags_of(data)
    blocks = Blocks.of(order, tags)
    chosen = list(range(blocks.depth)) if bands is None else list(bands)
    out = np.zeros((len(chosen), blocks.height, blocks.width), blocks.kind.newbyteorder("="))
    for cell in range(blocks.cells):
        (r, c), part = blocks.origin(cell), blocks.read(data, cell, chosen)
        out[:, r : r + part.shape[1], c : c + part.shape[2]] = part
    return out, metadata_of(tags)


def encode(image: np.ndarray, transform: tuple[float, ...], compression: str = "none", predictor: int = 1, nodata: float | None = None, epsg: int | None = None, descriptions: Sequence[str] | None = None, strip_rows: int = 256) -> bytes:
    """A classic file, band by band in strips, of a north-up raster (bands, rows, columns)."""
    bands, h, w = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    a, _, c, _, e, f = transform
    pack = {"none": bytes, "lzw": pack_lzw, "deflate": zlib.compress}[compression]
    strips = [pack(predicted(image[k, r : r + strip_rows, :, None], predictor)) for k in range(bands) for r in range(0, h, strip_rows)]
    places = (8 + np.concatenate([[0], np.cumsum([len(x) for x in strips])[:-1]])).astype(int).tolist()
    fields: list[tuple[int, str, Sequence]] = [
        (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [8 * image.itemsize] * bands), (COMPRESSION, "H", [COMPRESSIONS[compression]]), (262, "H", [1]),
        (STRIPS, "I", places), (SAMPLES, "H", [bands]), (ROWS_PER_STRIP, "I", [min(strip_rows, h)]), (STRIP_BYTES, "I", [len(x) for x in strips]),
        (PLANAR, "H", [2]), (PREDICTOR, "H", [predictor]), (FORMAT, "H", [kind] * bands), (SCALE, "d", [a, -e, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, c, f, 0.0]),
    ]
    if epsg is not None:
        # Model type 1 is projected, 2 geographic; pixels are areas.
        projected = not 4000 <= epsg < 5000
        fields.append((KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, PROJECTED if projected else GEOGRAPHIC, 0, 1, epsg]))
    if descriptions:
        items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{d}</Item>' for k, d in enumerate(descriptions) if d)
        fields.append((DESCRIPTIONS, "s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
    if nodata is not None:
        fields.append((NODATA, "s", f"{nodata!r}\0".encode()))
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    start = 8 + len(body)
    entries, extra = b"", b""
    base = start + 2 + 12 * len(fields) + 4
    for tag, form, values in fields:
        data = bytes(values) if form == "s" else struct.pack("<" + form * len(values), *values)
        entries += struct.pack("<HHI", tag, number[form], len(values))
        if len(data) <= 4:
            entries += data.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", base + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, start) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra
