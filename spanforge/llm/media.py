"""Media columns: progressive JPEG files in binary columns, decoded to full-resolution RGB tensors.

decode() reads progressive JPEG: every scan (spectral selection and successive approximation, DC and AC, first and
refining) accumulates into coefficient arrays; they are inverse-transformed in numpy, chroma is upsampled, and the
result is an RGB tensor. Scans whose code table has a single code, as the payload writer's have, unpack as whole arrays;
all others go through the bit reader. Both give the same coefficients.

The payload writer stores bytes losslessly as quantised coefficients, 64 to a block, in three components (4:2:0) over
ten scans: the first byte of a block is the size of its DC difference, the others are signed AC coefficients of 8 bits,
of which the first scans carry 7 and the refining scans the last. A long payload takes several images, one after another.

The media column is written as a table in the shared folder and read back from there.

Defined results: null text counts as empty; a payload of no bytes takes one block; equal texts give equal media;
other columns are not carried; null media give no image; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import add_columns, cut, fields, map_lists

#: Fixed values of the JPEG standard: the zigzag order of an 8 by 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Payload bytes of an image at most.
IMAGE_BYTES = 1 << 20
_MCU = 6 * 64  # coefficients of a 16 by 16 unit: four luma blocks, two chroma blocks

_K = np.arange(8)
_DCT = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[None, :]


# ---------------------------------------------------------------- reading


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table
        self.coefficients = np.empty((0, 0, 64), dtype=np.int32)
        self.blocks = (0, 0)  # rows and columns of a scan of this component alone


class Codes:
    """A Huffman table, by (length, code); single: the symbol if there is one code only, of one bit."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lookup, code, at = {}, 0, 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.lookup[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.single = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        self.nibbles = len(symbols) == 15 and counts[3] == 15 and [*symbols] == [r << 4 for r in range(15)]


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        if self.at + n > len(self.bits):
            out <<= self.at + n - max(self.at, len(self.bits))
        self.at += n
        return out

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes.lookup:
                return codes.lookup[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> (size - 1) else x - (1 << size) + 1


class Image:
    """Parses one image from data; end is where it ends."""

    def __init__(self, data: bytes, start: int = 0):
        self.quantisers: dict[int, np.ndarray] = {}
        self.dc: dict[int, Codes] = {}
        self.ac: dict[int, Codes] = {}
        self.components: dict[int, Component] = {}
        self.comment, self.restart, self.height, self.width = b"", 0, 0, 0
        if data[start : start + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        at = start + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                self.end = at + 2
                return
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only progressive Huffman-coded images are read")
            elif marker == 0xFE:
                self.comment += body
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 64 << (wide > 0)
            self.quantisers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
            body = body[1 + n :]

    def _codes(self, body: bytes) -> None:
        while body:
            counts = body[1:17]
            n = sum(counts)
            (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = Codes(counts, body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            number, factors, table = body[6 + 3 * i : 9 + 3 * i]
            self.components[number] = Component(number, factors >> 4, factors & 15, table)
        self.h = max(c.h for c in self.components.values())
        self.v = max(c.v for c in self.components.values())
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        for c in self.components.values():
            c.coefficients = np.zeros((self.mcus[0] * c.v, self.mcus[1] * c.h, 64), dtype=np.int32)
            c.blocks = (-(-(-(-self.height * c.v // self.v)) // 8), -(-(-(-self.width * c.h // self.h)) // 8))

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        chosen = [(self.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
        high, low = approximation >> 4, approximation & 15
        end = at
        while True:  # the next marker that is no restart
            end = data.index(b"\xff", end)
            if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                break
            end += 2
        coded = data[at:end]
        if not self.restart and self._whole(chosen, first, last, high, low, coded):
            return end
        parts, start, i = [], 0, 0
        while (i := coded.find(b"\xff", i)) >= 0:
            if coded[i + 1]:
                parts.append(coded[start:i])
                start = i + 2
            i += 2
        parts.append(coded[start:])
        self._by_bits(chosen, first, last, high, low, [p.replace(b"\xff\x00", b"\xff") for p in parts])
        return end

    # ---- whole scans at once

    def _whole(self, chosen, first, last, high, low, coded: bytes) -> bool:
        if first == 0:
            tables = [self.dc.get(t >> 4) for _, t in chosen]
            sizes = {t.single for t in tables if t}
            if high or len(sizes) != 1 or None in sizes or None in tables or not (size := sizes.pop()):
                return False
            order = self._order(chosen)
            n = len(order)
            bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))[: n * (size + 1)].reshape(n, size + 1)
            value = bits[:, 1:].astype(np.int64) @ (1 << np.arange(size - 1, -1, -1))
            value = np.where(bits[:, 1] == 1, value, value - (1 << size) + 1)
            owner, place = order[:, 0], order[:, 1]
            for i, (c, _) in enumerate(chosen):
                mine = owner == i
                c.coefficients.reshape(-1, 64)[place[mine], 0] = np.cumsum(value[mine]) << low
            return True
        (c, t), codes = chosen[0], self.ac.get(chosen[0][1] & 15)
        if c.blocks != c.coefficients.shape[:2] or codes is None:
            return False
        flat, width = c.coefficients.reshape(-1, 64), last - first + 1
        if not high:
            if codes.single != 7 or b"\xff" in coded or len(coded) != len(flat) * width:
                return False
            raw = np.frombuffer(coded, np.uint8).astype(np.int32).reshape(-1, width)
            if raw.max(initial=0) > 127:
                return False
            flat[:, first : last + 1] = np.where(raw >= 64, raw, raw - 127) << low
            return True
        if not codes.nibbles or not flat[:, first : last + 1].all():
            return False
        bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))
        at = done = 0
        steps = []
        while done < len(flat):
            r = int("".join(map(str, bits[at : at + 4])), 2)
            if r == 15:
                return False
            run = (1 << r) + (int("".join(map(str, bits[at + 4 : at + 4 + r])), 2) if r else 0)
            at += 4 + r
            steps.append(bits[at : at + run * width])
            at, done = at + run * width, done + run
        more = np.concatenate(steps).reshape(-1, width).astype(np.int32)
        part = flat[:, first : last + 1]
        flat[:, first : last + 1] = part + np.sign(part) * (more << low)
        return True

    def _order(self, chosen) -> np.ndarray:
        """(which of chosen, block) in the order of the scan."""
        if len(chosen) == 1:
            c = chosen[0][0]
            rows, columns = np.indices(c.blocks)
            return np.stack([np.zeros(rows.size, np.int64), (rows * c.coefficients.shape[1] + columns).ravel()], axis=1)
        return _interleaved(self.mcus, tuple((c.v, c.h) for c, _ in chosen))

    # ---- bit by bit

    def _by_bits(self, chosen, first, last, high, low, parts: list[bytes]) -> None:
        order = self._order(chosen)
        unit = sum(c.h * c.v for c, _ in chosen) if len(chosen) > 1 else 1
        step = self.restart * unit or len(order)
        for i, part in enumerate(parts):
            bits, run, before = Bits(part), 0, [0] * len(chosen)
            for who, place in order[i * step : (i + 1) * step].tolist():
                c, tables = chosen[who]
                block = c.coefficients.reshape(-1, 64)[place]
                if first == 0 and not high:
                    before[who] += bits.signed(bits.symbol(self.dc[tables >> 4]))
                    block[0] = before[who] << low
                elif first == 0:
                    block[0] |= bits.take(1) << low
                elif not high:
                    run = self._ac_first(bits, block, self.ac[tables & 15], first, last, low, run)
                else:
                    run = self._ac_more(bits, block, self.ac[tables & 15], first, last, low, run)

    @staticmethod
    def _ac_first(bits, block, codes, k, last, low, run) -> int:
        if run:
            return run - 1
        while k <= last:
            zeros, size = divmod(bits.symbol(codes), 16)
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def _ac_more(bits, block, codes, k, last, low, run) -> int:
        def refine(i: int) -> None:
            if bits.take(1):
                block[i] += (1 << low) if block[i] > 0 else -(1 << low)

        if not run:
            while k <= last:
                zeros, size = divmod(bits.symbol(codes), 16)
                value = 0
                if size:
                    value = (1 if bits.take(1) else -1) << low
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        refine(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    block[k] = value
                k += 1
            else:
                return 0
        for i in range(k, last + 1):
            if block[i]:
                refine(i)
        return run - 1

    # ---- to samples

    def rgb(self) -> np.ndarray:
        """height by width by 3, uint8."""
        planes = []
        for c in self.components.values():
            rows, columns = c.coefficients.shape[:2]
            square = np.zeros((rows * columns, 64))
            square[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * self.quantisers[c.table]
            pixels = _DCT @ square.reshape(-1, 8, 8) @ _DCT.T
            plane = pixels.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
            plane = np.clip(np.rint(plane + 128), 0, 255)
            if (c.v, c.h) != (self.v, self.h):
                plane = plane.repeat(self.v // c.v, axis=0).repeat(self.h // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@lru_cache(maxsize=256)
def _interleaved(mcus: tuple[int, int], factors: tuple[tuple[int, int], ...]) -> np.ndarray:
    rows, columns = np.indices(mcus).reshape(2, -1)
    parts = []
    for who, (v, h) in enumerate(factors):
        for y in range(v):
            for x in range(h):
                parts.append(np.stack([np.full(rows.size, who), (rows * v + y) * (mcus[1] * h) + columns * h + x], axis=1))
    out = np.stack(parts, axis=1).reshape(-1, 2)
    out.setflags(write=False)
    return out


def images(media: bytes) -> Iterator[Image]:
    at = 0
    while at < len(media):
        image = Image(media, at)
        yield image
        at = image.end


# ---------------------------------------------------------------- payloads


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Tables of the payload writer: one code each for DC differences of 9 bits and AC values of 7, and runs of ended bands.
_TABLES = b"".join(
    _segment(0xC4, bytes([kind, *counts, *symbols]))
    for kind, counts, symbols in (
        (0x00, [1] + [0] * 15, [9]),
        (0x10, [1] + [0] * 15, [7]),
        (0x11, [0, 0, 0, 15] + [0] * 12, [r << 4 for r in range(15)]),
    )
)
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + _TABLES
#: Component, first and last coefficient of each AC band.
_BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def _coded(bits: np.ndarray) -> bytes:
    fill = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8)


def _runs(correction: np.ndarray) -> np.ndarray:
    """Bits of a refining scan in which every coefficient is known already: runs of ended bands, each with its corrections."""
    out, longest = [], (1 << 14)
    for i in range(0, len(correction), longest):
        part = correction[i : i + longest]
        r = len(part).bit_length() - 1
        head = (r << r) | (len(part) - (1 << r))
        out += [_bits(np.array([head]), 4 + r)[0], part.ravel()]
    return np.concatenate(out)


def write_payload(payload: bytes, n_bytes: int) -> bytes:
    """Images that hold the payload (a positive multiple of 64 bytes) and its length without padding."""
    out = []
    for at in range(0, len(payload), IMAGE_BYTES):
        out.append(_image(payload[at : at + IMAGE_BYTES], n_bytes if at == 0 else 0))
    return b"".join(out)


def _image(payload: bytes, n_bytes: int) -> bytes:
    units = -(-len(payload) // _MCU)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    data = np.zeros((6 * across * down, 64), dtype=np.int16)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    edges = np.cumsum([0, 4 * across * down, across * down, across * down])
    parts = [data[edges[i] : edges[i + 1]] for i in range(3)]
    out = [_HEAD, _segment(0xFE, b"%d %d" % (len(payload), n_bytes))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    order = _interleaved((down, across), ((2, 2), (1, 1), (1, 1)))
    differences = np.empty(len(order), dtype=np.int64)
    for i, part in enumerate(parts):  # each difference is 256 and more; its sign keeps the sum small
        mine, level = [], 0
        for size in (part[:, 0] + 256).tolist():
            step = -size if level >= 0 else size
            mine.append(step)
            level += step
        places = order[order[:, 0] == i, 1]
        differences[order[:, 0] == i] = mine if len(places) else []
    coded = np.concatenate([np.zeros((len(order), 1), np.uint8), _bits(np.where(differences > 0, differences, differences + 511), 9)], axis=1)
    out.append(_segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 0, 0])) + _coded(coded.ravel()))
    size = [(p & 127) + 128 for p in parts]
    signs = [p >= 128 for p in parts]
    for c, first, last in _BANDS:
        half, positive = size[c - 1][:, first : last + 1] >> 1, signs[c - 1][:, first : last + 1]
        raw = np.where(positive, half, 127 - half).astype(np.uint8)  # a zero code bit and 7 bits: a byte under 128
        out.append(_segment(0xDA, bytes([1, c, 0x00, first, last, 0x01])) + raw.tobytes())
    for c, first, last in _BANDS:
        bits = (size[c - 1][:, first : last + 1] & 1).astype(np.uint8)
        out.append(_segment(0xDA, bytes([1, c, 0x01, first, last, 0x10])) + _coded(_runs(bits)))
    out.append(b"\xff\xd9")
    return b"".join(out)


def read_payload(image: Image) -> tuple[bytes, int]:
    """The payload in an image's coefficients, and the unpadded length that it notes."""
    length, n_bytes = map(int, image.comment.split())
    rows = []
    order = _interleaved(image.mcus, ((2, 2), (1, 1), (1, 1)))
    for i, c in enumerate(image.components.values()):
        flat = c.coefficients.reshape(-1, 64)
        data = np.empty(flat.shape, dtype=np.uint8)
        places = order[order[:, 0] == i, 1]
        data[:, 0] = np.abs(np.diff(flat[places, 0], prepend=0)) - 256
        data[:, 1:] = (np.abs(flat[:, 1:]) - 128) + np.where(flat[:, 1:] > 0, 128, 0)
        rows.append(data)
    return np.concatenate(rows).tobytes()[:length], n_bytes


# ---------------------------------------------------------------- columns


def encode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as progressive JPEG."""

    def step(batch: dict[str, list]) -> dict[str, list]:
        media = []
        for text in batch[text_col]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            media.append(write_payload(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)))
        return {id_col: batch[id_col], "media": media}

    schema = StructType([docs.schema[id_col], StructField("media", BinaryType())])
    return map_lists(docs.select(id_col, text_col), lambda: step, schema, rows=200)


def store(media: DataFrame) -> DataFrame:
    """The table of media as it is stored: written once, and read from its files."""
    return cut(media)


def payload_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored media back: sizes and digests of the payload and of the stored form, and a feature of the RGB tensor."""

    def features(stored: bytes) -> tuple:
        payload, n_bytes, sums, shapes = [], 0, np.zeros(6, dtype=np.int64), []
        for image in images(stored):
            part, n = read_payload(image)
            payload.append(part)
            n_bytes += n
            rgb = image.rgb()
            sums += np.concatenate([rgb.sum(axis=(0, 1), dtype=np.int64), (rgb > 127).sum(axis=(0, 1), dtype=np.int64)])
            shapes.append(f"{rgb.shape[1]}x{rgb.shape[0]}")
        whole = b"".join(payload)
        feature = f"{len(shapes)}:{shapes[0]}:" + ",".join(map(str, sums.tolist()))
        return n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    added = fields("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def step(stored: list[bytes]) -> dict[str, list]:
        return dict(zip(added.names, map(list, zip(*map(features, stored)))))

    return add_columns(media, lambda: step, "media", added, rows=200).drop("media")


def decode(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """id, image (its number in the value), height, width, tensor (RGB, row by row, uint8); null media give no rows."""
    schema = StructType([media.schema[id_col], *fields("image int, height int, width int, tensor binary").fields])

    def step(batch: dict[str, list]) -> dict[str, list] | None:
        rows = []
        for key, value in zip(batch[id_col], batch[media_col]):
            for i, image in enumerate(images(value) if value is not None else ()):
                rgb = image.rgb()
                rows.append((key, i, *rgb.shape[:2], rgb.tobytes()))
        return dict(zip(schema.names, map(list, zip(*rows)))) if rows else None

    return map_lists(media.select(id_col, media_col), lambda: step, schema, rows=1)
