"""Progressive JPEG: a decoder for media columns and a writer that stores bytes as coefficients.

The decoder accumulates the scans of a progressive file (DC and AC, first and refining, any spectral selection and successive
approximation) into coefficient arrays, transforms them back by one matrix product for all blocks, upsamples the chroma and returns
full-resolution RGB. Scans whose codes all have one length are decoded in bulk; others go symbol by symbol.

Pixels of a JPEG aren't lossless, its coefficients are: ``encode_payload`` stores one byte in each AC coefficient, as 256 + byte.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: the zigzag order, as row * 8 + column.
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)])
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _transform() -> np.ndarray:
    """[64 zigzag coefficients, 64 samples] of the inverse cosine transform."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _transform()


class BadImage(ValueError):
    """The bytes aren't a progressive JPEG that can be decoded."""


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that scans of this component alone cover
    cols: int = 0
    coefficients: np.ndarray = field(default=None)  # [rows of whole MCUs, columns, 64] in zigzag order


class Huffman:
    """A code table: (length, code) -> symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.codes: dict[tuple[int, int], int] = {}
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.single = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None  # the code 0


class Bits:
    """Reads bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        if self.at + n > len(self.bits):
            raise BadImage("a scan ends early")
        for b in self.bits[self.at : self.at + n].tolist():
            value = value * 2 + b
        self.at += n
        return value

    def block(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise BadImage("a scan ends early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + self.take(1)
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise BadImage("an unknown code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, as float32 around 128."""
        out = []
        for c in self.components:
            rows, cols, _ = c.coefficients.shape
            scaled = c.coefficients.reshape(-1, 64).astype(np.float32) * self.tables[c.table].astype(np.float32)
            samples = (scaled @ INVERSE).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
            out.append(samples + np.float32(128))
        return out

    def rgb(self) -> np.ndarray:
        """[height, width, 3] of uint8; grey images have three equal channels."""
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        full = []
        for c, plane in zip(self.components, self.planes()):
            if hmax != c.h:
                plane = np.repeat(plane, hmax // c.h, axis=1)
            if vmax != c.v:
                plane = np.repeat(plane, vmax // c.v, axis=0)
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(np.clip(np.rint(full[0]), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        # The YCbCr conversion of the file format.
        for k, channel in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            np.clip(np.rint(channel), 0, 255, out=channel)
            out[:, :, k] = channel
        return out


def decode(data: bytes) -> Image:
    """Coefficients of all scans. Raises BadImage if the bytes aren't a whole progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, image, dc, ac, restart = 2, None, {}, {}, 0
    quant: dict[int, np.ndarray] = {}
    comment = b""
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise BadImage("no marker where one is due")
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        if len(data) < at + 2:
            raise BadImage("a segment ends early")
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC2:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or n not in (1, 3) or not height or not width:
                raise BadImage("an unknown kind of frame")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            if any(hmax % c.h or vmax % c.v for c in parts):
                raise BadImage("an unknown sampling")
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in parts:
                c.cols, c.rows = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
                c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int16)
            image = Image(width, height, parts, quant)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadImage("not a progressive image")
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = Huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if image is None:
                raise BadImage("a scan before its frame")
            n = body[0]
            chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _SCAN_END.search(data, at)
            if end is None:
                raise BadImage("a scan without an end")
            coded, at = data[at : end.start()], end.start()
            pieces = [p.replace(b"\xff\x00", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", coded) if restart else [coded])]
            _scan(chosen, image, pieces, restart, ss, se, approx >> 4, approx & 15, dc, ac)
    if image is None:
        raise BadImage("no frame")
    image.comment = comment
    return image


def _order(chosen: list, image: Image) -> tuple[list[tuple[Component, int, np.ndarray]], int]:
    """Flat block numbers of each component in the order of the scan, and MCUs: [(component, table selector, [mcus, blocks])]."""
    if len(chosen) == 1:
        c, tables = chosen[0]
        wide = c.coefficients.shape[1]
        return [(c, tables, (np.arange(c.rows)[:, None] * wide + np.arange(c.cols)).reshape(-1, 1))], c.rows * c.cols
    c0 = chosen[0][0]
    down, across = c0.coefficients.shape[0] // c0.v, c0.coefficients.shape[1] // c0.h
    out = []
    for c, tables in chosen:
        grid = np.arange(down * c.v * across * c.h).reshape(down, c.v, across, c.h)
        out.append((c, tables, grid.transpose(0, 2, 1, 3).reshape(down * across, c.v * c.h)))
    return out, down * across


def _scan(chosen: list, image: Image, pieces: list[bytes], restart: int, ss: int, se: int, ah: int, al: int, dc: dict, ac: dict) -> None:
    parts, mcus = _order(chosen, image)
    step = restart or mcus
    for k, piece in enumerate(pieces):
        part = [(c, t, blocks[k * step : (k + 1) * step]) for c, t, blocks in parts]
        if not len(part[0][2]):
            continue
        bits = Bits(piece)
        if ss == 0:
            (_dc_refine if ah else _dc_first)(part, bits, al, dc)
        elif len(part) != 1:
            raise BadImage("AC scans hold one component")
        else:
            c, tables, blocks = part[0]
            if tables & 15 not in ac:
                raise BadImage("a missing code table")
            flat = c.coefficients.reshape(-1, 64)
            (_ac_refine if ah else _ac_first)(flat, blocks[:, 0], bits, ss, se, al, ac[tables & 15])


def _dc_first(part: list, bits: Bits, al: int, dc: dict) -> None:
    tables = [dc.get(t >> 4) for _, t, _ in part]
    if None in tables:
        raise BadImage("a missing code table")
    if all(t.single == 0 for t in tables):  # every difference is 0
        if bits.block(sum(b.size for _, _, b in part)).any():
            raise BadImage("an unknown code")
        for c, _, blocks in part:
            c.coefficients.reshape(-1, 64)[blocks.ravel(), 0] = 0
        return
    last = [0] * len(part)
    for m in range(len(part[0][2])):
        for k, (c, _, blocks) in enumerate(part):
            flat = c.coefficients.reshape(-1, 64)
            for b in blocks[m].tolist():
                last[k] += bits.value(bits.symbol(tables[k]))
                flat[b, 0] = last[k] << al


def _dc_refine(part: list, bits: Bits, al: int, dc: dict) -> None:
    width = sum(b.shape[1] for _, _, b in part)
    found = bits.block(width * len(part[0][2])).reshape(-1, width).astype(np.int16) << al
    at = 0
    for c, _, blocks in part:
        flat = c.coefficients.reshape(-1, 64)
        flat[blocks.ravel(), 0] |= found[:, at : at + blocks.shape[1]].ravel()
        at += blocks.shape[1]


def _ac_first(flat: np.ndarray, blocks: np.ndarray, bits: Bits, ss: int, se: int, al: int, table: Huffman) -> None:
    wide = se - ss + 1
    if table.single is not None and 0 < table.single < 9:  # each coefficient takes one bit of code and as many of value
        size = table.single
        raw = bits.block(len(blocks) * wide * (size + 1)).reshape(-1, size + 1)
        if raw[:, 0].any():
            raise BadImage("an unknown code")
        value = np.packbits(raw[:, 1:], axis=1)[:, 0].astype(np.int16) >> (8 - size)
        value = np.where(raw[:, 1] == 1, value, value - (1 << size) + 1)
        flat[blocks, ss : se + 1] = (value << al).reshape(-1, wide)
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                if k > se:
                    raise BadImage("a run beyond the block")
                flat[b, k] = bits.value(size) << al
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + bits.take(zeros)
                break


def _ac_refine(flat: np.ndarray, blocks: np.ndarray, bits: Bits, ss: int, se: int, al: int, table: Huffman) -> None:
    one = 1 << al
    known = flat[blocks, ss : se + 1]
    if known.all() and not any(s & 15 for s in table.symbols):  # nothing but corrections, after each run of blocks
        at = 0
        while at < len(blocks):
            zeros = bits.symbol(table) >> 4
            n = min((1 << zeros) + bits.take(zeros), len(blocks) - at)
            add = bits.block(n * known.shape[1]).reshape(n, -1).astype(np.int16) * one
            known[at : at + n] += np.where(known[at : at + n] < 0, -add, add)
            at += n
        flat[blocks, ss : se + 1] = known
        return

    def correct(b: int, k: int) -> None:
        if bits.take(1):
            flat[b, k] += one if flat[b, k] > 0 else -one

    run = 0
    for b in blocks.tolist():
        k = ss
        if not run:
            while k <= se:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= se:
                    if flat[b, k]:
                        correct(b, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            flat[b, k] = value
                        k += 1
                        break
                    k += 1
        if run:
            while k <= se:
                if flat[b, k]:
                    correct(b, k)
                k += 1
            run -= 1


# Writing --------------------------------------------------------------------------------------------------------------

#: Bytes in a block (its AC coefficients) and in a unit of six blocks: four of luma, two of chroma.
PER_BLOCK = 63
PER_UNIT = 6 * PER_BLOCK
#: Component, first and last coefficient of the scans that a payload fills, one after the other.
BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))
_MOST_UNITS_DOWN = 65535 // 16
_LONGEST_RUN = 32767
_COMMENT = re.compile(rb"payload by scans=(\d+)")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(kind: int, symbols: bytes) -> bytes:
    """A table in which all symbols (three at most) have codes of one length; the code of ones is left free."""
    length = 1 if len(symbols) == 1 else 2
    return _segment(0xC4, bytes([kind]) + bytes(len(symbols) if k == length else 0 for k in range(1, 17)) + symbols)


def _coded(bits: np.ndarray) -> bytes:
    spare = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan_head(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def _runs(blocks: int) -> list[int]:
    return [_LONGEST_RUN] * (blocks // _LONGEST_RUN) + ([blocks % _LONGEST_RUN] if blocks % _LONGEST_RUN else [])


def encode_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose AC coefficients are 256 + byte, with the byte's highest bit as the lowest, in the order of the scans.

    Fourteen scans: DC with two bits of approximation, luma in two spectral bands and chroma in one with three, then the refining scans of each.
    A first scan takes eight bits for a coefficient, code and value, so what repeats in a payload repeats in the file, and packing finds it.
    """
    units = max(1, -(-len(payload) // PER_UNIT))
    across = -(-units // _MOST_UNITS_DOWN)
    down = -(-units // across)
    units = across * down
    values = np.zeros(PER_UNIT * units, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values << 1 | values >> 7
    bands, at = [], 0
    for c, ss, se in BANDS:
        blocks = 4 * units if c == 1 else units
        bands.append((c, ss, se, values[at : at + blocks * (se - ss + 1)].reshape(blocks, -1)))
        at += bands[-1][3].size
    out = [b"\xff\xd8", _segment(0xFE, b"payload by scans=%d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    zeros = np.zeros(6 * units, np.uint8)
    out += [_codes(0, b"\x00"), _scan_head([1, 2, 3], 0, 0, 0, 1), _coded(zeros), _codes(0x10, b"\x07")]
    for c, ss, se, band in bands:
        out += [_scan_head([c], ss, se, 0, 2), (band >> 2 | 64).tobytes()]  # the code 0 and (256 + byte) / 4, which has seven bits
    out += [_scan_head([1, 2, 3], 0, 0, 1, 0), _coded(zeros)]
    symbols = bytes(sorted({(r.bit_length() - 1) << 4 for n in (4 * units, units) for r in _runs(n)}))
    out.append(_codes(0x10, symbols))
    length = 1 if len(symbols) == 1 else 2
    for al in (1, 0):
        for c, ss, se, band in bands:
            low, at, bits = band >> al & 1, 0, []
            for run in _runs(len(low)):
                size = run.bit_length() - 1
                head = symbols.index(size << 4) << size | (run - (1 << size))
                bits += [np.array([head >> k & 1 for k in range(length + size - 1, -1, -1)], np.uint8), low[at : at + run].ravel()]
                at += run
            out += [_scan_head([c], ss, se, al + 1, al), _coded(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


def stored_payload(image: Image) -> bytes:
    """The bytes that encode_payload() stored."""
    found = _COMMENT.fullmatch(image.comment)
    if not found:
        raise BadImage("no payload")
    flat = {c.ident: c.coefficients.reshape(-1, 64) for c in image.components}
    values = (np.concatenate([flat[c][:, ss : se + 1].ravel() for c, ss, se in BANDS]) - 256).astype(np.uint8)
    return (values >> 1 | values << 7).tobytes()[: int(found[1])]
