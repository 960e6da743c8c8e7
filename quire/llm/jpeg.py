"""Baseline JPEG pictures, as motion-JPEG frames hold them.

Markers and tables are read first (frames without Huffman tables have the usual
ones), then the entropy-coded segments between restart markers, symbol by symbol
through 16-bit look-ups, then all blocks of a component are dequantised and
transformed at once. Grey and YCbCr pictures, any sampling factors.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np


class MediaError(ValueError):
    """A file or frame that can't be read."""


# The Huffman tables of the JPEG standard's annex K, as (codes of each length, symbols).
_DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "010203000411051221314106135161072271143281 91a1082342b1c11552d1f0 2433627282090a161718191a25262728292a 3435363738393a434445464748494a 535455565758595a636465666768696a"
        "737475767778797a838485868788898a 92939495969798999aa2a3a4a5a6a7a8a9aa b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9ea f1f2f3f4f5f6f7f8f9fa"
    ),
)
_AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "0001020311040521310612415107617113223281 08144291a1b1c109233352f0 156272d10a162434e125f1 1718191a262728292a 35363738393a434445464748494a 535455565758595a636465666768696a"
        "737475767778797a82838485868788898a 92939495969798999aa2a3a4a5a6a7a8a9aa b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9ea f2f3f4f5f6f7f8f9fa"
    ),
)


@functools.cache
def zigzag() -> np.ndarray:
    """Place in the block (row by row) of each coefficient in coded order: diagonals, in turns up and down."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@functools.cache
def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    out = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


@functools.lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> tuple[bytes, bytes]:
    """Symbol and length of the code that begins each 16-bit window; length 0 where none does."""
    symbol, length = bytearray(1 << 16), bytearray(1 << 16)
    code = at = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            if at >= len(symbols) or code >= 1 << bits:
                raise MediaError("a Huffman table that doesn't fit")
            first, last = code << (16 - bits), (code + 1) << (16 - bits)
            symbol[first:last] = bytes([symbols[at]]) * (last - first)
            length[first:last] = bytes([bits]) * (last - first)
            code, at = code + 1, at + 1
        code <<= 1
    return bytes(symbol), bytes(length)


@dataclass
class Component:
    name: int
    wide: int
    high: int
    table: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    restart: int = 0
    components: list[Component] = field(default_factory=list)
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    data: bytes = b""


def markers(frame: bytes) -> Picture:
    """What a frame's markers say, and the bytes of its scan."""
    if frame[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    out, at = Picture(), 2
    out.codes = {(0, 0): lookup(*_DC_LUMA), (0, 1): lookup(*_DC_CHROMA), (1, 0): lookup(*_AC_LUMA), (1, 1): lookup(*_AC_CHROMA)}
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise MediaError("no marker where one must be")
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise MediaError("a marker that is cut off")
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                if len(body) < 1 + n:
                    raise MediaError("a quantisation table that is cut off")
                out.steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif kind in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise MediaError("only pictures of 8 bits")
            out.height, out.width = struct.unpack_from(">HH", body, 1)
            out.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise MediaError("not a baseline picture")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise MediaError("a Huffman table that is cut off")
                out.codes[body[0] >> 4, body[0] & 15] = lookup(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xDD:
            out.restart = struct.unpack_from(">H", body)[0]
        elif kind == 0xDA:
            by_name = {c.name: c for c in out.components}
            if not out.width or not out.height or not out.components or body[0] != len(out.components):
                raise MediaError("only scans of all components")
            for k in range(body[0]):
                if body[1 + 2 * k] not in by_name:
                    raise MediaError("a scan of what the frame doesn't have")
                c = by_name[body[1 + 2 * k]]
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            for c in out.components:
                if not (1 <= c.wide <= 4 and 1 <= c.high <= 4) or c.table not in out.steps or (0, c.dc) not in out.codes or (1, c.ac) not in out.codes:
                    raise MediaError("a scan without its tables")
            out.data = frame[at:]
            return out


def segments(data: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, up to the end of the image, without stuffing."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        if data[at + 1] == 0 or data[at + 1] == 0xFF:
            at += 2 if data[at + 1] == 0 else 1
            continue
        out.append(data[start:at])
        if not 0xD0 <= data[at + 1] <= 0xD7:
            break
        start = at = at + 2
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _blocks(part: bytes, plan: list[tuple[int, tuple, tuple]], units: int, out: list[list[np.ndarray]]) -> None:
    """The coefficients of a segment's units, in coded order, added to each component's list."""
    limit, at = 8 * len(part), 0
    last = [0] * len(out)
    # 64 bits from every fourth byte on: a window of 16 and what follows it always lie in one of them
    words = [int.from_bytes(part[k : k + 8] + b"\xff" * max(0, 8 - len(part[k : k + 8])), "big") for k in range(0, len(part) + 8, 4)]

    def peek(n: int) -> int:
        word = words[at >> 5] if at >> 5 < len(words) else (1 << 64) - 1
        return word >> (64 - (at & 31) - n) & ((1 << n) - 1)

    for _ in range(units):
        for which, (dc_symbol, dc_length), (ac_symbol, ac_length) in plan:
            block = [0] * 64
            k = 0
            while k < 64:
                window = peek(16)
                symbol, length = (ac_symbol, ac_length) if k else (dc_symbol, dc_length)
                n = length[window]
                if not n:
                    raise MediaError("a code that isn't in the table")
                at += n
                value = symbol[window]
                zeros, n = (value >> 4, value & 15) if k else (0, value)
                if n > 15:
                    raise MediaError("a coefficient that is too large")
                number = peek(n) if n else 0
                at += n
                if n and number < 1 << (n - 1):
                    number -= (1 << n) - 1
                if not k:
                    last[which] += number
                    block[0] = last[which]
                    k = 1
                elif n:
                    k += zeros
                    if k > 63:
                        raise MediaError("a block that is too long")
                    block[k] = number
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    break
            out[which].append(block)
    if at > limit:
        raise MediaError("a frame ends too early")


def planes(frame: bytes) -> list[np.ndarray]:
    """The components of a picture in its full size, as samples 0 to 255."""
    p = markers(frame)
    wide, high = max(c.wide for c in p.components), max(c.high for c in p.components)
    if len(p.components) == 1:  # a single component isn't interleaved, whatever its factors are
        p.components[0].wide = p.components[0].high = wide = high = 1
    across, down = -(-p.width // (8 * wide)), -(-p.height // (8 * high))
    plan = [(k, p.codes[0, c.dc], p.codes[1, c.ac]) for k, c in enumerate(p.components) for _ in range(c.wide * c.high)]
    found: list[list] = [[] for _ in p.components]
    left = across * down
    for part in segments(p.data):
        units = min(left, p.restart or left)
        if not units:
            break
        _blocks(part, plan, units, found)
        left -= units
    if left:
        raise MediaError("a frame ends too early")
    out, turn = [], _cosines()
    for c, blocks in zip(p.components, found, strict=True):
        flat = np.zeros((len(blocks), 64))
        flat[:, zigzag()] = np.array(blocks, dtype=np.int64) * p.steps[c.table]
        pixels = np.einsum("kx,nkl,ly->nxy", turn, flat.reshape(-1, 8, 8), turn)
        pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
        # unit rows, unit columns, block rows and columns of a unit, pixels
        grid = pixels.reshape(down, across, c.high, c.wide, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * c.high * 8, across * c.wide * 8)
        rows = np.arange(p.height) * c.high // high
        columns = np.arange(p.width) * c.wide // wide
        out.append(grid[rows][:, columns])
    return out


def luma(frame: bytes) -> np.ndarray:
    return planes(frame)[0]


def rgb(frame: bytes) -> np.ndarray:
    """Height x width x 3; grey pictures have three equal channels."""
    own = [x.astype(np.float64) for x in planes(frame)]
    if len(own) < 3:
        return np.repeat(own[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = own[0], own[1] - 128, own[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)
