"""JPEG (baseline and progressive) and GIF (first frame) decoders in numpy and Python."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_SCAN_END = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Length and symbol by the next 16 bits; 0 where no code is."""
    table, code, at = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            table[code * span : (code + 1) * span] = [length << 8 | symbols[at]] * span
            code, at = code + 1, at + 1
        code <<= 1
    if len(table) != 65536:
        raise ValueError("codes of JPEG")
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        if self.at > len(self.data) + 12:
            raise ValueError("short JPEG")
        self.at += 6
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.n += 48

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self._fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise ValueError("code of JPEG")
        self.n -= found >> 8
        return found & 255

    def take(self, count: int) -> int:
        if self.n < count:
            self._fill()
        self.n -= count
        return self.held >> self.n & ((1 << count) - 1)

    def signed(self, count: int) -> int:
        if not count:
            return 0
        value = self.take(count)
        return value if value >> (count - 1) else value - (1 << count) + 1


class _Part:
    """A component: its sampling, table, blocks in a row and a column, and coefficients."""

    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table, self.previous = h, v, table, 0


def _block(bits: _Bits, part: _Part, at: int, dc: list[int] | None, ac: list[int] | None, scan: tuple[int, int, int, int], run: int) -> int:
    """Reads one block of a scan (first and last place, high and low bit); returns the run of empty blocks left."""
    out, (start, end, high, low) = part.values, scan
    if start == 0:
        if high:
            out[at] |= bits.take(1) << low
        else:
            part.previous += bits.signed(bits.symbol(dc))
            out[at] = part.previous << low
        if end == 0:
            return 0
        start = 1
    k = start
    if not high:
        if run:
            return run - 1
        while k <= end:
            symbol = bits.symbol(ac)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                if k > end:
                    raise ValueError("place in JPEG")
                out[at + _ZIGZAG[k]] = bits.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    def refine(place: int) -> None:
        if bits.take(1) and not abs(out[place]) >> low & 1:
            out[place] += 1 << low if out[place] > 0 else -(1 << low)

    if not run:
        while k <= end:
            symbol = bits.symbol(ac)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = 1 << low if bits.take(1) else -(1 << low)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= end:
                place = at + _ZIGZAG[k]
                k += 1
                if out[place]:
                    refine(place)
                elif zeros:
                    zeros -= 1
                else:
                    out[place] = new
                    break
        else:
            return 0
    for j in range(k, end + 1):
        if out[at + _ZIGZAG[j]]:
            refine(at + _ZIGZAG[j])
    return run - 1


@lru_cache(maxsize=4)
def _basis(side: int) -> np.ndarray:
    """Cosines that turn the lowest frequencies of a block of 8 by 8 into one of side by side."""
    k = np.arange(side)
    return np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k + 1) * k[:, None] * np.pi / (2 * side))


def decode_jpeg(data: bytes, wanted: Callable[[int, int], tuple[int, int]] | None = None) -> np.ndarray:
    """Pixels (height, width, RGB) of grey, YCbCr, RGB and CMYK images of 8 bits.

    wanted tells, by an image's width and height, how many of both will do. Then the image is made at the first of an
    eighth, a quarter and half of its size that has as many, from the lowest frequencies of each block alone."""
    tables, codes, parts, every, adobe, at = {}, {}, {}, 0, None, 2
    width = height = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker of JPEG")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        if mark == 1 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                tables[body[i] & 15] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=i + 1).astype(np.float64)
                i += 65 + 64 * wide
        elif mark == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                codes[body[i]] = _lookup(counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not width or not height or n not in (1, 3, 4):
                raise ValueError("kind of JPEG")
            parts = {body[6 + 3 * i]: _Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            across, down = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            units = -(-width // (8 * across)), -(-height // (8 * down))
            for p in parts.values():
                p.columns, p.lines = units[0] * p.h, units[1] * p.v
                p.own = -(-(-(-width * p.h // across)) // 8), -(-(-(-height * p.v // down)) // 8)
                p.values = [0] * (64 * p.columns * p.lines)
        elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("kind of JPEG")
        elif mark == 0xDD:
            every = struct.unpack_from(">H", body)[0]
        elif mark == 0xEE and body.startswith(b"Adobe") and len(body) > 11:
            adobe = body[11]
        elif mark == 0xDA:
            chosen = [(parts[body[1 + 2 * i]], codes.get(body[2 + 2 * i] >> 4), codes.get(16 | body[2 + 2 * i] & 15)) for i in range(body[0])]
            start, end, bit = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            found = _SCAN_END.search(data, at)
            stop = found.start() if found else len(data)
            pieces = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:stop])]
            at = stop
            if len(chosen) == 1:
                part = chosen[0][0]
                order = [[(*chosen[0], 64 * (y * part.columns + x))] for y in range(part.own[1]) for x in range(part.own[0])]
            else:
                order = [
                    [(p, d, a, 64 * ((y * p.v + j) * p.columns + x * p.h + i)) for p, d, a in chosen for j in range(p.v) for i in range(p.h)]
                    for y in range(units[1]) for x in range(units[0])
                ]
            step = every or len(order)
            for number, begin in enumerate(range(0, len(order), step)):
                if number >= len(pieces):
                    raise ValueError("short JPEG")
                bits, run = _Bits(pieces[number]), 0
                for p, _, _ in chosen:
                    p.previous = 0
                for unit in order[begin : begin + step]:
                    for p, d, a, place in unit:
                        run = _block(bits, p, place, d, a, (start, end, bit >> 4, bit & 15), run)
    if not parts:
        raise ValueError("no image in JPEG")
    least = wanted(width, height) if wanted else (width, height)
    side = next((k for k in (1, 2, 4) if -(-width * k // 8) >= least[0] and -(-height * k // 8) >= least[1]), 8)
    height, width, planes = -(-height * side // 8), -(-width * side // 8), []
    for p in parts.values():
        own = min(8, side * min(across // p.h, down // p.v))  # what has fewer samples keeps more of them
        basis = _basis(own)
        quant = np.zeros(64)
        quant[_ZIGZAG] = tables[p.table]
        values = (np.array(p.values, dtype=np.float64).reshape(-1, 64) * quant).reshape(-1, 8, 8)
        blocks = (basis.T @ values[:, :own, :own] @ basis).reshape(p.lines, p.columns, own, own)
        plane = blocks.transpose(0, 2, 1, 3).reshape(p.lines * own, p.columns * own) + 128
        y, x = np.arange(height) * p.v * own // (down * side), np.arange(width) * p.h * own // (across * side)
        planes.append(plane[y][:, x])
    if len(planes) == 1:
        planes *= 3
    elif adobe != 0 and not (adobe is None and (len(planes) == 4 or list(parts) == [82, 71, 66])):
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    pixels = np.clip(np.rint(np.stack(planes, axis=2)), 0, 255)
    if len(planes) == 4:  # Adobe writes inks inverted
        inks = pixels if adobe is not None else 255 - pixels
        pixels = np.rint(inks[:, :, :3] * inks[:, :, 3:] / 255)
    return pixels.astype(np.uint8)


def _unpack(data: bytes, least: int, count: int) -> bytes:
    """The colour numbers of a frame."""
    clear, size = 1 << least, least + 1
    words = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, done, held, n, last = [], 0, 0, 0, None
    for byte in data:
        held |= byte << n
        n += 8
        while n >= size:
            code, held, n = held & ((1 << size) - 1), held >> size, n - size
            if code == clear:
                del words[clear + 2 :]
                size, last = least + 1, None
                continue
            if code == clear + 1 or done >= count:
                return b"".join(out)
            if code < len(words):
                word = words[code]
            elif code == len(words) and last is not None:
                word = last + last[:1]
            else:
                raise ValueError("code of GIF")
            if last is not None and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << size and size < 12:
                    size += 1
            out.append(word)
            done += len(word)
            last = word
    return b"".join(out)


def decode_gif(data: bytes) -> np.ndarray:
    """Pixels (height, width, RGB) of the first frame."""
    flags, at, colours = data[10], 13, None

    def palette(bits: int) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8, count=3 << bits, offset=at).reshape(-1, 3)

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    if flags & 128:
        colours = palette((flags & 7) + 1)
        at += len(colours) * 3
    while data[at] == 0x21:
        at = blocks(at + 2)[1]
    if data[at] != 0x2C:
        raise ValueError("no image in GIF")
    width, height, flags = struct.unpack_from("<HHB", data, at + 5)
    at += 10
    if flags & 128:
        colours = palette((flags & 7) + 1)
        at += len(colours) * 3
    if colours is None or not width or not height or not 1 <= data[at] <= 11:
        raise ValueError("kind of GIF")
    numbers = _unpack(blocks(at + 1)[0], data[at], width * height)[: width * height]
    if len(numbers) < width * height:
        raise ValueError("short GIF")
    rows = np.frombuffer(numbers, dtype=np.uint8).reshape(height, width)
    if flags & 64:
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
        rows = rows[np.argsort(order)]
    return colours[np.minimum(rows, len(colours) - 1)]
