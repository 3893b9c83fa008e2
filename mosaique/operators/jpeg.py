"""A baseline JPEG writer in numpy, for thumbnails.

Colours are not subsampled. Entropy codes are plain: four bits for each size of a DC difference and eight for each
AC symbol, which any decoder reads; files are a little larger than with tuned codes.
"""

from __future__ import annotations

import struct

import numpy as np

#: The quantisation tables of ITU-T T.81, annex K.1, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]
#: Places of a block along its diagonals, back and forth.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COSINES = np.array([[(np.sqrt(1 / 8) if k == 0 else np.sqrt(2 / 8)) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
#: AC symbols: a run of up to 15 zeros and a size of up to 10 bits; the end of a block, and 16 zeros.
_AC = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
_AC_CODE = {symbol: code for code, symbol in enumerate(_AC)}


def _table(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients in zigzag order, a row for each 8 x 8 block."""
    height, width = (-(-n // 8) * 8 for n in plane.shape)
    plane = np.pad(plane, ((0, height - plane.shape[0]), (0, width - plane.shape[1])), mode="edge") - 128
    cut = plane.reshape(height // 8, 8, width // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint((_COSINES @ cut @ _COSINES.T).reshape(-1, 64) / table).astype(int)[:, ZIGZAG]


def _part(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(pixels: np.ndarray, quality: int = 80) -> bytes:
    """The file's bytes of pixels (height, width, RGB)."""
    height, width = pixels.shape[:2]
    r, g, b = (pixels[:, :, i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    tables = [_table(LUMA, quality), _table(CHROMA, quality)]
    planes = [_blocks(y, tables[0]), _blocks(128 + (b - y) / 1.772, tables[1]), _blocks(128 + (r - y) / 1.402, tables[1])]
    bits: list[str] = []

    def number(v: int) -> tuple[int, str]:
        """Size and bits of a value; a negative one is written as its ones' complement."""
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    before = [0, 0, 0]
    for block in zip(*planes, strict=True):
        for i, row in enumerate(block):
            size, text = number(int(row[0]) - before[i])
            before[i] = int(row[0])
            bits.append(format(size, "04b") + text)
            last = 0
            for at in (np.flatnonzero(row[1:]) + 1).tolist():
                run = at - last - 1
                last = at
                bits.append(format(_AC_CODE[0xF0], "08b") * (run // 16))
                size, text = number(int(row[at]))
                bits.append(format(_AC_CODE[run % 16 << 4 | size], "08b") + text)
            if last < 63:
                bits.append(format(_AC_CODE[0], "08b"))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    dc = bytes([0, 0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
    ac = bytes([0x10, *[0] * 7, len(_AC), *[0] * 8]) + bytes(_AC)
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    quants = b"".join(bytes([i]) + bytes(t[ZIGZAG].tolist()) for i, t in enumerate(tables))
    head = _part(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _part(0xDB, quants) + _part(0xC0, frame) + _part(0xC4, dc + ac)
    return b"\xff\xd8" + head + _part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height that a JPEG's frame header names."""
    at = 2
    while data[at] == 0xFF and not 0xC0 <= data[at + 1] <= 0xC2:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
