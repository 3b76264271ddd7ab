"""Bar charts as PNG files, with the standard library alone. The counts come aggregated, so they are a few rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

WIDTH, HEIGHT, EDGE = 1200, 800, 60


def _png(pixels: list[bytearray]) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def binned(values: Iterable[int], n: int) -> list[int]:
    """n values in order as WIDTH bars at most, each the greatest of its equal share, so that every value counts."""
    out = [0] * min(n, WIDTH)
    for i, v in enumerate(values):
        out[i * len(out) // n] = max(out[i * len(out) // n], v)
    return out


def bars(path: str, heights: list[int], colour: tuple[int, int, int] = (31, 119, 180)) -> str:
    pixels = [bytearray(b"\xff" * 3 * WIDTH) for _ in range(HEIGHT)]

    def box(x0: int, x1: int, y0: int, y1: int, c: tuple[int, int, int]) -> None:
        for y in range(max(0, y0), min(HEIGHT, y1)):
            pixels[y][3 * x0 : 3 * x1] = bytes(c) * (x1 - x0)

    most, inner = max([1, *heights]), HEIGHT - 2 * EDGE
    step = (WIDTH - 2 * EDGE) / max(1, len(heights))
    for i, h in enumerate(heights):
        x = int(EDGE + i * step)
        box(x, max(x + 1, int(x + 0.8 * step)), HEIGHT - EDGE - round(inner * h / most), HEIGHT - EDGE, colour)
    box(EDGE - 2, EDGE, EDGE, HEIGHT - EDGE, (0, 0, 0))
    box(EDGE - 2, WIDTH - EDGE, HEIGHT - EDGE, HEIGHT - EDGE + 2, (0, 0, 0))
    with open(path, "wb") as f:
        f.write(_png(pixels))
    return path
