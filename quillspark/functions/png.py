"""PNG images of eight bits a channel, as arrays and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, palette, grey with alpha, RGB with alpha (fixed values).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += size + 12
    return out


def unfiltered(rows: np.ndarray, width: int) -> np.ndarray:
    """Undo the filters of rows (kind, bytes); width is that of a pixel in bytes."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int32)
    for i, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            for c in range(width):
                line[c::width] = np.cumsum(line[c::width]) & 255
        elif kind in (3, 4):
            for x in range(len(line)):
                left = int(line[x - width]) if x >= width else 0
                up = int(above[x])
                if kind == 3:
                    near = (left + up) // 2
                else:
                    corner = int(above[x - width]) if x >= width else 0
                    guess = left + up - corner
                    near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                line[x] = (line[x] + near) & 255
        elif kind != 0:
            raise ValueError("unknown row filter")
        out[i] = line
        above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """Grey as (height, width), else (height, width, channels) in the order red, green, blue, alpha."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    parts = chunks(data)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only whole PNG images of eight bits a channel are read")
    n = CHANNELS[colour]
    raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    image = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * n), n).reshape(height, width, n)
    if colour == 3:
        return np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[image[..., 0]]
    if colour == 4:
        return image[..., [0, 0, 0, 1]]
    return image[..., 0] if n == 1 else image


def encode(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    flat = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), flat), axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")
