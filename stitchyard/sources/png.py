"""PNG files of 8 bits a channel, without interlacing: pixels from files and files from pixels."""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The first bytes of a file, and the channels of each colour type.
MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PIXELS = "path string, x int, y int, r int, g int, b int, a int"


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, upper and upper left, the one nearest to left + upper - upper left; in that order on ties."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _guess(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    return (0 * left, left, up, (left + up) // 2, _paeth(left, up, corner))[kind]


def encode(rgba: np.ndarray, kind: int = 0) -> bytes:
    """The file of (h, w, 4) pixels; every line has the filter ``kind``."""
    h, w, _ = rgba.shape
    p = np.zeros((h + 1, w + 1, 4), np.int32)
    p[1:, 1:] = rgba
    lines = (p[1:, 1:] - _guess(kind, p[1:, :-1], p[:-1, 1:], p[:-1, :-1])).astype(np.uint8).reshape(h, w * 4)
    raw = np.concatenate((np.full((h, 1), kind, np.uint8), lines), 1).tobytes()
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def decode(content: bytes) -> np.ndarray:
    """(h, w, 4) pixels of a file; the transparency of palettes is ignored. ValueError for what isn't such a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        n, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
    if not head or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("only 8 bits without interlacing")
    w, h, bpp = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h + 1, w + 1, bpp), np.int32)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(w, bpp).astype(np.int32)
        if kind in (0, 2):
            out[y + 1, 1:] = (line + (out[y, 1:] if kind else 0)) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) & 255
        else:
            for x in range(w):
                out[y + 1, x + 1] = (line[x] + _guess(kind, out[y + 1, x], out[y, x + 1], out[y, x])) & 255
    px = out[1:, 1:].astype(np.uint8)
    if head[3] == 3:
        px = palette[px[..., 0]]
    if px.shape[2] in (1, 2):
        px = np.concatenate((np.repeat(px[..., :1], 3, 2), px[..., 1:]), 2)
    return px if px.shape[2] == 4 else np.concatenate((px, np.full((h, w, 1), 255, np.uint8)), 2)


def pixels(files: DataFrame) -> DataFrame:
    """Pixels of the files of ``spark.read.format("binaryFile")``, in any number; an image is one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for path, content in zip(f.path, f.content, strict=True):
                rgba = decode(content)
                y, x = np.indices(rgba.shape[:2])
                yield pd.DataFrame({"path": path, "x": x.ravel(), "y": y.ravel()} | {c: rgba[..., i].ravel() for i, c in enumerate("rgba")})

    return files.select("path", "content").mapInPandas(run, PIXELS)


def files(images: DataFrame) -> DataFrame:
    """(path, content) of images given as pixels; missing pixels are clear."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rgba = np.zeros((int(p.y.max()) + 1, int(p.x.max()) + 1, 4), np.uint8)
        rgba[p.y, p.x] = p[list("rgba")]
        return pd.DataFrame({"path": [p.path.iloc[0]], "content": [encode(rgba)]})

    return images.groupBy("path").applyInPandas(run, "path string, content binary")
