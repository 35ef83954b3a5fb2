"""Write sites with a declared durability, state files, image sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CLASSES = ("scratch", "bulk", "durable")


@dataclass(frozen=True)
class SinkPolicy:
    """Root path of each class of output; a write outside its class's root is refused."""

    roots: dict[str, str]

    def path(self, kind: str, relative: str) -> str:
        if kind not in CLASSES:
            raise ValueError(f"unknown class {kind}")
        if relative.startswith("/") or ".." in relative.split("/"):
            raise PermissionError(f"{relative} leaves the {kind} root")
        return f"{self.roots[kind].rstrip('/')}/{relative}"

    def write(self, df: DataFrame, kind: str, relative: str, mode: str = "errorifexists") -> str:
        target = self.path(kind, relative)
        df.write.mode("overwrite" if kind == "scratch" else mode).parquet(target)
        return target


def png(pixels: np.ndarray) -> bytes:
    """An (h, w, 3) image with channels in [0, 1] as PNG."""
    h, w, _ = pixels.shape
    raw = np.clip(np.rint(pixels * 255), 0, 255).astype(np.uint8)
    lines = b"".join(b"\0" + raw[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def contact_sheet(tiles: list[np.ndarray], columns: int, gap: int = 1) -> np.ndarray:
    """Equal tiles in lines of `columns`, parted by black gaps."""
    h, w, _ = tiles[0].shape
    rows = -(-len(tiles) // columns)
    out = np.zeros((rows * (h + gap) - gap, columns * (w + gap) - gap, 3))
    for i, t in enumerate(tiles):
        y, x = divmod(i, columns)
        out[y * (h + gap) : y * (h + gap) + h, x * (w + gap) : x * (w + gap) + w] = t
    return out


def images(df: DataFrame, key: str, pixels: str, width: int) -> DataFrame:
    """key and png of flattened grey grids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({key: f[key], "png": [png(np.repeat(np.asarray(v, float).reshape(-1, width, 1), 3, 2)) for v in f[pixels]]})

    return df.select(key, pixels).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, png binary")
