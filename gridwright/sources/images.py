"""Colour images of masks: PNG bytes by image, GeoJSON text files, and files of bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PALETTE
from .scratch import file_system


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of (height, width, 3)."""
    height, width, _ = rgb.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, -1)], axis=1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def mask_images(mask: DataFrame, palette: list[tuple[int, int, int]] = PALETTE) -> DataFrame:
    """(image_id, width, height, png): a picture of each tile (image_id, r, c, class_id); r and c count from the tile's corner.

    Pixels without a place are left out, and those without a class, like those that
    are missing, have the colour of class 0.
    """
    colours = np.array(palette, np.uint8)

    def run(table: pa.Table) -> pa.Table:
        r, c, k = (table[n].to_numpy().astype(np.int64) for n in ("r", "c", "class_id"))
        grid = np.zeros((int(r.max()) + 1, int(c.max()) + 1), np.int64)
        grid[r, c] = k
        return pa.table({"image_id": table["image_id"].slice(0, 1), "width": pa.array([grid.shape[1]], pa.int32()), "height": pa.array([grid.shape[0]], pa.int32()), "png": [encode_png(colours[grid % len(colours)])]})

    kind = dict(mask.dtypes)["image_id"]
    return mask.select("image_id", "r", "c", F.coalesce("class_id", F.lit(0)).alias("class_id")).dropna(subset=["r", "c"]).groupBy("image_id").applyInArrow(run, f"image_id {kind}, width int, height int, png binary")


def write_geojson(collections: DataFrame, path: str) -> None:
    """One line of text for each job's collection."""
    collections.select("geojson").write.mode("overwrite").text(path)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's (path, content) below ``folder``, on a file system that tasks reach, when the result is read: (path, size).

    A file is written under another name and then renamed, so a task that runs
    again, or twice at a time, leaves whole files of the same content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = file_system(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                name = f"{base}/{path}"
                part = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, name)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "size": pa.array([len(content)], pa.int64())})

    return rows.where("content is not null").select("path", "content").mapInArrow(run, "path string, size bigint")
