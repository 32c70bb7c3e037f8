"""Chunk grids with overlapping windows, and band arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_OVERLAP, CHUNK_SIZE, TILE_SIZE, TILE_STRIDE


def _origin(k: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(0), k * size - overlap)


def _extent(origin: Column, dim: Column, size: int, overlap: int) -> Column:
    return F.least(F.lit(size + 2 * overlap), dim - origin)


def chunk_grid(images: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row per chunk of each image (..., height, width), in row-major order by (cr, cc).

    The read window starts ``overlap`` before the chunk, at 0 at the least, and is
    ``size + 2 * overlap`` long, so the first one reaches further past its chunk.
    """
    count = lambda d: F.floor((F.col(d) + size - 1) / size).cast("int")
    rows = images.withColumns({"chunk_rows": count("height"), "chunk_cols": count("width")})
    cells = rows.where("height > 0 and width > 0").withColumn("cr", F.explode(F.sequence(F.lit(0), F.col("chunk_rows") - 1))).withColumn("cc", F.explode(F.sequence(F.lit(0), F.col("chunk_cols") - 1)))
    at = cells.withColumns({"r0": _origin(F.col("cr"), size, overlap), "c0": _origin(F.col("cc"), size, overlap)})
    return at.withColumns({"h": _extent(F.col("r0"), F.col("height"), size, overlap), "w": _extent(F.col("c0"), F.col("width"), size, overlap), "chunk_id": F.format_string("%d_%d", "cr", "cc"), "total_chunks": F.col("chunk_rows") * F.col("chunk_cols")})


def _windows_of(p: Column, dim: Column, size: int, overlap: int) -> Column:
    """The chunk numbers on one axis whose window holds position p: candidates by arithmetic, then the exact test."""
    last = F.floor((dim - 1) / size).cast("int")
    high = F.least(last, F.floor((p + overlap) / size).cast("int"))
    low = F.greatest(F.lit(0), F.floor((p - overlap) / size).cast("int") - 1)

    def holds(k: Column) -> Column:
        origin = _origin(k, size, overlap)
        return (p >= origin) & (p < origin + _extent(origin, dim, size, overlap))

    return F.filter(F.sequence(low, F.greatest(low, high)), holds)


def assign_windows(pixels: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pixels (r, c, height, width, ...) once for each of the one to four windows that hold them.

    Adds cr, cc, y, x (in the window), h and w. Nothing is joined or shuffled;
    the overlap may be half a chunk at the most.
    """
    if 2 * overlap > size:
        raise ValueError("the overlap may be half a chunk at the most")
    rows = pixels.withColumn("cr", F.explode(_windows_of(F.col("r"), F.col("height"), size, overlap))).withColumn("cc", F.explode(_windows_of(F.col("c"), F.col("width"), size, overlap)))
    r0, c0 = _origin(F.col("cr"), size, overlap), _origin(F.col("cc"), size, overlap)
    return rows.withColumns({"y": F.col("r") - r0, "x": F.col("c") - c0, "h": _extent(r0, F.col("height"), size, overlap), "w": _extent(c0, F.col("width"), size, overlap)})


def normalise_band(band: Column) -> Column:
    """An array<float> scaled to 0..1 by its least and greatest value; a constant band, or one with NaN, becomes zeros."""
    low, high = F.array_min(band), F.array_max(band)
    scaled = F.transform(band, lambda v: ((v - low) / (high - low)).cast("float"))
    flat = F.transform(band, lambda v: F.lit(0.0).cast("float"))
    return F.when(F.exists(band, F.isnan) | ~(high > low), flat).otherwise(scaled)


def adapt_bands(bands: Column, want: int = 4) -> Column:
    """The first ``want`` bands of an array of bands, filled up with bands of zeros."""
    zero = F.transform(bands[0], lambda v: F.lit(0.0).cast("float"))
    return F.concat(F.slice(bands, 1, want), F.array_repeat(zero, F.greatest(F.lit(0), F.lit(want) - F.size(bands))))


def of_byte(value: Column) -> Column:
    """0..255 to 0..1, as training and evaluation feed images."""
    return (value / F.lit(255.0)).cast("float")


def to_byte(value: Column) -> Column:
    """0..1 to 0..255, cut off."""
    return (value * 255).cast("int")


def standardise(pixels: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``standard``: (v - mean) / (sample deviation + 1e-6) within each group."""
    w = Window.partitionBy(*by)
    spread = F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    return pixels.withColumn("standard", (F.col(value) - F.avg(value).over(w)) / (spread + F.lit(1e-6)))


def sliding_tiles(images: DataFrame, size: int = TILE_SIZE, stride: int = TILE_STRIDE) -> DataFrame:
    """A row per full tile (ty, tx) of each image (..., height, width); smaller images have none."""
    fits = images.where((F.col("height") >= size) & (F.col("width") >= size))
    starts = lambda d: F.sequence(F.lit(0), F.col(d) - size, F.lit(stride))
    return fits.withColumn("ty", F.explode(starts("height"))).withColumn("tx", F.explode(starts("width")))


def tiles_of(p: Column, dim: Column, size: int, stride: int) -> Column:
    """Starts of the full tiles on one axis that hold position p; none if there are none."""
    low = F.greatest(F.lit(0), F.floor((p - size) / stride).cast("int") + 1)
    high = F.least(F.floor(p / stride).cast("int"), F.floor((dim - size) / stride).cast("int"))
    return F.when((dim >= size) & (high >= low), F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def image_table(spark: SparkSession, images: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(images, "image_id string, height int, width int")


def _targets(k: Column, to: int, dim: int) -> Column:
    """Array of the target places on one axis that may take from place k: those from one of its neighbours' centres to the other's."""
    place = lambda x: (x + 0.5) * (to / dim) - 0.5
    first = F.when(k <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(place(k - 1)).cast("int")))
    last = F.when(k >= dim - 1, F.lit(to - 1)).otherwise(F.least(F.lit(to - 1), F.ceil(place(k + 1)).cast("int")))
    return F.when((k >= 0) & (k < dim) & (first <= last), F.sequence(first, F.greatest(first, last)))


def resize_bilinear(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """(image_id, tr, tc, v) at another size, corners not aligned: four neighbours, weighted by distance.

    Each pixel names the target pixels that it is a neighbour of by arithmetic, so
    nothing is joined or sent to the driver; sums are combined before the one shuffle.
    Neighbours that are missing count for nothing.
    """

    def weight(k: Column, t: Column, to: int, dim: int) -> Column:
        """Of place k in target t; the last place may be both neighbours."""
        at = F.greatest(F.lit(0.0), (t + 0.5) * (dim / to) - 0.5)
        low = F.least(F.floor(at).cast("int"), F.lit(dim - 1))
        return F.when(k == low, 1 - (at - low)).otherwise(0.0) + F.when(k == F.least(low + 1, F.lit(dim - 1)), at - low).otherwise(0.0)

    near = pixels.where("image_id is not null")
    for k, t, p, to, dim in (("r", "tr", "_pr", to_height, height), ("c", "tc", "_pc", to_width, width)):
        near = near.withColumn(t, F.explode(_targets(F.col(k), to, dim))).withColumn(p, weight(F.col(k), F.col(t), to, dim)).where(F.col(p) > 0)
    return near.groupBy("image_id", "tr", "tc").agg(F.sum(F.col("_pr") * F.col("_pc") * F.col("v")).alias("v"))


def resize_nearest(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """(image_id, tr, tc, v) at another size by the pixel that each target pixel's corner falls in; each pixel names its targets, and nothing is shuffled."""
    near = pixels.where("image_id is not null")
    for k, t, to, dim in (("r", "tr", to_height, height), ("c", "tc", to_width, width)):
        near = near.withColumn(t, F.explode(_targets(F.col(k), to, dim))).where(F.least(F.floor(F.col(t).cast("bigint") * dim / to).cast("int"), F.lit(dim - 1)) == F.col(k))
    return near.select("image_id", "tr", "tc", "v")


def square(pixels: DataFrame, height: int, width: int, size: int = 512) -> DataFrame:
    """(image_id, band, r, c, v): the first three bands of (image_id, band, r, c, v) scaled to 0..1 and resized to a square.

    Each band is resized as an image of its own; ``unsquare`` takes scores back.
    """
    own = F.struct("image_id", "band").alias("image_id")
    resized = resize_bilinear(pixels.where("band < 3").select(own, "r", "c", of_byte(F.col("v")).cast("double").alias("v")), height, width, size, size)
    return resized.select("image_id.image_id", "image_id.band", F.col("tr").alias("r"), F.col("tc").alias("c"), "v")


def unsquare(scores: DataFrame, height: int, width: int, size: int = 512) -> DataFrame:
    """(image_id, band, r, c, v): scores of a square (a band for each class) at the image's own size."""
    own = F.struct("image_id", "band").alias("image_id")
    resized = resize_bilinear(scores.select(own, "r", "c", "v"), size, size, height, width)
    return resized.select("image_id.image_id", "image_id.band", F.col("tr").alias("r"), F.col("tc").alias("c"), "v")
