"""Training tiles from images and vector layers.

Defined results: null rings, and rings of fewer than four points, cover nothing; of
layers that overlap the highest number wins; pixels without a place are in no tile;
images smaller than a tile have none; rows of an image that isn't among the images
are left out; equal rings count as one geometry's rings, so twice the same ring of a
geometry is a ring and its hole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import LAYER_FILES, TILE_KEEP_SHARE, TILE_SIZE, TILE_STRIDE
from ..sources.scratch import written
from .raster import tiles_of
from .spatial import meeting


def usable(path: Column) -> Column:
    """.tif files of any case whose path has no .ecw, .aux or .pyrx, and that the builder has not written itself."""
    low = F.lower(path)
    return low.endswith(".tif") & ~low.rlike(r"\.(ecw|aux|pyrx)") & ~low.contains("/processed/")


def region_of(path: Column) -> Column:
    """The layer set of an image: PB where the path has these letters in capitals, else CG."""
    return F.when(F.instr(path, "PB") > 0, F.lit("PB")).otherwise(F.lit("CG"))


def layer_files(region: str) -> list[str]:
    return LAYER_FILES[region == "PB"]


#: Systems that layers are brought into by a broadcast at most; more are joined by a shuffle.
BROADCAST_SYSTEMS = 10_000
#: Equal images, or equal rings, that one task joins with what they meet.
LOT = 10_000


def with_box(rows: DataFrame, ring: str) -> DataFrame:
    """Adds the box of an array of [x, y] points."""
    side = lambda pick, k: pick(F.transform(ring, lambda p: p[k]))
    return rows.withColumns({"bx0": side(F.array_min, 0), "by0": side(F.array_min, 1), "bx1": side(F.array_max, 0), "by1": side(F.array_max, 1)})


def _alike(*columns: str) -> Column:
    """What rows that are equal in these columns share: the digest of their JSON text, which keeps every digit, NaN and null apart."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def _each(pairs: DataFrame, members: DataFrame, by: str) -> DataFrame:
    """``pairs`` once for each member that is equal in ``by``; more than LOT members of one kind are dealt into lots, which tasks share."""
    many = members.groupBy(by).agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots")).where("lots > 1")
    lots = F.coalesce("lots", F.lit(1))
    dealt = members.join(F.broadcast(many), by, "left").withColumn("lot", F.pmod(F.xxhash64(*members.columns), lots).cast("int")).drop("lots")  # a row for each LOT members at most
    spread = pairs.join(F.broadcast(many), by, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
    return spread.join(dealt, [by, "lot"]).drop(by, "lot")


def to_pixels(layers: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, geom_id, layer_val, ring in pixels): layers (region, layer_val, geom_id, ring, crs) on images (image_id, path, crs, transform, height, width).

    An image meets the layers of its region. Images of one frame (region, system,
    transform and size) and layers of one shape (region, system and ring) are placed
    once: a shape is brought once into each system that the region's images have,
    and meets frames by cells of that system. What a pair of them costs is the
    inverse transform of the ring, and what a row of the result costs is a join of
    ids. Rings outside the image end here. A null ring, and one with a point that is
    no number, meets no image, and so does an image without a transform; a null
    system is WGS 84. Equal rows stay apart.
    """
    placed = images.select("image_id", region_of(F.col("path")).alias("region"), geo.normalise_crs(F.col("crs")).alias("system"), "transform", "height", "width")
    placed = written(placed.withColumn("frame", _alike("region", "system", "transform", "height", "width")), "images")
    named = layers.where("ring is not null").select("region", "geom_id", "layer_val", "ring", geo.normalise_crs(F.col("crs")).alias("_name"))
    named = written(named.withColumn("shape", _alike("region", "_name", "ring")), "layers")
    systems = placed.select("region", "system").distinct()
    small = F.broadcast(systems) if systems.count() <= BROADCAST_SYSTEMS else systems
    rings = named.select("shape", "region", "_name", "ring").distinct().join(small, "region")
    rings = rings.withColumns({"_from": geo.code_of(F.col("_name")), "_to": geo.code_of(F.col("system")), "_same": F.col("_name") == F.col("system")})
    rings = geo.move_rings(rings.select("region", "system", "shape", "ring", "_from", "_to", "_same"), "ring", "_from", "_to", "_same")
    frames = placed.drop("image_id").distinct()
    corners = [F.array(*geo.apply_transform(F.col("transform"), x, y)) for x in (F.lit(0), F.col("width")) for y in (F.lit(0), F.col("height"))]
    framed = with_box(frames.withColumn("corners", F.array(*corners)), "corners").drop("corners")
    pairs = meeting(with_box(rings.select("region", "system", "shape", "ring"), "ring"), framed, ["region", "system"])
    point = lambda p: geo.geo_to_pixel(F.struct(p[0].alias("x"), p[1].alias("y")), F.col("transform"))
    moved = with_box(pairs.withColumn("ring", F.transform("ring", point)), "ring")
    on = (F.col("bx0") < F.col("width")) & (F.col("bx1") > 0) & (F.col("by0") < F.col("height")) & (F.col("by1") > 0)
    found = _each(moved.where(on).select("frame", "shape", "ring"), placed.select("frame", "image_id"), "frame")
    return _each(found, named.select("shape", "geom_id", "layer_val"), "shape").select("image_id", "geom_id", "layer_val", "ring")


def rasterise(polygons: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, r, c, layer_val) of pixels whose centres lie in a polygon (image_id, layer_val, geom_id, ring in pixels).

    All rings of a geometry count together, so a ring within another is a hole. Each
    edge names the rows whose centre lines it crosses and where; a row's crossings in
    order are the ends of the spans inside. So no pixel meets an edge. Where layers
    overlap the highest number wins; partial maxima precede the shuffle.
    """
    known = polygons.where(F.col("ring").isNotNull() & (F.size("ring") >= 4)).join(images.select("image_id", "height", "width"), "image_id")
    ends = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring")), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    edges = known.select("image_id", "geom_id", "layer_val", "height", "width", F.explode(ends).alias("e")).select("*", "e.*").drop("e")
    first = F.greatest(F.lit(0), F.ceil(F.least("y1", "y2") - 0.5).cast("int"))
    last = F.least(F.col("height"), F.ceil(F.greatest("y1", "y2") - 0.5).cast("int")) - 1
    rows = edges.withColumns({"ra": first, "rb": last}).where("ra <= rb").withColumn("r", F.explode(F.sequence("ra", "rb")))
    at = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    crossed = rows.select("image_id", "geom_id", "layer_val", "width", "r", at.alias("x")).groupBy("image_id", "geom_id", "layer_val", "width", "r").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pair = lambda k: F.struct(F.greatest(F.lit(0), F.ceil(F.get("x", k * 2) - 0.5).cast("int")).alias("a"), (F.least(F.col("width"), F.ceil(F.get("x", k * 2 + 1) - 0.5).cast("int")) - 1).alias("b"))
    spans = crossed.select("image_id", "layer_val", "r", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), pair)).alias("s")).where("s.a <= s.b")
    cells = spans.select("image_id", "layer_val", "r", F.explode(F.sequence("s.a", "s.b")).alias("c"))
    return cells.groupBy("image_id", "r", "c").agg(F.max("layer_val").alias("layer_val"))


def keep_tiles(labelled: DataFrame, images: DataFrame, size: int = TILE_SIZE, stride: int = TILE_STRIDE, share: float = TILE_KEEP_SHARE) -> DataFrame:
    """(image_id, ty, tx, labelled_px): full tiles of which at least ``share`` is labelled.

    Labelled pixels name the tiles they are in; empty tiles are never made.
    """
    known = labelled.dropna(subset=["r", "c"]).join(images.select("image_id", "height", "width"), "image_id")
    at = known.withColumn("ty", F.explode(tiles_of(F.col("r"), F.col("height"), size, stride))).withColumn("tx", F.explode(tiles_of(F.col("c"), F.col("width"), size, stride)))
    counts = at.groupBy("image_id", "ty", "tx").agg(F.count("*").alias("labelled_px"))
    return counts.where(F.col("labelled_px") >= share * size * size)


def number_tiles(tiles: DataFrame) -> DataFrame:
    """Adds tile_id, running over images by id, then rows, then columns.

    Tiles are numbered within their row of tiles; the windows over images see one
    row for each row of tiles, and one for each image.
    """
    within = Window.partitionBy("image_id", "ty").orderBy("tx")
    rows = tiles.groupBy("image_id", "ty").agg(F.count("*").alias("n"))
    above = Window.partitionBy("image_id").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
    lines = rows.select("image_id", "ty", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    before = Window.orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)
    first = tiles.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = tiles.withColumn("k", F.row_number().over(within)).join(lines, ["image_id", "ty"]).join(first, "image_id")
    return numbered.withColumn("tile_id", F.col("first") + F.col("above") + F.col("k") - 1).drop("first", "above", "k")


def mask_tiles(labelled: DataFrame, tiles: DataFrame, images: DataFrame, size: int = TILE_SIZE, stride: int = TILE_STRIDE) -> DataFrame:
    """``tiles`` (image_id, ty, tx, tile_id) with ``content``: the labels of each tile as a GeoTIFF of one byte a pixel.

    Labelled pixels go to the kept tiles that hold them; a task holds one tile.
    """
    known = labelled.dropna(subset=["r", "c"]).join(images.select("image_id", "height", "width"), "image_id")
    at = known.withColumn("ty", F.explode(tiles_of(F.col("r"), F.col("height"), size, stride))).withColumn("tx", F.explode(tiles_of(F.col("c"), F.col("width"), size, stride)))
    place = tiles.select("image_id", "ty", "tx", "tile_id").join(images.select("image_id", "transform", "crs"), "image_id")
    cells = at.select("image_id", "ty", "tx", "r", "c", "layer_val").join(place, ["image_id", "ty", "tx"])

    def run(table: pa.Table) -> pa.Table:
        from ..sources.geotiff import encode

        ty, tx, t, crs = (table[n][0].as_py() for n in ("ty", "tx", "transform", "crs"))
        grid = np.zeros((1, size, size), np.uint8)
        grid[0, table["r"].to_numpy() - ty, table["c"].to_numpy() - tx] = table["layer_val"].to_numpy()
        x0, xr, rr, y0, cr, yr = t
        content = encode(grid, (xr, rr, x0 + tx * xr + ty * rr, cr, yr, y0 + tx * cr + ty * yr), int(crs[5:]) if crs and crs[5:].isdecimal() else None, deflate=True)
        return pa.table({n: table[n].slice(0, 1) for n in ("image_id", "ty", "tx", "tile_id")} | {"content": pa.array([content], pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return cells.groupBy("image_id", "ty", "tx").applyInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in ("image_id", "ty", "tx", "tile_id")) + ", content binary")


def totals(pixels: DataFrame) -> DataFrame:
    """Pixels and extent by image, and of all images."""
    found = pixels.rollup("image_id").agg(F.count("*").alias("n"), F.min("r").alias("top"), F.min("c").alias("left"), (F.max("r") + 1).alias("bottom"), (F.max("c") + 1).alias("right"), F.grouping("image_id").alias("is_total"))
    return found
