"""Detections: components of mapped classes, georeferenced, scored by size and filtered.

Defined results: a detection without a polygon, or with one of fewer than four
points, is neither shown nor exported; one of an unknown or null feature is shown,
and counted under no feature; a job without detections, or without an id, has an
empty collection; an empty table gives an empty result, but 0 for each known feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import CHUNK_OVERLAP, CHUNK_SIZE, CONFIDENCE_CAP, CONFIDENCE_GAIN, DEFAULT_CRS, FEATURE_CLASSES, MIN_AREA, THRESHOLD
from ..functions.numbers import round_half_up
from .classify import colour_of, map_classes
from .label import label_components
from .raster import assign_windows


def confidence(area: Column, pixels: Column) -> Column:
    """Of a component's share of its padded window: size, not a model's belief."""
    return round_half_up(F.least(area / pixels * F.lit(float(CONFIDENCE_GAIN)), F.lit(CONFIDENCE_CAP)), 4)


def detect(
    mask: DataFrame, transform: tuple[float, ...], crs: str = DEFAULT_CRS, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    min_area: int = MIN_AREA, threshold: float = THRESHOLD, classes: dict[str, list[int]] = FEATURE_CLASSES,
) -> DataFrame:
    """Detections of a mask (image_id, r, c, class_id, height, width).

    Classes are mapped before pixels are copied to windows, so unmapped pixels
    never reach the shuffle. Objects in an overlap are found in each window.
    """
    mapped = map_classes(mask, classes)
    windows = assign_windows(mapped, size, overlap)
    r0, c0 = (F.greatest(F.lit(0), F.col(k) * size - overlap) for k in ("cr", "cc"))
    found = _objects(windows, ["image_id"], min_area, threshold).withColumns({"transform": geo.window_transform(transform, c0, r0), "crs": F.lit(crs)})
    return _placed(found, ["image_id"])


def detect_scored(scored: DataFrame, min_area: int = MIN_AREA, threshold: float = THRESHOLD, classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """Detections of classify.score_chunks: by file, each chunk in its own place."""
    found = _objects(map_classes(scored, classes), ["path", "crs", "geo_transform"], min_area, threshold)
    return _placed(found.withColumnRenamed("geo_transform", "transform"), ["path"])


def detect_objects(objects: DataFrame, min_area: int = MIN_AREA, threshold: float = THRESHOLD) -> DataFrame:
    """Detections of classify.score_objects: by file, each chunk in its own place. Nothing is shuffled."""
    parts = objects.where(F.col("error").isNull() & (F.col("area") >= min_area)).withColumn("confidence", confidence(F.col("area"), F.col("h") * F.col("w")))
    return _placed(parts.where(F.col("confidence") >= threshold).withColumnRenamed("geo_transform", "transform"), ["path"])


def _objects(windows: DataFrame, by: list[str], min_area: int, threshold: float) -> DataFrame:
    """Components of features that are large enough, with their confidence."""
    parts = label_components(windows, [*by, "cr", "cc", "h", "w", "feature_type", "feature_pos"]).where(F.col("area") >= min_area)
    return parts.withColumn("confidence", confidence(F.col("area"), F.col("h") * F.col("w"))).where(F.col("confidence") >= threshold)


def _placed(found: DataFrame, by: list[str]) -> DataFrame:
    return found.select(
        *by, "cr", "cc", "feature_pos", "component", "feature_type", "confidence", F.format_string("%d_%d", "cr", "cc").alias("chunk_id"),
        F.array("x1", "y1", "x2", "y2").alias("pixel_bbox"), geo.bbox_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("transform")).alias("geo_polygon"),
        "crs", F.col("area").alias("area_px"), colour_of(F.col("feature_type")).alias("colour"),
    )


def number_detections(found: DataFrame, image: str = "image_id") -> DataFrame:
    """Adds seq, the order in which an image's detections appear: chunk, feature, first pixel.

    Detections are numbered within their chunk; the window over an image sees one
    row for each of its chunks.
    """
    within = Window.partitionBy(image, "cr", "cc").orderBy("feature_pos", "component")
    before = Window.partitionBy(image).orderBy("cr", "cc").rowsBetween(Window.unboundedPreceding, -1)
    first = found.groupBy(image, "cr", "cc").agg(F.count("*").alias("n")).select(image, "cr", "cc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return found.withColumn("seq", F.row_number().over(within)).join(first, [image, "cr", "cc"]).withColumn("seq", (F.col("seq") + F.col("_before")).cast("int")).drop("_before")


def of_feature(found: DataFrame, feature: str | None) -> DataFrame:
    """One feature's detections; no name, or an empty one, means all."""
    return found.where(F.col("feature_type") == feature) if feature else found


def visible(found: DataFrame, filters: dict[str, bool]) -> DataFrame:
    """What the map shows: features not switched off, with a polygon of four points at least."""
    shown = F.create_map(*[F.lit(x) for pair in filters.items() for x in pair]) if filters else None
    on = F.coalesce(F.try_element_at(shown, F.col("feature_type")), F.lit(True)) if filters else F.lit(True)
    return found.where(on & (F.coalesce(F.size("geo_polygon"), F.lit(-1)) >= 4))


def count_by_type(found: DataFrame, classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """Detections of each known feature, 0 where there are none."""
    counts = found.groupBy("feature_type").agg(F.count("*").alias("n"))
    names = found.sparkSession.createDataFrame([(f, i) for i, f in enumerate(classes)], "feature_type string, feature_pos int")
    return names.join(counts, "feature_type", "left").select("feature_type", "feature_pos", F.coalesce("n", F.lit(0)).alias("n"))


def features_of(found: DataFrame) -> DataFrame:
    """GeoJSON features: a struct per detection whose polygon has four points at least."""
    properties = F.struct("feature_type", "confidence", "chunk_id", "colour", "area_px", "crs")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array("geo_polygon").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return found.where(F.size("geo_polygon") >= 4).withColumn("feature", feature)


def feature_collections(jobs: DataFrame, found: DataFrame, prefix: str = "detections_") -> DataFrame:
    """(job_id, geojson): a collection for each job, also for one without detections.

    A collection is one document, so all features of one job meet in one row.
    """
    lists = features_of(found).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "feature"))), lambda x: x["feature"]).alias("features"))
    named = jobs.join(lists, "job_id", "left")
    document = F.struct(
        F.lit("FeatureCollection").alias("type"), F.concat(F.lit(prefix), F.left(F.col("job_id").cast("string"), F.lit(8))).alias("name"),
        F.struct(F.lit("name").alias("type"), F.struct(F.coalesce("crs", F.lit(DEFAULT_CRS)).alias("name")).alias("properties")).alias("crs"),
        F.coalesce("features", F.array().cast(lists.schema["features"].dataType)).alias("features"),
    )
    return named.select("job_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("geojson"))
