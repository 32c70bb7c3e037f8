"""From scores to classes, features and colours; the model itself is a parameter.

Defined results: null or empty scores have no class; a null class has no colour and
no feature, so its pixels vanish where classes are mapped, and stays null in a
remapped mask; an unknown or null feature has the default colour; chunks with an
error give a row with it, chunks without mapped pixels none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_COLOUR, DEFAULT_MAP_COLOUR, FEATURE_CLASSES, FEATURE_COLOURS, PALETTE
from .label import label_spans


def argmax_class(scores: Column) -> Column:
    """The index of the greatest score; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def palette_colour(class_id: Column, palette: list[tuple[int, int, int]] = PALETTE) -> Column:
    colours = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("red", "green", "blue"))]) for c in palette])
    return F.when(class_id.isNotNull(), F.element_at(colours, (F.pmod(class_id, F.lit(len(palette))) + 1).cast("int")))


def swap_red_blue(colour: Column) -> Column:
    return F.struct(colour["blue"].alias("blue"), colour["green"].alias("green"), colour["red"].alias("red"))


def class_dimension(spark: SparkSession, classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """(class_id, feature_type, feature_pos): a row per mapped class, so its size is the configuration's."""
    rows = [(i, name, pos) for pos, (name, ids) in enumerate(classes.items()) for i in ids]
    return spark.createDataFrame(rows, "class_id int, feature_type string, feature_pos int")


def map_classes(pixels: DataFrame, classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """Pixels with their feature; classes that aren't mapped vanish."""
    return pixels.join(F.broadcast(class_dimension(pixels.sparkSession, classes)), "class_id")


def colour_of(feature: Column, colours: dict[str, str] = FEATURE_COLOURS, default: str = DEFAULT_COLOUR) -> Column:
    known = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(F.try_element_at(known, feature), F.lit(default))


def map_colour(feature: Column, colours: dict[str, str] = FEATURE_COLOURS) -> Column:
    """The colour on a map, whose default is another one."""
    return colour_of(feature, colours, DEFAULT_MAP_COLOUR)


def remap_mask(class_id: Column) -> Column:
    """Training masks: class 4 becomes background."""
    return F.when(class_id == 4, F.lit(0)).otherwise(class_id)


def score_chunks(chunks: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """(path, chunk_id, cr, cc, h, w, geo_transform, crs, y, x, class_id): the mapped pixels of each chunk's mask.

    ``load`` runs once per task and returns the model: from float32 bands (bands,
    height, width) to class ids (height, width). Bands are views of Arrow's buffers,
    and pixels whose class isn't mapped never leave the task. A chunk that wasn't
    read, or that the model fails on, has no pixels: it doesn't end the job, and
    score_objects says why.
    """
    mapped = np.array(sorted({i for ids in classes.values() for i in ids}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for k in range(len(batch)):
                path, name, window, pixels, there, crs = (batch[c][k] for c in ("path", "chunk_id", "window", "pixels", "geo_transform", "crs"))
                h, w = window["height"].as_py(), window["width"].as_py()
                bands = pixels.values
                if not len(bands):
                    continue
                try:
                    mask = np.asarray(model(bands.flatten().to_numpy(zero_copy_only=False).reshape(len(bands), h, w)))
                except (ValueError, ArithmeticError, RuntimeError, IndexError):
                    continue
                y, x = np.nonzero(np.isin(mask, mapped))
                cr, cc = map(int, name.as_py().split("_"))
                n = len(y)
                if not n:
                    continue
                same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
                yield pa.RecordBatch.from_arrays([
                    same(path.as_py(), pa.string()), same(name.as_py(), pa.string()), *(same(v, pa.int32()) for v in (cr, cc, h, w)), same(there.as_py(), pa.list_(pa.float64())), same(crs.as_py(), pa.string()),
                    pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(mask[y, x].astype(np.int32)),
                ], names=["path", "chunk_id", "cr", "cc", "h", "w", "geo_transform", "crs", "y", "x", "class_id"])

    schema = "path string, chunk_id string, cr int, cc int, h int, w int, geo_transform array<double>, crs string, y int, x int, class_id int"
    return chunks.where("error is null").select("path", "chunk_id", "window", "pixels", "geo_transform", "crs").mapInArrow(run, schema)


OBJECTS = "path string, chunk_id string, cr int, cc int, h int, w int, geo_transform array<double>, crs string, feature_type string, feature_pos int, component int, area int, x1 int, y1 int, x2 int, y2 int, error string"
_STATS = ("component", "area", "x1", "y1", "x2", "y2")


def score_objects(chunks: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: dict[str, list[int]] = FEATURE_CLASSES) -> DataFrame:
    """OBJECTS: the components of each feature in each chunk's mask, labelled in the task that scored the chunk; no pixel leaves it.

    ``load`` is as for score_chunks. A file or chunk that wasn't read, and one that
    the model fails on or answers with another size, gives one row with the error; it
    doesn't end the job.
    """
    names = list(classes)
    known = np.array([i for ids in classes.values() for i in ids])
    order = np.argsort(known)
    feature = np.repeat(np.arange(len(names)), [len(ids) for ids in classes.values()])[order]
    known = known[order]
    kinds = {"cr": pa.int32(), "cc": pa.int32(), "h": pa.int32(), "w": pa.int32(), "geo_transform": pa.list_(pa.float64()), "feature_pos": pa.int32()} | {k: pa.int32() for k in _STATS}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in OBJECTS.split(", ")])

    def features_of(mask: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, mask), len(known) - 1)
        return np.where(known[at] == mask, feature[at], -1)

    def rows(own: dict, values: dict[str, np.ndarray | list], n: int) -> pa.RecordBatch:
        column = lambda f: pa.array(values[f.name], f.type) if f.name in values else pa.repeat(pa.scalar(own.get(f.name), f.type), n)
        return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for k in range(len(batch)):
                own = {c: batch[c][k].as_py() for c in ("path", "chunk_id", "geo_transform", "crs", "error")}
                window, bands = batch["window"][k].as_py(), batch["pixels"][k].values
                if own["error"] is None:
                    own["h"], own["w"] = h, w = window["height"], window["width"]
                    own["cr"], own["cc"] = map(int, own["chunk_id"].split("_"))
                    try:
                        mask = np.asarray(model(bands.flatten().to_numpy(zero_copy_only=False).reshape(len(bands), h, w)))
                        if mask.shape != (h, w):
                            raise ValueError(f"a mask of {mask.shape} for a window of {(h, w)}")
                        found = label_spans(features_of(mask))
                    except Exception as x:  # noqa: BLE001 - a model may fail in any way; its message goes into the row
                        own["error"] = f"{type(x).__name__}: {x}"
                if own["error"] is not None:
                    yield rows(own, {}, 1)
                elif len(found["kind"]):
                    labels = pa.array(names).take(pa.array(found["kind"]))
                    yield rows(own, {"feature_type": labels, "feature_pos": found["kind"]} | {s: found[s] for s in _STATS}, len(labels))

    return chunks.select("path", "chunk_id", "window", "pixels", "geo_transform", "crs", "error").mapInArrow(run, OBJECTS)


def failed_chunks(objects: DataFrame) -> DataFrame:
    """(path, chunk_id, error) of what score_objects could not score; a file that wasn't opened has no chunk_id."""
    return objects.where("error is not null").select("path", "chunk_id", "error")


def mask_metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class of (truth, predicted): pixels of each, of both, intersection over union and accuracy."""
    by = by or []
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class_id"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("truth") == F.col("predicted")).cast("int").alias("hit"))
    sums = sides.groupBy(*by, F.col("s.class_id").alias("class_id")).agg(F.sum("s.t").alias("truth_px"), F.sum("s.p").alias("predicted_px"), F.sum(F.col("hit") * F.col("s.t")).alias("both_px"))
    return sums.withColumn("iou", F.try_divide(F.col("both_px"), F.col("truth_px") + F.col("predicted_px") - F.col("both_px")))


def mean_loss(steps: DataFrame) -> DataFrame:
    """(epoch, steps, loss): the mean loss of each epoch of (epoch, loss)."""
    return steps.groupBy("epoch").agg(F.count("loss").alias("steps"), F.avg("loss").alias("loss"))
