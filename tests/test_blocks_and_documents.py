"""Rasters as blocks with margins, and documents in buckets."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions.constants import PALETTE
from gridwright.operators import blocks, documents, jobs, raster

PIXEL = "image_id string, band int, r int, c int, v double"


def pixels(spark, images):
    return spark.createDataFrame([(name, band, r, c, float(v)) for (name, band), grid in images.items() for (r, c), v in np.ndenumerate(grid)], PIXEL)


@pytest.mark.parametrize(("shape", "to", "size"), [((20, 13), (40, 26), 8), ((20, 13), (7, 5), 4), ((9, 9), (9, 9), 16), ((1, 30), (3, 11), 5), ((33, 17), (50, 60), 8), ((16, 16), (1, 1), 4)])
def test_blocks_resize_as_pixels_do(spark, shape, to, size):
    rng = np.random.default_rng(1)
    images = {("a", 0): rng.normal(size=shape), ("b", 2): rng.normal(size=shape)}
    found = blocks.resize_bilinear(blocks.to_blocks(pixels(spark, images), size), *shape, *to, size)
    got = {(r.image_id, r.band, r.r, r.c): r.v for r in blocks.to_pixels(found).collect()}
    want = {}
    for (name, band), grid in images.items():
        one = pixels(spark, {(name, band): grid}).select("image_id", "r", "c", "v")
        want |= {(name, band, r.tr, r.tc): r.v for r in raster.resize_bilinear(one, *shape, *to).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * to[0] * to[1] and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize(("to", "size"), [((24, 40), 4), ((7, 9), 4), ((12, 20), 8), ((30, 50), 32)])
def test_blocks_resize_images_with_gaps_as_pixels_do(spark, to, size):
    """The last row of patches isn't full, a whole block is missing, and there are holes."""
    grid = np.random.default_rng(2).normal(size=(12, 20))
    grid[8:, 9:] = np.nan
    grid[:4, 8:12] = np.nan
    grid[5, 3] = grid[0, 0] = np.nan
    rows = [("a", r, c, float(v)) for (r, c), v in np.ndenumerate(grid) if not np.isnan(v)]
    some = spark.createDataFrame(rows, "image_id string, r int, c int, v double")
    got = {(x.r, x.c): x.v for x in blocks.to_pixels(blocks.resize_bilinear(blocks.to_blocks(some, size), 12, 20, *to, size)).collect()}
    want = {(x.tr, x.tc): x.v for x in raster.resize_bilinear(some, 12, 20, *to).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_blocks_keep_pixels_and_holes(spark):
    rows = [("a", 1, 0, 0, 1.0), ("a", 1, 0, 9, 2.0), ("a", 1, 0, 9, 5.0), ("a", 1, 7, 3, 3.0), ("a", None, 1, 1, 4.0), (None, 1, 1, 1, 4.0), ("a", 1, None, 1, 4.0), ("a", 1, 1, 1, None)]
    kept = blocks.to_blocks(spark.createDataFrame(rows, PIXEL), 4)
    assert {(r.r, r.c, r.v) for r in blocks.to_pixels(kept).collect()} == {(0, 0, 1.0), (0, 9, 5.0), (7, 3, 3.0)} and kept.count() == 3
    assert blocks.to_blocks(spark.createDataFrame([], PIXEL)).count() == 0


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 0), (0, 2), (3, 3), (4, 1)])
def test_margins_are_those_of_the_image(spark, before, after):
    grid = np.arange(11 * 14, dtype=float).reshape(11, 14)
    made = blocks.to_blocks(pixels(spark, {("a", 0): grid}), 4)

    def work(block, padded):
        import pyarrow as pa

        return pa.table({"br": pa.array([block["br"]], pa.int32()), "bc": pa.array([block["bc"]], pa.int32()), "r0": pa.array([block["r0"]], pa.int32()), "c0": pa.array([block["c0"]], pa.int32()), "w": pa.array([padded.shape[1]], pa.int32()), "v": [padded.ravel().tolist()]})

    got = blocks.on_neighbourhoods(made, work, "br int, bc int, r0 int, c0 int, w int, v array<double>", before, after, 4).collect()
    assert len(got) == 12
    for b in got:
        r0, c0 = max(0, b.br * 4 - before), max(0, b.bc * 4 - before)
        want = grid[r0 : b.br * 4 + 4 + after, c0 : b.bc * 4 + 4 + after]
        assert (b.r0, b.c0) == (r0, c0) and np.array_equal(np.array(b.v).reshape(-1, b.w), want)
    with pytest.raises(ValueError, match="one block"):
        blocks.on_neighbourhoods(made, work, "br int", 5, 0, 4)


def test_pictures_of_blocks(spark):
    classes = np.arange(12).reshape(3, 4) % 7
    png = {(r.br, r.bc): bytes(r.png) for r in blocks.pictures(blocks.to_blocks(pixels(spark, {("a", 0): classes}), 3)).collect()}
    raw = zlib.decompress(png[0, 0].split(b"IDAT")[1][:-12])
    assert len(png) == 2 and [tuple(raw[1 + 3 * k : 4 + 3 * k]) for k in range(3)] == [tuple(PALETTE[int(k) % len(PALETTE)]) for k in classes[0, :3]]


PATCH = "job string, seq bigint, status string, progress double"


def store_of(tmp_path, buckets=8):
    return documents.Store(f"{tmp_path}/store", ("job", "string"), ("seq", "bigint"), {"status": "string", "progress": "double"}, buckets)


def test_deltas_give_what_the_whole_log_gives(spark, tmp_path):
    rng = random.Random(6)
    maybe = lambda x: None if rng.random() < 0.4 else x
    rows = [(rng.choice(["a", "b", "c", "d", "hot", "hot", "hot", None]), k, maybe(rng.choice(["x", "y", "z"])), maybe(rng.random())) for k in range(300)]
    rng.shuffle(rows)
    rows += [("a", None, "lost", 1.0)]
    store, log = store_of(tmp_path), spark.createDataFrame(rows, PATCH)
    want = {r.job: tuple(r) for r in jobs.fold_patches(log.where("seq is not null"), "job", "seq", ["status", "progress"]).select("job", "seq", "status", "progress").collect()}
    assert documents.documents(spark, store).count() == 0
    for part in (rows[:100], rows[100:110], rows[110:], rows[50:60]):  # the last one again
        documents.merge(spark.createDataFrame(part, PATCH), store)
    assert {r.job: tuple(r) for r in documents.documents(spark, store).collect()} == want and len(want) == 6
    assert documents.merge(spark.createDataFrame([], PATCH), store) == 0


def test_a_delta_touches_its_buckets_and_a_lookup_reads_one(spark, tmp_path):
    store = store_of(tmp_path, 16)
    documents.merge(spark.range(200).select(F.col("id").cast("string").alias("job"), F.col("id").alias("seq"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress")), store)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    assert documents.merge(spark.createDataFrame([("7", 900, "running", None)], PATCH), store) == 1
    changed = set(before.items()) ^ set(files().items())
    assert len({p.parent for p, _ in changed}) == 1 and len(before) == 16
    one = documents.lookup(spark, store, "7")
    assert [tuple(r) for r in one.collect()] == [("7", 900, "running", 0.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", plan)
    assert documents.lookup(spark, store, "none").count() == 0 and documents.documents(spark, store).count() == 200
