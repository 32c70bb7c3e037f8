"""The raster, detection, job, upload, tile and streaming operators."""

import io
import json
import random
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions import geo
from gridwright.functions.numbers import progress_percent, round_half_up
from gridwright.operators import classify, detect, jobs, raster, tiles, upload
from gridwright.operators.label import label_components, label_pixels
from gridwright.plans import queries as plans
from gridwright.sources import archives, geotiff, images, vectors
from gridwright.streaming import messages as stream


def picture(art):
    return [(r, c) for r, line in enumerate(art.split()) for c, x in enumerate(line) if x == "#"]


@pytest.mark.parametrize(
    ("art", "areas"),
    [("#", [1]), ("#.\n.#", [2]), ("#.#\n...\n#.#", [1, 1, 1, 1]), ("###\n#.#\n###", [8]), ("#.#\n#.#\n###", [7]), ("#..#\n.##.", [4]), ("##..\n....\n..##", [2, 2]), ("#.#.#\n.#.#.", [5])],
)
def test_labels(art, areas):
    y, x = np.array(picture(art)).T
    assert list(np.bincount(label_pixels(y, x))) == areas


def test_labels_do_not_depend_on_order(spark):
    rng = random.Random(1)
    cells = [(r, c) for r in range(40) for c in range(40) if rng.random() < 0.4]
    got = []
    for n in (1, 5):
        rng.shuffle(cells)
        df = spark.createDataFrame([("a", y, x) for y, x in cells] + [("b", 3, 3), ("b", 3, 3)], "k string, y int, x int").repartition(n)
        got.append(sorted(label_components(df, ["k"]).collect()))
    assert got[0] == got[1] and got[0][-1] == ("b", 0, 1, 3, 3, 4, 4) and sum(r.area for r in got[0]) == len(cells) + 1


@pytest.mark.parametrize("dim", [1, 1024, 1025, 1088, 1152, 2048, 3000])
def test_windows(spark, dim):
    grid = raster.chunk_grid(raster.image_table(spark, [("i", dim, 10)])).orderBy("cr").collect()
    n = -(-dim // 1024)
    assert [(g.r0, g.h) for g in grid] == [(max(0, 1024 * k - 64), min(1152, dim - max(0, 1024 * k - 64))) for k in range(n)]


def test_every_pixel_has_its_windows(spark):
    for dim in (1, 31, 32, 33, 36, 40, 64, 100):
        px = spark.range(dim).select(F.lit("i").alias("image_id"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(dim).alias("height"), F.lit(1).alias("width"))
        got = sorted((x.r, x.cr) for x in raster.assign_windows(px, 32, 4).collect())
        spans = [(k, max(0, 32 * k - 4)) for k in range(-(-dim // 32))]
        assert got == sorted((r, k) for r in range(dim) for k, o in spans if o <= r < o + min(40, dim - o))
    with pytest.raises(ValueError):
        raster.assign_windows(px, 8, 5)


def test_sliding_tiles(spark):
    got = raster.sliding_tiles(raster.image_table(spark, [("small", 1023, 5000), ("one", 1024, 1024), ("two", 1536, 2047)])).collect()
    assert sorted((g.image_id, g.ty, g.tx) for g in got) == [("one", 0, 0), ("two", 0, 0), ("two", 0, 512), ("two", 512, 0), ("two", 512, 512)]


def test_bands(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0],), ([1.0, float("nan")],), ([],)], "b array<float>")
    got = [r[0] for r in df.select(raster.normalise_band(F.col("b"))).collect()]
    assert got == [[0.0, 0.5, 1.0], [0.0, 0.0], [0.0, 0.0], []]
    assert [r[0] for r in df.select(raster.adapt_bands(F.array("b", "b"))).collect()][0] == [[1, 2, 3], [1, 2, 3], [0, 0, 0], [0, 0, 0]]


def test_argmax_and_colours(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], "road"), ([0.0], "boat")], "s array<double>, f string")
    got = df.select(classify.argmax_class(F.col("s")), classify.colour_of(F.col("f")), classify.palette_colour(F.lit(-1))).collect()
    assert [tuple(r[:2]) for r in got] == [(1, "#4488FF"), (0, "#888888")] and tuple(got[0][2]) == (255, 255, 0)


def test_files_to_detections(spark, tmp_path):
    """Two files through their windows and a model; a window the model fails on, and a broken file, don't end the job."""
    grid = np.zeros((1, 40, 70), np.float32)
    grid[0, 2:12, 3:20], grid[0, 30:39, 50:69] = 1, 2
    for name, data in (("a.tif", grid), ("b.tif", grid * 3)):
        (tmp_path / name).write_bytes(geotiff.encode(data, (0.5, 0, 1000.0, 0, -0.5, 2000.0), 32644, deflate=True))
    (tmp_path / "c.tif").write_bytes(b"II*\0junk")

    def load():
        def model(bands):
            if bands.max() > 5:
                raise ValueError("no such image")
            return np.select([bands[0] == 1, bands[0] == 2, bands[0] == 3], [1, 6, 21], 99)

        return model

    for files in (geotiff.read_files(spark, str(tmp_path)), geotiff.read_files(spark, str(tmp_path), content=True)):
        found = detect.detect_scored(classify.score_chunks(geotiff.chunks(files, 64, 4), load), 20, 0.0).collect()
        got = sorted((r.path.rpartition("/")[2], r.chunk_id, r.feature_type, r.area_px, r.pixel_bbox, r.geo_polygon[0], r.crs) for r in found)
        # the second object lies in both windows, and the model fails on those of the second file
        assert got == [
            ("a.tif", "0_0", "building", 170, [3, 2, 20, 12], [1001.5, 1999.0], "EPSG:32644"), ("a.tif", "0_0", "road", 171, [50, 30, 69, 39], [1025.0, 1985.0], "EPSG:32644"),
            ("a.tif", "0_1", "road", 81, [0, 30, 9, 39], [1030.0, 1985.0], "EPSG:32644"),
        ]


def test_ready_bands_are_those_of_the_column_functions(spark):
    bands = np.array([[[1.0, 3.0], [2.0, 5.0]], [[7.0, 7.0], [7.0, 7.0]], [[1.0, np.nan], [2.0, 3.0]]], np.float32)
    df = spark.createDataFrame([([[float(v) for v in b.ravel()] for b in bands],)], "b array<array<float>>")
    want = df.select(F.transform(raster.adapt_bands(F.col("b")), raster.normalise_band).alias("b")).first().b
    assert np.array_equal(geotiff.ready_bands(bands).reshape(4, -1), np.array(want, np.float32))


def test_rounding(spark):
    df = spark.createDataFrame([(1.00005,), (2.5,), (0.12345,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 0)).collect()] == [1.0, 3.0, 0.0]
    assert spark.range(1).select(progress_percent(F.lit(1), F.lit(0))).first()[0] is None


def test_detection_limits(spark):
    square = lambda r0, n: [("i", r0 + k // n, k % n, 1, 200, 200) for k in range(n * n)]
    cells = square(0, 10) + square(50, 9) + [("i", 100, c, 999, 200, 200) for c in range(150)]
    mask = spark.createDataFrame(cells, "image_id string, r int, c int, class_id int, height int, width int")
    got = detect.detect(mask, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), threshold=0.0).collect()
    assert [(d.area_px, d.feature_type, d.pixel_bbox, d.confidence) for d in got] == [(100, "building", [0, 0, 10, 10], 0.05)]
    assert got[0].geo_polygon == [[0, 0], [10, 0], [10, -10], [0, -10], [0, 0]] and got[0].chunk_id == "0_0"
    assert detect.detect(mask, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)).count() == 0  # 0.05 is below the default threshold


def test_objects_in_an_overlap_are_found_twice(spark):
    mask = spark.createDataFrame([("i", r, 0, 6, 64, 1) for r in range(26, 38)], "image_id string, r int, c int, class_id int, height int, width int")
    got = detect.detect(mask, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), size=32, overlap=4, min_area=1, threshold=0.0).collect()
    assert sorted((d.chunk_id, d.area_px) for d in got) == [("0_0", 12), ("1_0", 10)]


def test_collections(spark):
    found = spark.createDataFrame([(1, 2, "road", 0.5, "0_0", 200, None, "EPSG:1", [[0.0, 0.0]] * 5), (1, 1, "water", 0.25, "0_0", 100, "#1", "EPSG:1", [[1.0, 1.0]] * 4), (1, 3, "road", 0.5, "0_0", 9, None, None, [[0.0, 0.0]] * 3)], "job_id int, seq int, feature_type string, confidence double, chunk_id string, area_px int, colour string, crs string, geo_polygon array<array<double>>")
    import json

    got = {r.job_id: json.loads(r.geojson) for r in detect.feature_collections(spark.createDataFrame([(1, "Unknown"), (2, None)], "job_id int, crs string"), found).collect()}
    assert [f["properties"]["feature_type"] for f in got[1]["features"]] == ["water", "road"] and got[1]["features"][1]["properties"]["colour"] is None
    assert got[1]["crs"]["properties"]["name"] == "Unknown" and got[2]["features"] == [] and got[2]["crs"]["properties"]["name"] == "EPSG:4326"
    assert got[1]["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [[[1.0, 1.0]] * 4]}


def test_projections(spark):
    got = spark.range(1).select(geo.to_wgs84(F.lit(9e6), F.lit(2e6), F.lit("EPSG:3857")), geo.to_wgs84(F.lit(5e5), F.lit(2.3e6), F.lit("urn:ogc:def:crs:EPSG::32644")), geo.to_wgs84(F.lit(1.0), F.lit(2.0), F.lit("EPSG:2193")), geo.to_wgs84(F.lit(1.0), F.lit(2.0), F.lit(None).cast("string"))).first()
    assert got[0] == pytest.approx((80.84837557, 17.67891424)) and got[1] == pytest.approx((81.0, 20.79987938)) and got[2] == (1, 2) and got[3] == (1, 2)
    points = spark.range(500).select((78 + F.col("id") % 7 * 0.9).alias("lng"), (F.col("id") * 0.16 - 40).alias("lat"))
    south = F.col("lat") < 0
    flat = points.select("*", geo.wgs84_to_utm(F.col("lng"), F.col("lat"), F.lit(44), south).alias("p"))
    back = flat.select("lng", "lat", geo.utm_to_wgs84(F.col("p.x"), F.col("p.y"), F.lit(44), south).alias("b"))
    assert back.agg(F.max(F.abs(F.col("b.lng") - F.col("lng"))), F.max(F.abs(F.col("b.lat") - F.col("lat")))).first() == pytest.approx((0, 0), abs=1e-9)


def test_ring_to_lat_lng_and_bounds(spark):
    got = spark.range(1).select(geo.ring_to_lat_lng(F.array(F.array(F.lit(1.0), F.lit(2.0))), F.lit("EPSG:4326")), geo.centre_of(geo.bounds_to_lat_lng(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("x")))).first()
    assert got[0] == [[2.0, 1.0]] and got[1] == [20.5937, 78.9629]


def test_rasterise_odd_shapes(spark):
    """A concave ring, one that lies outside, a null one; the highest layer wins."""
    rings = [("i", 1, [[0.25, 0.25], [6.25, 0.25], [6.25, 6.25], [3.25, 1.75], [0.25, 6.25], [0.25, 0.25]]), ("i", 4, [[-9.0, -9.0], [-3.0, -9.0], [-3.0, -3.0], [-9.0, -9.0]]), ("i", 2, None), ("i", 3, [[0.25, 0.25], [1.75, 0.25], [1.75, 1.75], [0.25, 1.75], [0.25, 0.25]])]
    got = {(r.r, r.c): r.layer_val for r in tiles.rasterise(spark.createDataFrame([(i, k, *r) for k, (i, *r) in enumerate(rings)], "image_id string, geom_id int, layer_val int, ring array<array<double>>"), raster.image_table(spark, [("i", 5, 5)])).collect()}
    assert got[0, 0] == 3 and got[1, 1] == 3 and got[0, 4] == 1 and (4, 3) not in got and (4, 0) in got and set(got.values()) == {1, 3}


def test_tile_numbers_run_over_images(spark):
    kept = spark.createDataFrame([("b", 0, 0), ("a", 512, 0), ("a", 0, 512), ("a", 0, 0)], "image_id string, ty int, tx int")
    assert sorted((r.tile_id, r.image_id, r.ty, r.tx) for r in tiles.number_tiles(kept).collect()) == [(0, "a", 0, 0), (1, "a", 0, 512), (2, "a", 512, 0), (3, "b", 0, 0)]


def test_uploads(spark):
    files = spark.createDataFrame([(1, b"abcdefgh"), (2, b""), (3, bytes(range(256)))], "id int, data binary")
    parts = upload.split_parts(files, "id", "data", 3)
    assert {r.id: r.n for r in parts.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 1, 3: 86}
    back = upload.reassemble(parts.union(parts).repartition(3), "id").collect()
    assert {r.id: (bytes(r.content), r.received, r.distinct_parts) for r in back} == {1: (b"abcdefgh", 6, 3), 2: (b"", 2, 1), 3: (bytes(range(256)), 172, 86)}
    lost = upload.reassemble(parts.where("not (id = 1 and idx = 1)"), "id").withColumn("total_chunks", F.when(F.col("id") == 1, 3).when(F.col("id") == 2, 1).otherwise(86))
    assert sorted(r.id for r in upload.complete(lost).collect()) == [2, 3]


def test_upload_limits(spark):
    df = spark.createDataFrame([("a.tif", 6 * 1024**3), ("a.tif", 6 * 1024**3 + 1), ("a.TIFF", 1), ("a.png", 1), ("a.tif.gz", 1)], "filename string, total_size bigint")
    assert [r.http_status for r in upload.validate(df).collect()] == [200, 413, 200, 400, 400]


def test_documents(spark):
    log = spark.createDataFrame([("j", 1, "queued", None), ("j", 2, "running", 10.0), ("j", 3, None, 20.0), ("k", 1, None, None)], "job string, seq int, status string, progress double")
    assert sorted(jobs.fold_patches(log, "job", "seq", ["status", "progress"]).collect()) == [("j", "running", 20.0, 3), ("k", None, None, 1)]
    assert sorted(map(str, jobs.latest(log, "job", "seq").collect()))[0] == "Row(job='j', seq=3, status=None, progress=20.0)"
    assert jobs.alive(spark.createDataFrame([(1.0,), (100_000.0,)], "updated_at double"), F.lit(86_402)).count() == 1


def test_states_by_batch_and_stream(spark, tmp_path):
    log = [(1, 1, "started", 4, None, None), (1, 2, "chunk_done", 4, 3, None), (1, 3, "error", None, None, "boom"), (1, 4, "chunk_done", 4, 9, None), (2, 5, "ping", None, None, None), (3, 1, "started", 2, None, None), (3, 2, "chunk_done", 2, 1, None), (3, 3, "chunk_done", 2, 1, None), (3, 4, "completed", None, None, None)]
    schema = "job_id bigint, seq bigint, type string, total_chunks int, n_det int, error string"
    spark.createDataFrame(log, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    table = spark.read.parquet(f"{tmp_path}/log")
    want = [(1, "failed", 1, 4, 3, 25.0, "boom"), (2, "queued", 0, 0, 0, 0.0, None), (3, "completed", 2, 2, 2, 100.0, None)]
    assert sorted(tuple(r) for r in stream.final_states(table).collect()) == want
    live = stream.job_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"))
    assert sorted(tuple(r) for r in stream.run_once(live, "update", f"{tmp_path}/c").collect()) == want
    past, tail = stream.snapshot_and_tail(spark, f"{tmp_path}/log", schema, 1, 2)
    assert [r.seq for r in past.collect()] == [1, 2] and tail.isStreaming
    got = stream.run_once(tail, "append", f"{tmp_path}/c2")
    assert sorted(r.seq for r in got.collect()) == [3, 4]
    stream.append_to(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(log)


def test_batch_and_stream_agree_on_random_logs(spark, tmp_path):
    """With nulls in every column, numbers out of order and messages after the end."""
    rng = random.Random(21)
    maybe = lambda x: None if rng.random() < 0.3 else x
    log = [(rng.choice([1, 2, 3, 4, 5, None]), k if rng.random() < 0.95 else None, rng.choice(["started", "chunk_done", "chunk_done", "chunk_done", "ping", None, *(["completed", "error"] if k % 40 == 0 else [])]), maybe(rng.randint(0, 9)), maybe(rng.randint(0, 5)), maybe("boom")) for k in range(400)]
    rng.shuffle(log)
    schema = "job_id bigint, seq bigint, type string, total_chunks int, n_det int, error string"
    spark.createDataFrame(log, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    want = Counter(map(str, stream.final_states(spark.read.parquet(f"{tmp_path}/log")).collect()))
    for k, forget in enumerate((False, True)):
        live = stream.job_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), forget=forget)
        assert Counter(map(str, stream.run_once(live, "update", f"{tmp_path}/c{k}").collect())) == want and len(want) == 6


def test_guards_stamps_and_ids(spark):
    uploads = spark.createDataFrame([("a", "ready"), ("b", "uploading")], "upload_id string, status string")
    got = jobs.start_status(spark.createDataFrame([("a",), ("b",), ("c",)], "upload_id string"), uploads).collect()
    assert {r.upload_id: r.http_status for r in got} == {"a": 200, "b": 400, "c": 404}
    r = jobs.with_id(jobs.stamped(uploads)).collect()
    assert r[0].job_id != r[1].job_id and abs(r[0].updated_at - time.time()) < 600
    loss = classify.mean_loss(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None)], "epoch int, loss double")).collect()
    assert {r.epoch: (r.steps, r.loss) for r in loss} == {1: (2, 3.0), 2: (0, None)}
    b = spark.createDataFrame([(None,), ([[0.0, 0.0], [2.0, 2.0]],)], "b array<array<double>>")
    assert [r[0] for r in b.select(geo.map_zoom(F.col("b"))).collect()] == [5, 14]
    assert b.limit(1).select(classify.map_colour(F.lit("boat")), classify.map_colour(F.lit("road"))).first()[:] == ("#FFFFFF", "#4488FF")


def test_messages_are_forwarded(spark, tmp_path):
    """Each message reaches the sender, under its batch's number."""
    spark.range(5).write.parquet(f"{tmp_path}/log")
    sent = []
    query = stream.forward(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/log"), lambda batch, n: sent.extend((n, r.id) for r in batch.collect()), f"{tmp_path}/c", 1)
    query.processAllAvailable()
    query.stop()
    assert sorted(i for _, i in sent) == list(range(5))


def test_frames(spark):
    lines = spark.createDataFrame([('{"type":"ping"}',), ("nonsense",), ('{"job_id":1}',), (None,)], "value string")
    assert [r.type for r in stream.parse(lines, "type string, job_id int").collect()] == ["ping"]


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32"])
def test_geotiff(spark, tmp_path, dtype, deflate):
    pixels = (np.arange(3 * 50 * 40).reshape(3, 50, 40) % 251).astype(dtype)
    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "a.TIF").write_bytes(geotiff.encode(pixels, (0.5, 0, 1000.0, 0, -0.5, 2000.0), 32644, deflate))
    (tmp_path / "bad.tif").write_bytes(b"II*\0junk")
    files = geotiff.read_files(spark, str(tmp_path))
    heads = {r.path.rpartition("/")[2]: r for r in geotiff.headers(files).collect()}
    a = heads["a.TIF"]
    assert (a.width, a.height, a.bands, a.dtype, a.crs, a.transform, tuple(a.bounds)) == (40, 50, 3, dtype, "EPSG:32644", [0.5, 0, 1000, 0, -0.5, 2000], (1000, 1975, 1020, 2000)) and heads["bad.tif"].error
    got = {r.chunk_id: r for r in geotiff.chunks(files, 32, 4).collect()}
    assert set(got) == {"0_0", "0_1", "1_0", "1_1", None} and got[None].error and got[None].path.endswith("bad.tif") and got["1_1"].geo_transform == [1014.0, 0.5, 0.0, 1986.0, 0.0, -0.5]
    assert np.array_equal(np.array(got["1_1"].pixels).reshape(3, 22, 12), pixels[:, 28:50, 28:40].astype(np.float32))


def test_tiff_tiles():
    """A tiled, planar file of two bands, big-endian."""
    data, at, places, sizes = b"MM\0*\0\0\0\0", 8, [], []
    bands = np.arange(2 * 20 * 20, dtype=">u2").reshape(2, 20, 20)
    for band in bands:
        for y in (0, 16):
            for x in (0, 16):
                tile = np.zeros((16, 16), ">u2")
                part = band[y : y + 16, x : x + 16]
                tile[: part.shape[0], : part.shape[1]] = part
                places.append(len(data))
                sizes.append(512)
                data += tile.tobytes()
    entry = lambda tag, kind, values: (tag, kind, values)
    fields = [entry(256, 3, [20]), entry(257, 3, [20]), entry(258, 3, [16, 16]), entry(259, 3, [1]), entry(277, 3, [2]), entry(284, 3, [2]), entry(322, 3, [16]), entry(323, 3, [16]), entry(324, 4, places), entry(325, 4, sizes)]
    start, tail, body = len(data), b"", struct.pack(">H", len(fields))
    end = start + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            tail, raw = tail + raw, struct.pack(">I", end + len(tail))
        body += struct.pack(">HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    data = data[:4] + struct.pack(">I", start) + data[8:] + body + b"\0\0\0\0" + tail
    tiff = geotiff.Tiff(geotiff.opened("", data))
    assert np.array_equal(tiff.read(), bands) and np.array_equal(tiff.read(10, 3, 8, 15), bands[:, 10:18, 3:18]) and tiff.crs is None
    del at


def pack_lzw(data):
    """TIFF's LZW, the plain way."""
    table, codes, word, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    free = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = free
        free, word = free + 1, c
        width = 9 + (free > 511) + (free > 1023) + (free > 2047)
        if free == 4094:
            codes.append((256, width))
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
    codes += [(table[word], width)] if word else []
    free += 1
    codes.append((257, 9 + (free > 511) + (free > 1023) + (free > 2047)))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("compression", "pack"), [(1, bytes), (5, pack_lzw), (8, zlib.compress), (32773, lambda d: b"".join(bytes([len(d[i : i + 128]) - 1]) + d[i : i + 128] for i in range(0, len(d), 128)))])
def test_tiff_strips(tmp_path, big, compression, pack):
    """Strips of TIFF and BigTIFF under each compression, read by ranges of a file."""
    rng = np.random.default_rng(4)
    pixels = np.where(rng.random((90, 70)) < 0.5, 7, rng.integers(0, 4000, (90, 70))).astype("<u2")
    strips = [pack(pixels[k : k + 20].tobytes()) for k in range(0, 90, 20)]
    data = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0)
    places = []
    for strip in strips:
        places.append(len(data))
        data += strip
    fields = [(256, [70]), (257, [90]), (258, [16]), (259, [compression]), (273, places), (277, [1]), (278, [20]), (279, [len(x) for x in strips])]
    form, count, size, start = ("Q", 16, 8, len(data)) if big else ("I", 4, 4, len(data))
    end = start + (8 + 20 * len(fields) + 8 if big else 2 + 12 * len(fields) + 4)
    body, tail = struct.pack("<Q" if big else "<H", len(fields)), b""
    for tag, values in fields:
        raw = struct.pack(f"<{len(values)}{form}", *values)
        if len(raw) > size:
            tail, raw = tail + raw, struct.pack("<" + form, end + len(tail))
        body += struct.pack("<HH" + form, tag, count, len(values)) + raw.ljust(size, b"\0")
    at = 8 if big else 4
    data = data[:at] + struct.pack("<" + form, start) + data[at + size :] + body + struct.pack("<" + form, 0) + tail
    (tmp_path / "x y.tif").write_bytes(data)
    tiff = geotiff.Tiff(geotiff.opened(f"file:{tmp_path}/x%20y.tif", None))
    assert np.array_equal(tiff.read()[0], pixels) and np.array_equal(tiff.read(15, 9, 50, 33)[0], pixels[15:65, 9:42])


def test_squares_and_back(spark):
    """Bytes to 0..1, three bands, resized; a flat band stays flat on the way there and back."""
    cells = spark.createDataFrame([("i", b, r, c, 51 * b) for b in range(4) for r in range(6) for c in range(4)], "image_id string, band int, r int, c int, v int")
    there = raster.square(cells, 6, 4, 8)
    got = there.groupBy("band").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    assert {r.band: r.n for r in got} == {0: 64, 1: 64, 2: 64} and all(r.low == pytest.approx(0.2 * r.band) and r.high == pytest.approx(0.2 * r.band) for r in got)
    back = raster.unsquare(there, 6, 4, 8).collect()
    assert len(back) == 72 and all(r.v == pytest.approx(0.2 * r.band) for r in back)


def test_geojson_files(spark, tmp_path):
    """A line for each job, without spaces, features in order."""
    found = spark.createDataFrame([(1, 2, "road", 0.5, "0_0", "#4488FF", 7, "EPSG:32644", [[0.0, 0.0]] * 5), (1, 1, "water", 0.25, "0_1", "#00BBFF", 9, "EPSG:32644", [[1.0, 1.0]] * 5)], "job_id int, seq int, feature_type string, confidence double, chunk_id string, colour string, area_px int, crs string, geo_polygon array<array<double>>")
    jobs_of = spark.createDataFrame([(1, "EPSG:32644"), (2, None)], "job_id int, crs string")
    images.write_geojson(detect.feature_collections(jobs_of, found), f"{tmp_path}/out")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    docs = {d["name"]: d for d in map(json.loads, lines)}
    assert [f["properties"]["area_px"] for f in docs["detections_1"]["features"]] == [9, 7] and docs["detections_2"]["features"] == [] and docs["detections_2"]["crs"]["properties"]["name"] == "EPSG:4326"
    assert docs["detections_1"]["type"] == "FeatureCollection" and all(json.dumps(json.loads(x), separators=(",", ":")) == x for x in lines)


def test_whole_images_as_pictures(spark, tmp_path):
    pixels = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(4, 2, 3)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(pixels))
    (tmp_path / "b.tif").write_bytes(b"no image")
    got = {r.path[-5:]: r for r in geotiff.rgb(geotiff.read_files(spark, str(tmp_path))).collect()}
    data = bytes(got["a.tif"].png)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 :])
    assert (got["a.tif"].width, got["a.tif"].height) == (3, 2) and raw[1:10] == pixels[:3, 0].T.tobytes() and got["b.tif"].error


def test_shapes_and_layers(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    hole = [(3.0, 1.0), (3.0, 2.0), (3.5, 2.0), (3.0, 1.0)]
    for k, name in enumerate(tiles.layer_files("PB")):
        (tmp_path / name).write_bytes(vectors.encode_shapes([[ring, hole]] * k + [None]))
        if k < 3:
            (tmp_path / name.replace(".shp", ".prj")).write_text(['GEOGCS["GCS_WGS_1984"]', 'PROJCS["WGS_1984_UTM_Zone_44N",GEOGCS["x"]]', 'PROJCS["WGS 84 / UTM zone 43S",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32743"]]'][k])
    rows = vectors.load_layers(spark, str(tmp_path), "PB")
    got = rows.groupBy("layer_val", "crs").agg(F.countDistinct("geom_id").alias("n"), F.count("*").alias("rings")).collect()
    assert {(r.layer_val, r.crs, r.n, r.rings) for r in got} == {(2, "EPSG:32644", 1, 2), (3, "EPSG:32743", 2, 4), (4, "EPSG:4326", 3, 6)}
    assert rows.where("part = 1").first().ring == [list(p) for p in hole] and {r.region for r in rows.collect()} == {"PB"}


def test_holes_and_slants(spark):
    """A square with a hole, and random polygons against the parity rule for every pixel."""
    rng = random.Random(5)
    square, hole = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[3.0, 3.0], [3.0, 7.0], [7.0, 7.0], [7.0, 3.0], [3.0, 3.0]]
    shapes = {("i", 0): [square, hole]}
    for g in range(1, 6):
        points = [[rng.uniform(-5, 35), rng.uniform(-5, 25)] for _ in range(rng.randint(3, 8))]
        shapes["jk"[g % 2], g] = [points + points[:1]]
    rings = [(i, g, 1 + g % 4, r) for (i, g), rs in shapes.items() for r in rs] + [("i", 9, 1, None), ("i", 9, 1, square[:2])]
    where = spark.createDataFrame([("i", 12, 12), ("j", 20, 30), ("k", 20, 30)], "image_id string, height int, width int")
    got = {(r.image_id, r.r, r.c): r.layer_val for r in tiles.rasterise(spark.createDataFrame(rings, "image_id string, geom_id int, layer_val int, ring array<array<double>>"), where).collect()}
    assert sum(k[0] == "i" for k in got) == 84

    def inside(x, y, rs):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rs for a, b in zip(r, r[1:])) % 2

    want = {}
    for (i, g), rs in shapes.items():
        for r in range(12 if i == "i" else 20):
            for c in range(12 if i == "i" else 30):
                if inside(c + 0.5, r + 0.5, rs):
                    want[i, r, c] = max(want.get((i, r, c), 0), 1 + g % 4)
    assert got == want


def test_layers_are_reprojected(spark):
    """A ring in degrees and one in metres of the same place fall on the same pixels."""
    ring = [[500_010.0, 2_299_990.0], [500_020.0, 2_299_990.0], [500_020.0, 2_299_980.0], [500_010.0, 2_299_990.0]]
    metres = spark.createDataFrame([(ring,)], "ring array<array<double>>")
    there = metres.select(F.transform("ring", lambda p: geo.to_wgs84(p[0], p[1], F.lit("EPSG:32644"))).alias("t")).select(F.transform("t", lambda t: F.array(t["lng"], t["lat"])).alias("ring")).first().ring
    layers = spark.createDataFrame([("PB", 1, 1, ring, "EPSG:32644"), ("PB", 2, 2, there, "EPSG:4326"), ("CG", 3, 3, ring, "EPSG:32644"), ("PB", 4, 4, [[0.0, 0.0]] * 4, "EPSG:32644")], "region string, geom_id int, layer_val int, ring array<array<double>>, crs string")
    where = spark.createDataFrame([("i", "/x/PB/i.tif", "EPSG:32644", [500_000.0, 0.5, 0.0, 2_300_000.0, 0.0, -0.5], 100, 100)], "image_id string, path string, crs string, transform array<double>, height int, width int")
    got = {r.geom_id: r.ring for r in tiles.to_pixels(layers, where).collect()}
    assert got.keys() == {1, 2} and got[1][0] == [20.0, 20.0] and np.allclose(got[1], got[2], atol=1e-4)


def test_zip(spark, tmp_path):
    for name in ("a.zip", "b.ZIP"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x/y.txt", "hello")
            z.writestr("x/", "")
    got = archives.read_archives(spark, str(tmp_path)).collect()
    assert [(r.archive.rpartition("/")[2], r.member, bytes(r.content)) for r in got] == [("a.zip", "x/y.txt", b"hello")]
    (tmp_path / "c.zip").write_bytes(b"PK broken")
    damaged = bytearray((tmp_path / "a.zip").read_bytes())
    damaged[damaged.index(b"hello")] ^= 1
    (tmp_path / "d.zip").write_bytes(damaged)
    errors = {r.archive.rpartition("/")[2]: r.error for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert errors["a.zip"] is None and errors["c.zip"] and errors["d.zip"]


def test_png(spark):
    mask = spark.createDataFrame([("i", 0, 0, 1), ("i", 1, 2, 9)], "image_id string, r int, c int, class_id int")
    r = images.mask_images(mask).first()
    data = bytes(r.png)
    assert (r.width, r.height) == (3, 2) and data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert raw[1:4] == bytes((255, 0, 0)) and raw[10 + 1 + 6 : 10 + 1 + 9] == bytes((255, 255, 0)) and io


def test_all_queries_are_registered():
    assert len(plans.QUERIES) >= 45 and set(plans.ORACLES) == set(plans.QUERIES)


def test_resizing_makes_no_grid_to_send_around(spark, tmp_path):
    """Pixels with gaps, against NumPy; no join, as the one with a grid of all targets was sent to the driver whole."""
    rng = np.random.default_rng(5)
    for (h, w), (th, tw) in (((7, 5), (14, 10)), ((7, 5), (3, 4)), ((1, 6), (5, 1)), ((9, 4), (10, 3))):
        grid = np.where(rng.random((h, w)) < 0.2, np.nan, rng.normal(size=(h, w)))
        rows = [("a", r, c, float(v)) for (r, c), v in np.ndenumerate(grid) if not np.isnan(v)]
        pixels = spark.createDataFrame([*rows, ("a", None, 1, 5.0), (None, 0, 0, 5.0)], "image_id string, r int, c int, v double")
        want, near = {}, {}
        for r in range(th):
            for c in range(tw):
                at = [max(0.0, (t + 0.5) * (d / to) - 0.5) for t, d, to in ((r, h, th), (c, w, tw))]
                ends = [[(k := min(int(x), d - 1), 1 - (x - k)), (min(k + 1, d - 1), x - k)] for x, d in zip(at, (h, w))]
                taps = [grid[y, x] * p * q for y, p in ends[0] for x, q in ends[1] if p * q > 0 and not np.isnan(grid[y, x])]
                if taps:
                    want[r, c] = sum(taps)
                if not np.isnan(v := grid[r * h // th, c * w // tw]):
                    near[r, c] = v
        found, picked = raster.resize_bilinear(pixels, h, w, th, tw), raster.resize_nearest(pixels, h, w, th, tw)
        got = {(x.tr, x.tc): x.v for x in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert {(x.tr, x.tc): x.v for x in picked.collect()} == near
        for df in (found, picked):
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
