"""Data sources and sinks, span labelling, errors of rasters, and boxes that meet."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions import geo
from gridwright.operators import classify, detect, spatial, tiles
from gridwright.operators.label import label_pixels, label_spans
from gridwright.plans import queries as plans
from gridwright.sources import datasource, geotiff

SF = "/root/testdata/sf0.001"


def components(mask):
    """By pixels, class by class."""
    out = []
    for k in range(int(mask.max(initial=-1)) + 1):
        y, x = np.nonzero(mask == k)
        label = label_pixels(y, x) if len(y) else np.array([], int)
        out += [(k, c, int((label == c).sum()), *(int(v) for v in (x[label == c].min(), y[label == c].min(), x[label == c].max() + 1, y[label == c].max() + 1))) for c in range(int(label.max(initial=-1)) + 1)]
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_spans_give_the_components_of_pixels(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(40):
        h, w = rng.integers(1, 15, 2)
        mask = np.where(rng.random((h, w)) < share, rng.integers(0, 3, (h, w)), -1)
        found = label_spans(mask)
        assert list(zip(*(found[n].tolist() for n in ("kind", "component", "area", "x1", "y1", "x2", "y2")))) == components(mask)


def test_spans_of_one_row_and_of_a_spiral():
    spiral = np.array([[int(c) - 1 for c in line] for line in ("1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111")])
    found = label_spans(spiral)
    assert found["area"].tolist() == [int((spiral == 0).sum())] and found["x2"].tolist() == [7]
    assert label_spans(np.full((3, 3), -1))["area"].tolist() == [] and label_spans(np.zeros((1, 1), int))["area"].tolist() == [1]


def write(path, name, pixels, transform=(0.5, 0, 1000.0, 0, -0.5, 2000.0), **more):
    (path / name).parent.mkdir(parents=True, exist_ok=True)
    (path / name).write_bytes(geotiff.encode(pixels, transform, 32644, **more))


def test_reader_reads_the_blocks_of_its_filters_only(spark, tmp_path):
    pixels = np.arange(64 * 40, dtype=np.float32).reshape(1, 64, 40)
    for name in ("a/x.tif", "b/y.TIF"):
        write(tmp_path, name, pixels + len(name), rows=8)
    (tmp_path / "a" / "notes.txt").write_text("no raster")
    whole = datasource.read_rasters(spark, str(tmp_path), chunk=16, overlap=0)
    rows = whole.collect()
    assert len(rows) == 2 * 4 * 3 and sum(r.blocks_read for r in rows) == 2 * 8  # each block once, as it is kept for the next windows
    got = whole.where(f"path = '{tmp_path}/a/x.tif' and cr = 2 and c0 >= 16").collect()
    assert [(r.cr, r.cc) for r in got] == [(2, 1), (2, 2)] and sum(r.blocks_read for r in got) == 2
    assert np.array_equal(np.array(got[0].pixels).reshape(16, 16), (pixels + 7)[0, 32:48, 16:32])
    assert whole.where("cr > 100").count() == 0 and whole.where("cc in (0, 2) and r0 < 16 and w <= 8").count() == 2
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_reader_splits_large_files_and_gives_what_chunks_gives(spark, tmp_path):
    rng = np.random.default_rng(2)
    write(tmp_path, "a.tif", rng.integers(0, 255, (2, 150, 130)).astype(np.uint8), rows=10)
    (tmp_path / "broken.tif").write_bytes(b"II*\0junk")
    key = lambda r: (r.path.rpartition("/")[2], r.chunk_id or "", r.window, r.geo_transform, r.crs, r.total_chunks, r.pixels, r.error is None)
    want = sorted(map(key, geotiff.chunks(geotiff.read_files(spark, str(tmp_path)), 32, 4, ready=4).collect()), key=str)
    for share in (1 << 30, 5000, 500):
        read = datasource.read_rasters(spark, str(tmp_path), chunk=32, overlap=4, ready=4, share=share)
        assert sorted(map(key, read.collect()), key=str) == want and (share > 5000 or read.rdd.getNumPartitions() > 4)
    assert len(want) == 26 and sum(not w[-1] for w in want) == 1


def test_reader_on_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert datasource.read_rasters(spark, str(tmp_path / "none")).count() == 0


def test_predictor_of_floats_and_jpeg_blocks():
    """Bytes of floats in planes as differences; blocks of a compression whose decoder is given."""
    rng = np.random.default_rng(1)
    pixels = rng.normal(size=(2, 6, 9)).astype(np.float32)

    def rewritten(data, strip, tags):
        tiff = geotiff.Tiff(geotiff.opened("", data))
        tiff.tags |= tags
        tiff.get = lambda at, n: strip
        tiff.tags |= {273: (8,), 279: (len(strip),)}
        return tiff

    planes = pixels.transpose(1, 2, 0).reshape(6, -1).astype(">f4").view(np.uint8).reshape(6, 18, 4).transpose(0, 2, 1).reshape(6, -1, 2)
    diff = planes.copy()
    diff[:, 1:] = planes[:, 1:] - planes[:, :-1]
    tiff = rewritten(geotiff.encode(pixels), zlib.compress(diff.tobytes()), {259: (8,), 317: (3,)})
    assert np.array_equal(tiff.read(), pixels) and np.array_equal(tiff.read(2, 1, 3, 4), pixels[:, 2:5, 1:5])
    grey = rng.integers(0, 255, (1, 6, 9)).astype(np.uint8)
    jpeg = rewritten(geotiff.encode(grey), b"jpeg", {259: (7,), 347: tuple(b"tables")})
    with pytest.raises(ValueError, match="compression 7"):
        jpeg.read()
    jpeg.decoders = {7: lambda data, tables: grey[0] if (data, tables) == (b"jpeg", b"tables") else None}
    assert np.array_equal(jpeg.read(), grey)


def test_kept_blocks_are_bounded():
    tiff = geotiff.Tiff(geotiff.opened("", geotiff.encode(np.zeros((1, 64, 32), np.uint8), rows=4)), keep=300)
    for _ in range(2):
        tiff.read()
    assert tiff.decoded == 32 and tiff.kept <= 300 and len(tiff.blocks) == 2


def test_turned_images_keep_their_transform(spark, tmp_path):
    turned = (0.5, 0.1, 100.0, 0.2, -0.5, 200.0)
    write(tmp_path, "t.tif", np.arange(64, dtype=np.uint8).reshape(1, 8, 8), turned)
    files = geotiff.read_files(spark, str(tmp_path))
    assert geotiff.headers(files).first().transform == list(turned)
    windows = geotiff.headers(files).select("path", F.lit(2).alias("r0"), F.lit(3).alias("c0"), F.lit(4).alias("h"), F.lit(4).alias("w"))
    piece = geotiff.Tiff(geotiff.opened("", bytes(geotiff.cut(files, windows).first().content)))
    assert np.allclose(piece.transform, [0.5, 0.1, 100 + 1.5 + 0.2, 0.2, -0.5, 200 + 0.6 - 1.0]) and piece.read()[0, 0, 0] == 19
    up = (0.5, 0.0, 1.0, 0.0, 0.5, 2.0)  # rows from south to north
    assert geotiff.Tiff(geotiff.opened("", geotiff.encode(np.zeros((1, 2, 2), np.uint8), up))).transform == list(up)


def test_windows_that_cant_be_cut_say_why(spark, tmp_path):
    write(tmp_path, "a.tif", np.zeros((1, 8, 8), np.uint8))
    (tmp_path / "b.tif").write_bytes(b"something else")
    files = geotiff.read_files(spark, str(tmp_path))
    windows = files.select("path", *[F.lit(v).alias(k) for k, v in (("r0", 0), ("c0", 0), ("h", 4), ("w", 4))])
    got = {r.path.rpartition("/")[2]: r for r in geotiff.cut(files, windows).collect()}
    assert got["a.tif"].error is None and got["b.tif"].content is None and "not a TIFF" in got["b.tif"].error


def test_models_that_fail_leave_a_row(spark, tmp_path):
    grid = np.zeros((1, 40, 70), np.float32)
    grid[0, 2:12, 3:20], grid[0, 30:39, 50:69] = 1, 2
    for name, factor in (("a.tif", 1), ("b.tif", 3), ("d.tif", 5)):
        write(tmp_path, name, grid * factor)
    (tmp_path / "c.tif").write_bytes(b"II*\0junk")

    def load():
        def model(bands):
            if bands.max() == 6:
                raise MemoryError("no room")
            return np.zeros((2, 2)) if bands.max() == 10 else np.select([bands[0] == 1, bands[0] == 2], [1, 6], 99)

        return model

    objects = classify.score_objects(datasource.read_rasters(spark, str(tmp_path), chunk=64, overlap=4), load)
    found = detect.detect_objects(objects, 20, 0.0)
    assert sorted((r.path[-5:], r.chunk_id, r.feature_type, r.area_px) for r in found.collect()) == [("a.tif", "0_0", "building", 170), ("a.tif", "0_0", "road", 171), ("a.tif", "0_1", "road", 81)]
    failed = sorted((r.path[-5:], r.chunk_id or "", r.error.split(":")[0]) for r in classify.failed_chunks(objects).collect())
    assert [f[:2] for f in failed] == [("b.tif", "0_0"), ("b.tif", "0_1"), ("c.tif", ""), ("d.tif", "0_0"), ("d.tif", "0_1")] and failed[0][2] == "MemoryError" and failed[3][2] == "ValueError"
    same = detect.detect_scored(classify.score_chunks(geotiff.chunks(geotiff.read_files(spark, str(tmp_path)), 64, 4), lambda: lambda b: np.select([b[0] == 1, b[0] == 2], [1, 6], 99)), 20, 0.0)
    assert Counter((r.chunk_id, r.feature_type, tuple(r.pixel_bbox)) for r in same.collect()) >= Counter((r.chunk_id, r.feature_type, tuple(r.pixel_bbox)) for r in found.collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_writer_places_all_files_or_none(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("sub/"), F.col("id").cast("string"), F.lit(".bin")).alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    folder = str(tmp_path / "out")
    datasource.write_rows(rows.repartition(3), folder)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out" / "sub").iterdir()} == {f"{k}.bin": str(k).encode() for k in range(20)}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["sub"]
    bad = rows.select(F.concat(F.lit("new"), "path").alias("path"), F.when(F.col("path") != "sub/7.bin", F.col("content")).alias("content"))
    with pytest.raises(Exception, match="no content"):
        datasource.write_rows(bad, folder)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["sub"] and len(list((tmp_path / "out" / "sub").iterdir())) == 20
    datasource.write_rows(rows.limit(1).withColumn("content", F.lit(b"later")), folder)  # a file of the same name is replaced
    assert (tmp_path / "out" / "sub" / "0.bin").read_bytes() == b"later"
    datasource.register(spark)
    rows.limit(2).write.format(datasource.WRITER).mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "out" / "sub").iterdir()) == ["0.bin", "1.bin"] and len(list((tmp_path / "out").iterdir())) == 1


def boxes(rng, n, name, sizes):
    out = []
    for k in range(n):
        x, y, size = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice(sizes)
        out.append((k, rng.choice("ab"), x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)))
    return out, f"{name} int, kind string, bx0 double, by0 double, bx1 double, by1 double"


def test_boxes_meet_as_by_brute_force(spark):
    rng = random.Random(3)
    for small, large in (([1, 20], [1, 20]), ([0.01, 5, 300], [2, 900]), ([700], [0.5]), ([0], [64, 128])):
        (a, ka), (b, kb) = boxes(rng, 150, "i", small), boxes(rng, 120, "j", large)
        a += [(900, "a", -64.0, -64.0, 0.0, 0.0), (901, "a", 0.0, 0.0, 64.0, 64.0), (902, None, 0.0, 0.0, 1.0, 1.0), (903, "a", float("nan"), 0.0, 1.0, 1.0)]
        b += [(900, "a", 0.0, 0.0, 64.0, 64.0), (901, "a", None, 0.0, 1.0, 1.0)]
        got = Counter((r.i, r.j) for r in spatial.meeting(spark.createDataFrame(a, ka), spark.createDataFrame(b, kb), ["kind"]).collect())
        want = Counter((i, j) for i, k, x0, y0, x1, y1 in a for j, m, u0, v0, u1, v1 in b if k == m and k and x0 == x0 and u0 is not None and x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1)
        assert got == want and want[900, 900] == 1


def test_no_boxes_meet_on_empty_tables(spark):
    rows, kind = boxes(random.Random(1), 3, "i", [5])
    one, none = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind.replace("i int", "j int"))
    assert spatial.meeting(one, none, ["kind"]).count() == 0


def test_far_boxes_share_no_cells(spark):
    """Boxes along a diagonal, each near one other: candidates grow with the boxes, not with their square."""
    n = 3000
    line = spark.range(n).select((F.col("id") * 10.0).alias("bx0"), (F.col("id") * 10.0).alias("by0"), (F.col("id") * 10.0 + 4).alias("bx1"), (F.col("id") * 10.0 + 4).alias("by1"), F.lit("a").alias("kind"), F.col("id").alias("i"))
    cells = spatial._spread(spatial.with_level(line), 0, [2, 9], same=True)
    assert cells.count() < 8 * n
    a, b = spatial._spread(spatial.with_level(line), 0, [2], same=True), spatial._spread(spatial.with_level(line), 1, [2], same=False)
    assert a.select("i", "side", "at", "cx", "cy").join(b.select(F.col("i").alias("j"), "side", "at", "cx", "cy"), ["side", "at", "cx", "cy"]).count() < 20 * n
    assert spatial.meeting(line, line.withColumnRenamed("i", "j"), ["kind"]).count() == n


def test_layers_without_a_place(spark):
    ring = [[10.0, -10.0], [20.0, -10.0], [20.0, -20.0], [10.0, -10.0]]
    layers = spark.createDataFrame([("PB", 1, 1, ring, None), ("PB", 2, 2, None, "EPSG:4326"), ("PB", 3, 3, [[float("nan"), 0.0]] * 4, None), ("PB", 1, 1, ring, None)], "region string, geom_id int, layer_val int, ring array<array<double>>, crs string")
    kind = "image_id string, path string, crs string, transform array<double>, height int, width int"
    where = spark.createDataFrame([("i", "/PB/i.tif", None, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], 50, 50), ("j", "/PB/j.tif", None, None, 50, 50)], kind)
    assert Counter((r.image_id, r.geom_id) for r in tiles.to_pixels(layers, where).collect()) == {("i", 1): 2}
    assert tiles.to_pixels(layers, spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("lot", [7, 10_000])
def test_equal_images_and_layers_are_placed_once(spark, monkeypatch, lot):
    """30 copies of a ring and 40 of an image meet as one pair, and each pair of copies has its row; a turned image and another system are apart."""
    ring, far = [[10.0, -10.0], [20.0, -10.0], [20.0, -20.0], [10.0, -10.0]], [[900.0, -10.0], [920.0, -10.0], [920.0, -20.0], [900.0, -10.0]]
    rows = [("PB", k % 4, k, ring, None if k % 2 else "EPSG:4326") for k in range(30)] + [("PB", 1, 5, ring, None), ("CG", 1, 50, ring, None), ("PB", 1, 51, far, None), ("PB", 1, 52, ring[1:] + ring[1:2], None)]
    layers = spark.createDataFrame(rows, "region string, layer_val int, geom_id int, ring array<array<double>>, crs string")
    straight, turned = [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [0.0, 0.0, 1.0, 0.0, -1.0, 0.0]
    shots = [(k, "/PB/a.tif", "EPSG:4326", straight, 50, 50) for k in range(40)] + [(3, "/PB/again.tif", None, straight, 50, 50), (40, "/PB/t.tif", None, turned, 50, 50), (41, "/CG/a.tif", None, straight, 50, 50)]
    images = spark.createDataFrame(shots, "image_id int, path string, crs string, transform array<double>, height int, width int")
    met = []

    def meet(left, right, by):
        met.append((left.count(), right.count()))
        return spatial.meeting(left, right, by)

    monkeypatch.setattr(tiles, "meeting", meet)
    monkeypatch.setattr(tiles, "LOT", lot)
    got = Counter((r.image_id, r.geom_id, r.layer_val, tuple(map(tuple, r.ring))) for r in tiles.to_pixels(layers, images).collect())
    place = lambda p, turn: (-p[1], p[0]) if turn else (p[0], -p[1])
    want = Counter((i, g, v, tuple(place(p, t is turned) for p in r)) for i, path, _, t, _, _ in shots for region, v, g, r, _ in rows if region in path and r is not far)
    assert got == want and sum(want.values()) == 42 * 32 + 1
    assert met == [(4, 3)]


def test_plan_of_layers_has_no_nested_loop(spark):
    plan = plans.layers_on_mosaics(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rings_move_as_points_do(spark):
    """The vectorised way agrees with the column expressions in every pair of systems."""
    codes = ["EPSG:4326", "EPSG:3857", "EPSG:32643", "EPSG:32645", "EPSG:32744", "EPSG:9999", None]
    rng = random.Random(9)
    rows = []
    for a in codes:
        for b in codes:
            lng, lat = rng.uniform(70, 90), rng.uniform(-60, 60)
            rows.append((a, b, [[lng + k, lat + k / 2] for k in range(3)]))
    df = spark.createDataFrame(rows, "a string, b string, degrees array<array<double>>")
    place = lambda p, crs: geo.reproject(p[0], p[1], F.lit("EPSG:4326"), crs)
    df = df.withColumn("ring", F.transform(F.transform("degrees", lambda p: place(p, F.col("a"))), lambda p: F.array(p["x"], p["y"]))).withColumn("k", F.monotonically_increasing_id())
    want = {r.k: r.r for r in df.select("k", F.transform("ring", lambda p: geo.reproject(p[0], p[1], F.col("a"), F.col("b"))).alias("r")).collect()}
    coded = df.select("k", "ring", geo.code_of(F.col("a")).alias("c"), geo.code_of(F.col("b")).alias("t"), (geo.normalise_crs(F.col("a")) == geo.normalise_crs(F.col("b"))).alias("s"))
    got = {r.k: r.ring for r in geo.move_rings(coded, "ring", "c", "t", "s").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-6) for k in got)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [[None, 1.0]]), (4, [[1.0, 95.0]])], "k int, ring array<array<double>>").withColumns({"c": F.lit(4326), "t": F.lit(32644), "s": F.lit(False)})
    found = {r.k: r.ring for r in geo.move_rings(odd, "ring", "c", "t", "s").collect()}
    assert found[1] is None and found[2] == [] and np.isnan(found[3]).any()


def _agrees(spark, tables, name):
    import duckdb

    db = duckdb.connect()
    for table in ("embeddings", "supplier"):
        db.sql(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, str(tables))
    want = db.sql(f"select {', '.join(got.columns)} from ({plans.ORACLES[name]})").fetchall()
    return len(want) > 0 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["file_detections", "raster_windows", "tile_pairs"])
def test_pixels_that_no_vector_gives_are_without_data(spark, tmp_path, name):
    """The last row of patches is half full: zeros there were taken for pixels."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(scale=0.1, size=64)]) for k in range(330)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1, 60).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert _agrees(spark, tmp_path, name)


@pytest.mark.parametrize(("height", "rows", "positions"), [(5, 5, True), (5, 5, False), (9, 4, True), (23, 2, False), (4100, 2, True)])
def test_rasters_are_written_strip_by_strip(spark, tmp_path, monkeypatch, height, rows, positions):
    monkeypatch.setattr(datasource, "has_positions", lambda folder: positions)
    image = np.random.default_rng(height).normal(size=(2, height, 3)).astype(np.float32)
    image[0, 1, 1] = np.nan
    place = (0.5, 0.0, 10.0, 0.0, -0.5, 20.0)
    strips = [(k, geotiff.pack_strip(image[:, k * rows : (k + 1) * rows], True)) for k in range(-(-height // rows))]
    header = {"bands": 2, "height": height, "width": 3, "dtype": image.dtype, "rows": rows, "transform": place, "epsg": 32644, "deflate": True, "nodata": np.nan}
    datasource.write_strips(spark.createDataFrame(strips[::-1], "k int, data binary").repartition(3), f"file://{tmp_path}/out", "a/b.tif", len(strips), **header)
    with geotiff.opened(f"{tmp_path}/out/a/b.tif") as get:
        tiff = geotiff.Tiff(get)
        assert np.array_equal(tiff.read(), image, equal_nan=True) and tiff.transform == list(place) and tiff.crs == "EPSG:32644" and np.isnan(tiff.nodata)
    with pytest.raises(ValueError, match="strips of"):
        datasource.write_strips(spark.createDataFrame(strips[:1], "k int, data binary"), f"file://{tmp_path}/none", "b.tif", len(strips) + 1, **header)


@pytest.mark.parametrize("strips", [1, 2, 3, 700])
def test_headers_of_files_beyond_4_gb(strips):
    header = {"bands": 1, "height": strips * 2, "width": 2, "dtype": np.dtype("uint16"), "rows": 2, "transform": None, "epsg": 3857, "deflate": False, "nodata": 7}
    parts, places, sizes, first = geotiff.leading_header(strips, True, **header)
    file = bytearray(first + 8 * strips)
    for at, part in parts:
        file[at : at + len(part)] = part
    image = np.arange(strips * 4, dtype=np.uint16).reshape(1, strips * 2, 2)
    for k in range(strips):
        for at, n in ((places, first + 8 * k), (sizes, 8)):
            file[at + 8 * k : at + 8 * k + 8] = n.to_bytes(8, "little")
        file[first + 8 * k : first + 8 * k + 8] = geotiff.pack_strip(image[:, 2 * k : 2 * k + 2])
    tiff = geotiff.Tiff(lambda at, n: bytes(file[at : at + n]))
    assert np.array_equal(tiff.read(), image) and tiff.nodata == 7 and tiff.crs == "EPSG:3857"
    assert np.array_equal(np.isnan(tiff.masked(image)), image == 7)


def test_bands_without_data_are_scaled_by_the_rest():
    band = np.array([[[2, np.nan], [4, 3]]], np.float32)
    assert np.array_equal(geotiff.ready_bands(band, 1, masked=True), [[[0, np.nan], [1, 0.5]]], equal_nan=True) and not geotiff.ready_bands(band, 1).any()
