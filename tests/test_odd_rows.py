"""Nulls in every column, repeats, ties, extra columns and empty tables, for the engine's operators."""

import pytest
from pyspark.sql import functions as F

from gridwright.operators import classify, detect, jobs, raster, tiles, upload
from gridwright.operators.label import label_components
from gridwright.plans import queries
from gridwright.sources import images


def test_patches_without_key_or_number(spark):
    schema = "job string, seq bigint, status string, value double, extra int"
    log = spark.createDataFrame([("a", 1, "x", None, 1), ("a", None, "lost", 9.0, 1), (None, 2, "y", 2.0, 1), (None, 3, None, None, 1), ("b", None, "z", 1.0, 1)], schema)
    got = {r.job: (r.status, r.value, r.seq) for r in jobs.fold_patches(log, "job", "seq", ["status", "value"]).collect()}
    assert got == {"a": ("x", None, 1), None: ("y", 2.0, 3), "b": (None, None, None)}
    last = {r.job: (r.seq, r.status) for r in jobs.latest(log, "job", "seq").collect()}
    assert last == {"a": (1, "x"), None: (3, None), "b": (None, None)}
    none = spark.createDataFrame([], schema)
    assert jobs.fold_patches(none, "job", "seq", ["status"]).count() == 0 and jobs.latest(none, "job", "seq").count() == 0


def test_requests_without_uploads(spark):
    uploads = spark.createDataFrame([("u", "ready", "p"), ("v", None, "q"), (None, "ready", "r")], "upload_id string, status string, tif_path string")
    asked = spark.createDataFrame([(1, "u"), (2, "v"), (3, None), (4, "w"), (None, "u")], "job_id int, upload_id string")
    assert {r.job_id: r.http_status for r in jobs.start_status(asked, uploads).collect()} == {1: 200, 2: 404, 3: 404, 4: 404, None: 200}
    assert {r.job_id for r in jobs.start_jobs(asked, uploads).collect()} == {1, None}
    assert {r.job_id for r in jobs.refused_jobs(asked, uploads).collect()} == {3, 4}
    assert jobs.start_status(asked.where("false"), uploads).count() == 0


def test_progress_counts_nulls_as_nothing(spark):
    log = spark.createDataFrame([("a", 1, 2, None), ("a", 2, 2, 3), (None, 1, None, 1)], "job_id string, seq int, total_chunks int, n_det int")
    assert {(r.job_id, r.seq): (r.chunks_done, r.detections_found, r.progress) for r in jobs.progress(log).collect()} == {("a", 1): (1, 0, 50.0), ("a", 2): (2, 3, 100.0), (None, 1): (1, 1, None)}


def test_parts_that_are_null(spark, tmp_path):
    files = spark.createDataFrame([("a", b"abc"), ("n", None), ("e", b"")], "key string, data binary")
    assert {r.key: r.n for r in upload.split_parts(files, "key", "data", 2).groupBy("key").agg(F.count("*").alias("n")).collect()} in ({"a": 2, "e": 1}, {"a": 2, "e": 1, "n": 1})
    parts = spark.createDataFrame([("a", 0, b"ab"), ("a", 1, None), (None, 0, b"x")], "key string, idx int, part binary")
    back = {r.key: (bytes(r.content or b""), r.received) for r in upload.reassemble(parts, "key").collect()}
    assert back == {"a": (b"ab", 2), None: (b"x", 1)}
    assert {(r.key, r.idx): r.length for r in upload.manifest(parts, "key", 2).collect()} == {("a", 0): 2, ("a", 1): None, (None, 0): 1}
    with pytest.raises(Exception, match="without content"):
        upload.place(parts.where("key = 'a'"), "key", str(tmp_path), size=2)


def test_upload_positions_of_odd_texts(spark, tmp_path):
    """Empty texts have empty files, null ones have none; each document has its row, as in SQL."""
    import duckdb

    rows = [(1, "abc"), (2, ""), (3, None), (-4, "minus"), (None, "no id"), (6, "é" * 50_000), (1006, "x" * 2048)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries.ORACLES["upload_positions"])
    got = queries.QUERIES["upload_positions"](spark, str(tmp_path))
    assert got.columns == want.columns and len(rows) == got.count()
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())


def test_classes_that_are_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, 6, [0.5, 0.9]), (3, 999, [])], "id int, class_id int, scores array<double>")
    got = {r.id: r for r in df.select("id", classify.argmax_class(F.col("scores")).alias("k"), classify.palette_colour(F.col("class_id")).alias("c"), classify.remap_mask(F.col("class_id")).alias("m"), classify.colour_of(F.lit(None).cast("string")).alias("d")).collect()}
    assert (got[1].k, got[1].c, got[1].m) == (None, None, None) and got[2].k == 1 and got[3].k is None and got[1].d == "#888888"
    assert [r.id for r in classify.map_classes(df).collect()] == [2]


def test_pixels_without_a_place(spark):
    rows = [("a", 0, 0), ("a", 0, 0), ("a", None, 1), ("a", 1, None), ("a", 1, 1), (None, 5, 5)]
    got = label_components(spark.createDataFrame(rows, "k string, y int, x int"), ["k"])
    assert {(r.k, r.area, r.x1, r.y2) for r in got.collect()} == {("a", 2, 0, 2), (None, 1, 5, 6)}
    assert label_components(spark.createDataFrame([], "k string, y int, x int"), ["k"]).count() == 0
    cells = spark.createDataFrame([("i", 0, 0, 1), ("i", None, 0, 1), ("i", 0, 1, None)], "image_id string, r int, c int, class_id int")
    assert [(r.width, r.height) for r in images.mask_images(cells).collect()] == [(2, 1)]
    assert raster.assign_windows(cells.withColumns({"height": F.lit(4), "width": F.lit(4)}), 4, 1).count() == 2
    where = spark.createDataFrame([("i", 4, 4)], "image_id string, height int, width int")
    labelled = cells.withColumn("layer_val", F.lit(1))
    assert [(r.ty, r.tx, r.labelled_px) for r in tiles.keep_tiles(labelled, where, 4, 2, 0.1).collect()] == [(0, 0, 2)]


def test_detections_without_polygons(spark):
    kinds = "seq int, job_id string, feature_type string, confidence double, chunk_id string, colour string, area_px int, crs string, geo_polygon array<array<double>>"
    ring = [[0.0, 0.0]] * 5
    found = spark.createDataFrame([(1, "a", None, None, None, None, None, None, ring), (2, "a", "road", 0.5, "0_0", "#4488FF", 9, "x", None), (None, "a", "road", 0.5, "0_0", "#4488FF", 9, "x", ring[:3]), (4, None, "road", 0.5, "0_0", "#4488FF", 9, "x", ring)], kinds)
    assert sorted(r.seq for r in detect.visible(found, {"road": False}).collect()) == [1] and sorted(r.seq for r in detect.visible(found, {}).collect()) == [1, 4]
    assert {r.feature_type: r.n for r in detect.count_by_type(found).collect()} == {"building": 0, "road": 3, "utility": 0, "vegetation": 0, "water": 0}
    jobs_of = spark.createDataFrame([("a", "x"), (None, None), ("b", None)], "job_id string, crs string")
    sizes = detect.feature_collections(jobs_of, found).select("job_id", F.json_array_length(F.get_json_object("geojson", "$.features")).alias("n")).collect()
    assert {r.job_id: r.n for r in sizes} == {"a": 1, None: 0, "b": 0}
