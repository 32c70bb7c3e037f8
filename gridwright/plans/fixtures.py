"""Rasters, detections and messages derived from the test tables: as DataFrames and as SQL."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..sources.geotiff import encode, pack_strip
from ..sources.datasource import write_rows, write_strips
from ..sources.scratch import scratch_dir

CHUNK, OVERLAP, MIN_AREA = 32, 4, 8
IMAGE = "mosaic"
#: Half a metre a pixel, north up.
TRANSFORM = (500_000.0, 0.5, 0.0, 2_300_000.0, 0.0, -0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Height and width of the raster, as its header would say."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // 20 + 1) * 8, 160


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, c, v, height, width): each vector is a patch of 8 x 8, twenty patches in a row."""
    vectors, (height, _) = table(spark, sf_dir, "embeddings"), size(spark, sf_dir)
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    r, c = F.floor(F.col("vec_id") / 20) * 8 + F.floor(F.col("i") / 8), F.col("vec_id") % 20 * 8 + F.col("i") % 8
    return cells.select(F.lit(IMAGE).alias("image_id"), r.cast("int").alias("r"), c.cast("int").alias("c"), F.col("v").cast("double").alias("v"), F.lit(height).cast("int").alias("height"), F.lit(160).alias("width"))


def label_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel with the class that a model would give."""
    v = F.col("v")
    k = F.when(v < -0.13, 1).when(v < -0.065, 6).when(v < -0.016, 83).when(v < 0.03, 4).when(v < 0.083, 21).otherwise(0)
    return pixel(spark, sf_dir).withColumn("class_id", k).drop("v")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(IMAGE, *size(spark, sf_dir))], "image_id string, height int, width int")


def raster_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the raster as a GeoTIFF in UTM zone 44, one float band in strips of eight rows; pixels that no vector gives are without data (NaN). A task holds a strip."""
    height, width = size(spark, sf_dir)

    def run(patches: pa.Table) -> pa.Table:
        grid = np.full((1, 8, width), np.nan, np.float32)
        for at, values in zip(patches["vec_id"].to_pylist(), patches["embedding"].to_pylist()):
            if values is not None:
                grid[0, :, at % 20 * 8 : at % 20 * 8 + 8] = np.array(values, np.float32).reshape(8, 8)
        return pa.table({"k": patches["k"].slice(0, 1), "data": pa.array([pack_strip(grid, deflate=True)], pa.binary())})

    folder = scratch_dir(spark)
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.floor(F.col("vec_id") / 20).alias("k"), "vec_id", "embedding")
    every = spark.range(height // 8).select(F.col("id").alias("k"), F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))
    x0, xr, rr, y0, cr, yr = TRANSFORM
    strips = rows.unionByName(every).groupBy("k").applyInArrow(run, "k bigint, data binary")
    write_strips(strips, folder, f"PB/{IMAGE}.tif", height // 8, bands=1, height=height, width=width, dtype=np.dtype("float32"), rows=8, transform=(xr, rr, x0, cr, yr, y0), epsg=32644, deflate=True, nodata=np.nan)
    return folder


def strip_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a GeoTIFF for each row of patches, every second one turned by a quarter."""

    def run(patches: pa.Table) -> pa.Table:
        strip = patches["strip"][0].as_py()
        grid = np.zeros((1, 8, 160), np.float32)
        for at, values in zip(patches["vec_id"].to_pylist(), patches["embedding"].to_pylist()):
            grid[0, :, at % 20 * 8 : at % 20 * 8 + 8] = np.array(values, np.float32).reshape(8, 8)
        x0, xr, _, y0, _, yr = TRANSFORM
        place = (0.0, xr, x0 + strip, yr, 0.0, y0) if strip % 2 else (xr, 0.0, x0 + strip, 0.0, yr, y0)
        return pa.table({"path": [f"strips/{strip}.tif"], "content": pa.array([encode(grid, place, 32644, deflate=True)], pa.binary())})

    folder = scratch_dir(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("strip"), "vec_id", "embedding")
    write_rows(rows.groupBy("strip").applyInArrow(run, "path string, content binary"), folder)
    return folder


def mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each page, named like a raster: a good one of 4 x 4 pixels, one whose header is cut off, one with a broken block, and the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = [], []
            for page, text in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                whole = encode(np.full((1, 4, 4), page % 200, np.uint8), deflate=True)
                start = 8 + len(zlib.compress(bytes(16)))
                files.append((whole, whole[: len(whole) // 2], whole[:8] + bytes(start - 8) + whole[start:], (text or "").encode())[page % 4])
                names.append(f"mixed/{page}.tif")
            yield pa.RecordBatch.from_pydict({"path": names, "content": pa.array(files, pa.binary())})

    folder = scratch_dir(spark)
    write_rows(table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "path string, content binary"), folder)
    return folder


def zip_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive for every hundred documents: each text is a member, every third one stored as it is."""

    def run(docs: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("texts/", "")
            for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
                z.writestr(f"texts/{doc_id}.txt", (text or "").encode(), zipfile.ZIP_DEFLATED if doc_id % 3 else zipfile.ZIP_STORED)
        return pa.table({"path": [f"zips/{docs['hundred'][0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("hundred"), "doc_id", "text")
    write_rows(docs.groupBy("hundred").applyInArrow(run, "path string, content binary"), folder)
    return folder


#: Where the mosaics' corners begin in each zone: the same land, as zones 43 to 45 see it; and where the parcels begin in web Mercator.
ORIGINS, PARCEL_ORIGIN = {43: (1_034_500.0, 2_009_000.0), 44: (399_200.0, 2_002_000.0), 45: (-237_000.0, 2_015_500.0)}, (8_911_000.0, 2_050_000.0)


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of customers in three UTM zones over the same land, of two regions; every fifth is turned."""
    k = F.col("c_custkey")
    zone = (k % 3 + 43).cast("int")
    origin = lambda i: F.element_at(F.create_map(*[F.lit(x) for z, o in ORIGINS.items() for x in (z, o[i])]), zone)
    x0, y0 = origin(0) + k * 7919 % 10_000, origin(1) + k * 104_729 % 10_000
    straight, turned = F.array(x0, F.lit(0.5), F.lit(0.0), y0, F.lit(0.0), F.lit(-0.5)), F.array(x0, F.lit(0.4), F.lit(0.3), y0, F.lit(0.3), F.lit(-0.4))
    path = F.concat(F.when(k % 2 == 0, "/data/PB/").otherwise("/data/CG/"), k.cast("string"), F.lit(".tif"))
    return table(spark, sf_dir, "customer").select(k.alias("image_id"), path.alias("path"), F.concat(F.lit("EPSG:326"), zone.cast("string")).alias("crs"), F.when(k % 5 == 0, turned).otherwise(straight).alias("transform"), (k % 64 + 48).cast("int").alias("height"), (k % 80 + 64).cast("int").alias("width"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of orders in web Mercator, of two regions; every 500th is large."""
    k = F.col("o_orderkey")
    x0, y0 = F.lit(PARCEL_ORIGIN[0]) + k * 7919 % 10_500, F.lit(PARCEL_ORIGIN[1]) + k * 6007 % 10_500
    x1, y1 = x0 + 4 + k % 60 + F.when(k % 500 == 0, 400).otherwise(0), y0 + 3 + k % 45
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, "PB").otherwise("CG").alias("region"), k.alias("geom_id"), (k % 4 + 1).cast("int").alias("layer_val"), ring.alias("ring"), F.lit("urn:ogc:def:crs:EPSG::3857").alias("crs"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds of suppliers, every second one with a hole, in pixels; no edge meets a pixel's centre."""
    s = F.col("s_suppkey")
    x, y = s * 13 % 150 + 0.25, s * 29 % 190 + 0.5
    point = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    diamond = lambda r: F.array(point(r, F.lit(0)), point(F.lit(0), r), point(-r, F.lit(0)), point(F.lit(0), -r), point(r, F.lit(0)))
    outer = s % 6 + 4.125
    rings = F.when(s % 2 == 0, F.array(diamond(outer), diamond(F.lit(2.125)))).otherwise(F.array(diamond(outer)))
    return table(spark, sf_dir, "supplier").select(F.lit(IMAGE).alias("image_id"), s.alias("geom_id"), (s % 4 + 1).cast("int").alias("layer_val"), F.posexplode(rings).alias("part", "ring"))


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: one of each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "building").when(F.col("event_type") == "click", "road").when(F.col("event_type") == "purchase", "utility").when(F.col("event_type") == "signup", "vegetation").otherwise("water")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), kind.alias("feature_type"), F.floor(k / 10).cast("int").alias("chunk_row"), (k % 10).alias("chunk_col"),
        F.floor(F.col("value") * 2).cast("int").alias("area_px"), (F.col("event_id") % 113).cast("int").alias("x1"), (F.col("event_id") * 7 % 97).cast("int").alias("y1"),
    )
    share = F.least(F.col("area_px") / 16384.0 * 20.0, F.lit(0.99))
    return rows.select(
        "seq", "job_id", "feature_type", round_half_up(share, 4).alias("confidence"), F.concat_ws("_", F.col("chunk_row").cast("string"), F.col("chunk_col").cast("string")).alias("chunk_id"), "chunk_row", "chunk_col",
        "x1", "y1", (F.col("x1") + 1 + F.col("area_px") % 31).alias("x2"), (F.col("y1") + 1 + F.col("area_px") % 17).alias("y2"), "area_px",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk messages: each user is a job, each event a chunk that is done."""
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("user_id").agg(F.count("*").alias("total_chunks"))
    return events.join(totals, "user_id").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "total_chunks", F.floor(F.col("value") / 100).cast("int").alias("n_det"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of suppliers as rings of pixels; no edge meets a pixel's centre."""
    s = F.col("s_suppkey")
    x0, y0 = s * 13 % 150 + 0.25, s * 29 % 190 + 0.25
    x1, y1 = x0 + 4 + s % 9, y0 + 3 + s % 7
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return table(spark, sf_dir, "supplier").select(F.lit(IMAGE).alias("image_id"), s.alias("geom_id"), (s % 4 + 1).cast("int").alias("layer_val"), ring.alias("ring"))


#: The same in SQL, each a common table expression that may use those before it.
SQL = {
    "pixel": "select cast((vec_id//20)*8 + i//8 as int) r, cast((vec_id%20)*8 + i%8 as int) c, cast(v as double) v from (select vec_id, unnest(embedding) v, unnest(range(64)) i from embeddings)",
    "label_px": "select r, c, case when v < -0.13e0 then 1 when v < -0.065e0 then 6 when v < -0.016e0 then 83 when v < 0.03e0 then 4 when v < 0.083e0 then 21 else 0 end as class_id from pixel",
    "dims": "select cast(max(r)+1 as int) as hh, cast(max(c)+1 as int) as ww from pixel",
    "grid": "select cr, cc, r0, c0, cast(least(40, hh-r0) as int) as h, cast(least(40, ww-c0) as int) as w, hh, ww from (select cast(cr as int) cr, cast(cc as int) cc, cast(greatest(0, cr*32-4) as int) as r0, cast(greatest(0, cc*32-4) as int) as c0, hh, ww from dims, range((select (hh+31)//32 from dims)) a(cr), range((select (ww+31)//32 from dims)) b(cc))",
    "win": "select cr, cc, r-r0 as y, c-c0 as x, class_id, h, w from label_px join grid on r >= r0 and r < r0+h and c >= c0 and c < c0+w where class_id <> 0",
    "classes": "select * from (values (1,'building',0),(2,'building',0),(3,'building',0),(6,'road',1),(9,'road',1),(52,'road',1),(83,'utility',2),(93,'utility',2),(130,'utility',2),(4,'vegetation',3),(17,'vegetation',3),(21,'water',4),(26,'water',4),(60,'water',4)) t(class_id, feature_type, feature_pos)",
    "ev": "select *, cast(json_extract_string(props,'$.k') as int) as k from events",
    "det": """select event_id as seq, user_id as job_id, case event_type when 'view' then 'building' when 'click' then 'road' when 'purchase' then 'utility' when 'signup' then 'vegetation' else 'water' end as feature_type,
 floor(least(area_px/16384e0*20e0, 0.99e0)*10000e0+0.5e0)/10000e0 as confidence, concat(cast(chunk_row as varchar), '_', cast(chunk_col as varchar)) as chunk_id, chunk_row, chunk_col, x1, y1, x1+1+area_px%31 as x2, y1+1+area_px%17 as y2, area_px
 from (select event_id, user_id, event_type, cast(floor(k/10e0) as int) as chunk_row, k%10 as chunk_col, cast(floor(value*2e0) as int) as area_px, cast(event_id%113 as int) as x1, cast((event_id*7)%97 as int) as y1 from ev)""",
    "msg": "select user_id as job_id, event_id as seq, count(*) over (partition by user_id) as total_chunks, cast(floor(value/100e0) as int) as n_det from events",
    "poly": "select s_suppkey as geom_id, cast(s_suppkey%4+1 as int) as layer_val, (s_suppkey*13)%150+0.25e0 as x0, (s_suppkey*29)%190+0.25e0 as y0, (s_suppkey*13)%150+0.25e0+4+s_suppkey%9 as x1, (s_suppkey*29)%190+0.25e0+3+s_suppkey%7 as y1 from supplier",
    "shape": "select s_suppkey as geom_id, cast(s_suppkey%4+1 as int) as layer_val, (s_suppkey*13)%150+0.25e0 as x, (s_suppkey*29)%190+0.5e0 as y, s_suppkey%6+4.125e0 as outside, case when s_suppkey%2 = 0 then 2.125e0 else 0e0 end as hole from supplier",
    "ready": "select cr, cc, r-r0 as y, c-c0 as x, h, w, cast((cast(v as float)-min(cast(v as float)) over k)/(max(cast(v as float)) over k-min(cast(v as float)) over k) as float) as u from pixel join grid on r >= r0 and r < r0+h and c >= c0 and c < c0+w window k as (partition by cr, cc)",
    "seen": "select * from (select cr, cc, y, x, h, w, case when u < 0.3125e0 then 1 when u < 0.4375e0 then 6 when u < 0.5e0 then 83 when u < 0.5625e0 then 4 when u < 0.6875e0 then 21 else 0 end as class_id from ready) where class_id <> 0",
    "mosaic": "select *, case when region = 'PB' then 0 else 1 end as r, case when k%5 = 0 then 0.4e0 else 0.5e0 end as xr, case when k%5 = 0 then 0.3e0 else 0e0 end as rr, case when k%5 = 0 then 0.3e0 else 0e0 end as cr, case when k%5 = 0 then -0.4e0 else -0.5e0 end as yr, k%64+48 as height, k%80+64 as width from (select c_custkey as k, cast(43+c_custkey%3 as int) as zone, case when c_custkey%2 = 0 then 'PB' else 'CG' end as region, case c_custkey%3 when 0 then 1034500e0 when 1 then 399200e0 else -237000e0 end+(c_custkey*7919)%10000 as x0, case c_custkey%3 when 0 then 2009000e0 when 1 then 2002000e0 else 2015500e0 end+(c_custkey*104729)%10000 as y0 from customer)",
    "parcel": "select geom_id, region, layer_val, c, case when c in (0, 3) then x0 else x1 end as mx, case when c < 2 then y0 else y1 end as my from (select o_orderkey as geom_id, case when o_orderkey%3 = 0 then 'PB' else 'CG' end as region, cast(o_orderkey%4+1 as int) as layer_val, x0, y0, x0+4+o_orderkey%60+case when o_orderkey%500 = 0 then 400 else 0 end as x1, y0+3+o_orderkey%45 as y1 from (select o_orderkey, 8911000e0+(o_orderkey*7919)%10500 as x0, 2050000e0+(o_orderkey*6007)%10500 as y0 from orders)), range(4) t(c)",
    "rast": "select r, c, max(layer_val) as layer_val from pixel join poly on c+0.5e0 > x0 and c+0.5e0 < x1 and r+0.5e0 > y0 and r+0.5e0 < y1 group by r, c",
}
_USES = {"label_px": ["pixel"], "dims": ["pixel"], "grid": ["dims"], "win": ["label_px", "grid"], "det": ["ev"], "rast": ["pixel", "poly"], "ready": ["pixel", "grid"], "seen": ["ready"]}


def with_fixtures(names: list[str], select: str, recursive: bool = False, more: str = "") -> str:
    """``select`` under the fixtures that it names, and those they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _USES.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return f"with {'recursive ' if recursive else ''}" + ", ".join(f"{n} as ({SQL[n]})" for n in order) + more + " " + select
