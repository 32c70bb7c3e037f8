"""Files that are larger than a value: parts with positions, archives by their directories, shapes by their index."""

import hashlib
import pickle
import random
import struct
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridwright.operators import upload
from gridwright.sources import archives, datasource, vectors


def test_files_go_through_parts_and_come_back(spark, tmp_path):
    """Slices of files, shuffled and repeated, are placed as the files they were."""
    rng = random.Random(1)
    for name, size in (("a.bin", 100_000), ("empty.bin", 0), ("sub/one.bin", 1), ("even.bin", 4096)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(rng.randbytes(size))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in")).select("path", "length")
    files = files.unionByName(spark.createDataFrame([(f"file:{tmp_path}/in/empty.bin", 0)], "path string, length bigint"))  # Spark's list leaves out empty files
    parts = upload.slices(files, 1024)
    name = F.regexp_extract("path", "/in/(.*)$", 1)
    listed = upload.manifest(parts, "path", 1024)
    assert {r.path.rpartition("/in/")[2]: (r.total_size, r.parts, r.whole) for r in upload.whole_files(listed, "path", 1024).collect()} == {"a.bin": (100_000, 98, True), "empty.bin": (0, 1, True), "sub/one.bin": (1, 1, True), "even.bin": (4096, 4, True)}
    upload.place(parts.unionByName(parts).orderBy(F.rand(3)), "path", str(tmp_path / "out"), name, 1024)
    for made in (tmp_path / "in").rglob("*.bin"):
        assert (tmp_path / "out" / made.relative_to(tmp_path / "in")).read_bytes() == made.read_bytes()
    assert not list((tmp_path / "out").glob("_*"))
    upload.place(parts.where("idx < 3"), "path", str(tmp_path / "out2"), name, 1024)  # what is there is written, the manifest says what isn't
    lacks = upload.whole_files(upload.manifest(parts.where("idx <> 3"), "path", 1024), "path", 1024)
    assert {r.path.rpartition("/in/")[2] for r in lacks.where("not whole").collect()} == {"a.bin"}  # even.bin lost its end, which no part shows


def test_a_later_part_replaces_an_earlier_one(spark, tmp_path):
    rows = [("f", 0, b"aaaa", 1), ("f", 1, b"bb", 1), ("f", 0, b"cccc", 2)]
    parts = spark.createDataFrame(rows, "key string, idx int, part binary, seq int")
    upload.place(parts, "key", str(tmp_path), size=4)
    assert (tmp_path / "f").read_bytes() == b"ccccbb"
    listed = {r.idx: r for r in upload.manifest(parts, "key", 4).collect()}
    assert (listed[0].arrivals, listed[0].offset, listed[0].checksum, listed[1].offset) == (2, 0, hashlib.md5(b"cccc").hexdigest(), 4)


def test_parts_that_fail_leave_nothing(spark, tmp_path):
    parts = spark.createDataFrame([("a", 0, b"x"), ("b", 0, None)], "path string, offset bigint, part binary")
    datasource.register(spark)
    with pytest.raises(Exception, match="without content"):
        parts.write.format(datasource.PARTS).mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_stores_without_positions_take_parts_in_order(tmp_path, monkeypatch):
    """The same writer where a file is only written from its start to its end."""
    from pyarrow import fs

    class Store(fs.SubTreeFileSystem):
        pass

    store = Store(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(datasource, "file_system", lambda path: (store, path))
    assert not datasource.has_positions("out")
    writer = datasource.PartWriter("out", False)
    rows = [{"path": "d/a", "offset": 0, "part": b"xy"}, {"path": "d/a", "offset": 2, "part": b"z"}, {"path": "b", "offset": 0, "part": b""}]
    writer.commit([writer.write(iter(rows)), None])
    assert (tmp_path / "out" / "d" / "a").read_bytes() == b"xyz" and (tmp_path / "out" / "b").read_bytes() == b"" and len(list((tmp_path / "out").iterdir())) == 2
    other = datasource.PartWriter("out", False)
    with pytest.raises(ValueError, match="continues at 0"):
        other.write(iter(rows[1:]))
    other.abort([None])
    assert len(list((tmp_path / "out").iterdir())) == 2


@pytest.mark.parametrize("kind", [datasource.FileWriter, datasource.PartWriter])
@pytest.mark.parametrize("local", [True, False])
def test_the_driver_holds_no_list_of_files(tmp_path, monkeypatch, kind, local):
    """What a task says to the driver is as long for 500 files as for one; folders come together from many tasks, jobs and levels."""
    from pyarrow import fs

    class Store(fs.SubTreeFileSystem):
        pass

    if not local:
        store = Store("/", fs.LocalFileSystem())
        monkeypatch.setattr(datasource, "file_system", lambda path: (store, path))
    name = lambda k: f"{k % 7}/{k % 3}/{k}" if k % 2 else f"f{k}"
    row = lambda k, value: {"path": name(k), "offset": 0, "part": value, "content": value}
    said = []
    for numbers, value in ((range(500), b"a"), (range(500, 501), b"b"), (range(400, 600), b"c")):
        writer = kind(str(tmp_path / "out"), False)
        messages = [writer.write(iter([row(k, value) for k in sorted(part, key=name)])) for part in (numbers[::2], numbers[1::2], [])]
        said.append(max(len(pickle.dumps(m)) for m in messages))
        writer.commit([*messages, None])
    assert len(set(said)) == 1
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {name(k): b"a" if k < 400 else b"c" for k in range(600)}
    assert not list((tmp_path / "out").glob("_*"))


def test_digests_by_names(spark, tmp_path):
    data = {"a/one": b"", "a/b/two": bytes(3_000_000), "three%20.bin": b"x"}
    for name, value in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(value)
    files = spark.createDataFrame([(k, n, len(v)) for k, (n, v) in enumerate(data.items())] + [(9, None, None)], "id int, path string, length bigint")
    want = {n: hashlib.sha256(v).hexdigest() for n, v in data.items()} | {None: None}
    found = upload.digests(files, f"file://{tmp_path}")
    assert {r.path: r.sha256 for r in found.collect()} == want and found.columns == ["id", "path", "length", "sha256"]
    assert upload.digests(files.where("false"), str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="gone"):
        upload.digests(spark.createDataFrame([("gone", 1)], "path string, length bigint"), str(tmp_path)).collect()


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("folder/", "")
        for k, (name, data) in enumerate(members.items()):
            with z.open(zipfile.ZipInfo(name + ".txt"), "w", force_zip64=bool(k % 2)) as out:
                out.write(data)
            z.infolist()[-1].compress_type = zipfile.ZIP_STORED


def test_archives_by_their_directories(spark, tmp_path):
    rng = random.Random(2)
    data = {"a": rng.randbytes(5000), "b": b"", "c": b"z" * 100_000, "d": rng.randbytes(2048)}
    zipped(tmp_path / "stored.zip", **data)
    with zipfile.ZipFile(tmp_path / "deflated.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, value in data.items():
            z.writestr(f"{name}.txt", value)
    with zipfile.ZipFile(tmp_path / "other.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("e.txt", b"text" * 50)
    (tmp_path / "broken.zip").write_bytes(b"PK broken")
    damaged = bytearray((tmp_path / "stored.zip").read_bytes())
    damaged[damaged.index(data["a"]) + 7] ^= 1
    (tmp_path / "damaged.zip").write_bytes(damaged)
    listed = archives.directory(archives.list_archives(spark, str(tmp_path)))
    assert listed.where("error is null").count() == 13 and listed.where("error is not null").count() == 1
    found, errors = defaultdict(list), {}
    for r in archives.member_parts(listed, 1024).collect():
        key = (r.archive.rpartition("/")[2], r.member)
        if r.error:
            errors[key] = r.error
        else:
            found[key].append((r.idx, bytes(r.part)))
    for archive in ("stored.zip", "deflated.zip"):
        for name, value in data.items():
            parts = sorted(found[archive, f"{name}.txt"])
            assert [k for k, _ in parts] == list(range(max(1, -(-len(value) // 1024)))) and b"".join(p for _, p in parts) == value and all(len(p) == 1024 for _, p in parts[:-1])
    assert set(errors) == {("broken.zip", None), ("damaged.zip", "a.txt"), ("other.zip", "e.txt")} and "checksum" in errors["damaged.zip", "a.txt"] and "12" in errors["other.zip", "e.txt"]


def test_members_go_to_files(spark, tmp_path):
    """An archive is unpacked without a value of more than a part."""
    data = {"x": b"q" * 70_000, "y": b"tail"}
    zipped(tmp_path / "a.zip", **data)
    parts = archives.member_parts(archives.directory(archives.list_archives(spark, str(tmp_path))), 4096).where("error is null")
    upload.place(parts, "member", str(tmp_path / "out"), size=4096)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.txt": v for k, v in data.items()}


def test_shapes_by_their_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "RECORDS", 3)
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 0.0)]
    shp = vectors.encode_shapes([[square(float(k)), square(k + 0.5)] if k % 3 else None if k % 2 else [square(float(k))] for k in range(10)])
    (tmp_path / "good.shp").write_bytes(shp)
    (tmp_path / "good.shx").write_bytes(vectors.encode_index(shp))
    broken = bytearray(shp)
    at = struct.unpack_from(">i", vectors.encode_index(shp), 100 + 8 * 4)[0] * 2
    struct.pack_into("<i", broken, at + 8, 99)  # the fifth record has a type of its own
    (tmp_path / "bad.shp").write_bytes(broken)
    (tmp_path / "bad.shx").write_bytes(vectors.encode_index(shp))
    (tmp_path / "alone.shp").write_bytes(shp)
    (tmp_path / "text.shp").write_bytes(b"no shapes at all")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(str(tmp_path)).select("path")
    got = defaultdict(list)
    for r in vectors.shapes(files).collect():
        got[r.path.rpartition("/")[2]].append((r.geom_id, r.part, r.ring, bool(r.error)))
    want = sorted([(n, part, ring, False) for n, part, ring in vectors.read_shapes(shp)], key=str)
    assert sorted(got["good.shp"], key=str) == want
    assert sorted([x for x in got["bad.shp"] if not x[3]], key=str) == [x for x in want if x[0] != 5] and [x for x in got["bad.shp"] if x[3]] == [(5, None, None, True)]
    assert got["alone.shp"] == [(None, None, None, True)] and got["text.shp"] == [(None, None, None, True)]
