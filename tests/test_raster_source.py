"""The raster data source: files of several layouts, reads by range, boxes from filters, and writes that commit."""

import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import raster, tiff


def built(image, *, big=False, planes=1, nodata=None, extra=None, rows=3, order="<"):
    """A plain file by hand, in strips of some rows; planes=2 puts every band by itself."""
    h, w, bands = image.shape
    image = image.astype(image.dtype.newbyteorder(order))
    parts = [image[i : i + rows, :, b : b + 1] if planes == 2 else image[i : i + rows] for b in range(bands if planes == 2 else 1) for i in range(0, h, rows)]
    parts = [p.tobytes() for p in parts]
    head = 16 if big else 8
    places = [head + sum(map(len, parts[:i])) for i in range(len(parts))]
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    wide = (16, "Q") if big else (4, "I")
    fields = [(256, 3, "H", (w,)), (257, 3, "H", (h,)), (258, 3, "H", (image.dtype.itemsize * 8,) * bands), (259, 3, "H", (1,)), (273, *wide, places), (277, 3, "H", (bands,)), (278, 3, "H", (rows,)), (279, *wide, [len(p) for p in parts]), (284, 3, "H", (planes,)), (339, 3, "H", (kind,) * bands)]
    if extra is not None:
        fields.append((338, 3, "H", (extra,)))
    if nodata is not None:
        fields.append((42113, 2, "c", [bytes([c]) for c in nodata.encode() + b"\0"]))
    fields.sort(key=lambda f: f[0])
    body = b"".join(parts)
    at = head + len(body)
    entry, inline, offset, count = (20, 8, "Q", "Q") if big else (12, 4, "I", "H")
    more_at, entries, more = at + struct.calcsize(order + count) + entry * len(fields) + inline, b"", b""
    for tag, number, code, values in fields:
        packed = struct.pack(f"{order}{len(values)}{code}", *values)
        entries += struct.pack(order + "HH" + offset, tag, number, len(values))
        if len(packed) <= inline:
            entries += packed.ljust(inline, b"\0")
        else:
            entries += struct.pack(order + offset, more_at + len(more))
            more += packed
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + body + struct.pack(order + count, len(fields)) + entries + b"\0" * inline + more


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("planes", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_layouts(big, planes, order):
    rng = np.random.default_rng(2)
    for kind in ("u1", "u2", "i2", "f4", "f8"):
        image = (rng.random((11, 7, 3)) * 200).astype(kind)
        data = built(image, big=big, planes=planes, order=order, nodata="-9999")
        assert np.array_equal(tiff.array(data), image) and np.array_equal(tiff.window(data, 2, 4, 3, 5), image[4:9, 2:5])
        assert tiff.no_data(tiff.tags(data)[1]) == -9999.0


@pytest.fixture(scope="module")
def source(spark):
    raster.register(spark)
    return lambda path, **options: spark.read.format("raster").options(**options).load(path)


def cells(df):
    return {(r.yy, r.xx): (tuple(r.bands), r.valid) for r in df.collect()}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_no_data_and_alpha(source, tmp_path, scheme):
    image = np.arange(24, dtype="f4").reshape(4, 6, 1)
    image[1, 2] = -1
    image[2, 2] = np.nan
    (tmp_path / "a.tif").write_bytes(built(image, nodata="-1"))
    found = cells(source(f"{scheme}{tmp_path}"))
    assert len(found) == 24 and {k for k, v in found.items() if not v[1]} == {(1, 2)}
    assert {k for k, v in cells(source(f"{scheme}{tmp_path}", nodata="nan")).items() if not v[1]} == {(2, 2)}
    colour = np.arange(36, dtype="u1").reshape(3, 4, 3)
    colour[..., 2] = 255
    colour[0, 1, 2] = 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.tif").write_bytes(built(colour, extra=2))
    found = cells(source(f"{scheme}{tmp_path}/b"))
    assert {k for k, v in found.items() if not v[1]} == {(0, 1)} and found[2, 3] == (tuple(map(float, colour[2, 3])), True)


def test_boxes_from_filters(spark, source, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (96, 128, 2)).astype("u1")
    for name in "xy":
        (tmp_path / f"{name}.tif").write_bytes(tiff.encoded(image, tile=16, deflate=True))
    df = source(str(tmp_path)).where("yy >= 20 and yy < 50 and xx > 100 and xx <= 110 and path like '%x.tif'")
    found = cells(df)
    assert found == {(y, x): (tuple(map(float, image[y, x])), True) for y in range(20, 50) for x in range(101, 111)}
    assert cells(source(f"{tmp_path}/x.tif").where("yy = 95 and xx = 127")) == {(95, 127): (tuple(map(float, image[95, 127])), True)}
    assert source(str(tmp_path)).where("xx < 0").count() == 0 and source(str(tmp_path)).count() == 2 * image[..., 0].size


def test_reads_only_what_it_touches(tmp_path, monkeypatch):
    """A window of a large file costs its strips or tiles and the directory, and no byte of the others."""
    image = np.random.default_rng(1).integers(0, 255, (2048, 1024, 1)).astype("u1")
    (tmp_path / "a.tif").write_bytes(tiff.encoded(image, tile=256))
    (tmp_path / "b.tif").write_bytes(built(image, rows=16))
    for name in "ab":
        reader = raster.RasterReader({"path": f"{tmp_path}/{name}.tif"})
        reader.low, reader.high = {"yy": 1000, "xx": 600}, {"yy": 1030, "xx": 700}
        boxes = reader.partitions()
        with pa.fs.LocalFileSystem().open_input_file(f"{tmp_path}/{name}.tif") as file:
            data = raster.Ranges(file)
            rows = pa.Table.from_batches([b for box in boxes for b in reader.batches(box, data)])
        assert rows.num_rows == 30 * 100 and sum(rows.column("bands").combine_chunks().flatten().to_numpy()) == image[1000:1030, 600:700].sum()
        assert data.read < os.path.getsize(f"{tmp_path}/{name}.tif") / 5


def test_partitions_are_whole_tiles(tmp_path, monkeypatch):
    monkeypatch.setattr(raster, "PART", 64 * 64)
    image = np.zeros((130, 200, 1), "u1")
    (tmp_path / "a.tif").write_bytes(tiff.encoded(image, tile=32))
    boxes = raster.RasterReader({"path": str(tmp_path)}).partitions()
    assert sum(b.w * b.h for b in boxes) == image.size and all(b.x % 32 == b.y % 32 == 0 for b in boxes) and len(boxes) > 4


def test_small_files_share_a_partition(source, tmp_path, monkeypatch):
    """Planning opens none of them, and a task reads many, each cut to what is asked for."""
    for i in range(1200):
        (tmp_path / f"{i:04}.tif").write_bytes(tiff.encoded(np.full((4 + i % 2, 5, 1), i % 250, "u1")))
    reader = raster.RasterReader({"path": str(tmp_path)})
    with monkeypatch.context() as patch:
        patch.setattr(raster, "Ranges", None)
        assert [len(p.paths) for p in reader.partitions()] == [512, 512, 176]
    found = source(str(tmp_path)).where("yy >= 3 and xx < 2").groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("bands")[0]).alias("v")).collect()
    assert {(r.path[-8:-4], r.n, r.v) for r in found} == {(f"{i:04}", 2 + i % 2 * 2, float(i % 250)) for i in range(1200)}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_are_committed(spark, source, tmp_path, scheme):
    made = spark.range(20).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), F.col("id"), F.lit(".bin")).alias("path"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    made.write.format("raster_files").mode("append").save(f"{scheme}{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f"d{i % 3}/f{i}.bin": str(i).encode() for i in range(20)} and len(os.listdir(tmp_path / "out")) == 3


def test_failed_writes_leave_nothing(spark, source, tmp_path):
    broken = spark.range(6).select(F.when(F.col("id") == 5, F.lit("../x")).otherwise(F.col("id").cast("string")).alias("path"), F.lit(b"1").alias("content")).repartition(3)
    with pytest.raises(Exception, match="below the folder"):
        broken.write.format("raster_files").mode("append").save(f"{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
