"""Image files against the JVM's own readers and writers."""

import numpy as np
import pytest

from rasterloom.sources import images, tiff


@pytest.mark.parametrize("way", ["LZW", "Deflate", "ZLib", None])
@pytest.mark.parametrize("size", [(7, 5), (90, 130)])
def test_tiff_of_the_jvm(spark, tmp_path, way, size):
    rng = np.random.default_rng(2)
    h, w = size
    image = (rng.integers(0, 3, (h, w)) * 90 + np.arange(w) // 7).astype("u1")
    image[h // 2 :] = rng.integers(0, 256, (h - h // 2, w))
    jvm = spark._jvm
    held = jvm.java.awt.image.BufferedImage(w, h, 10)
    for (y, x), v in np.ndenumerate(image):
        held.getRaster().setSample(x, y, 0, int(v))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    options = writer.getDefaultWriteParam()
    if way:
        options.setCompressionMode(2)
        options.setCompressionType(way)
    path = tmp_path / "a.tif"
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(held, None, None), options)
    out.close()
    data = path.read_bytes()
    assert np.array_equal(tiff.array(data)[..., 0], image)
    assert np.array_equal(tiff.window(data, 2, 3, 60, 50)[..., 0], image[3:53, 2:62])


def test_tiff_options(spark, tmp_path):
    rng = np.random.default_rng(3)
    for i, (shape, options) in enumerate([((50, 37, 3), {"tile": 16}), ((50, 37, 1), {"tile": 16, "deflate": True}), ((5, 4, 4), {"deflate": True}), ((5, 4, 1), {})]):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        data = tiff.encoded(image, 2.0, epsg=32631, **options)
        (tmp_path / f"{i}.tif").write_bytes(data)
        assert np.array_equal(tiff.array(data), image)
        for x, y, w, h in ((0, 0, 3, 3), (10, 14, 20, 19), (2, 2, 100, 100), (60, 60, 5, 5)):
            assert np.array_equal(tiff.window(data, x, y, w, h), image[y : y + h, x : x + w])
    assert {(r.epsg, r.mppx) for r in tiff.descriptions(spark, str(tmp_path)).collect()} == {(32631, 2.0)}
    assert {r.mppx for r in tiff.descriptions(spark, str(tmp_path), "foot").collect()} == {2.0 * 0.3048}
    assert tiff.reference({34735: (1, 1, 0, 2, 2048, 0, 1, 4326, 3076, 0, 1, 9003)}) == (4326, 1200 / 3937)
    with pytest.raises(ValueError):
        tiff.array(data.replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01\x00", b"\x03\x01\x03\x00\x01\x00\x00\x00\x07\x00"))


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_png(spark, tmp_path, bands):
    image = np.random.default_rng(bands).integers(0, 256, (9, 14, bands), dtype=np.uint8)
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.png").write_bytes(images.encoded(image))
    (tmp_path / "no.png").write_bytes(b"no image")
    found = images.pixels(spark, str(tmp_path)).collect()
    assert len(found) == 9 * 14 and all(r.bands == image[r.yy, r.xx].tolist() for r in found)


def test_write(spark, tmp_path):
    rows = spark.createDataFrame([("a/x y.png", b"12"), ("b.png", b"")], "path string, png binary")
    root = f"file://{tmp_path}/out%20put"
    assert sorted(tuple(r) for r in images.write(rows, root).collect()) == [("a/x y.png", 2), ("b.png", 0)]
    assert (tmp_path / "out put" / "a" / "x y.png").read_bytes() == b"12" and sorted(p.name for p in (tmp_path / "out put").iterdir()) == ["a", "b.png"]
    with pytest.raises(ValueError):
        images.write(rows, "hdfs://host/folder")
