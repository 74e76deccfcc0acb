"""Small images are read many to a batch, and tiles of many rasters lie in few folders."""

import glob
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.plans import pipelines
from rasterloom.sources import images


def test_tiles_of_many_rasters_share_a_folder(spark, sf_dir, monkeypatch):
    roots, written = [], pipelines._written
    monkeypatch.setattr(pipelines, "_written", lambda *a: roots.append(written(*a)) or roots[-1])
    pipelines.png_tiles(spark, sf_dir)
    root = roots[0].removeprefix("file://").removeprefix("file:")
    n = pipelines.images(spark, sf_dir).agg(F.max("img")).first()[0]
    assert len(os.listdir(root)) == n // 256 + 1 and len(glob.glob(f"{root}/*/*.png")) == 12 * pipelines.images(spark, sf_dir).count()


def test_images_of_several_sizes(spark, tmp_path):
    rng, made = np.random.default_rng(5), {}
    for i, (h, w) in enumerate([(1, 1), (3, 7), (400, 300), (20, 20)]):
        made[f"{i}.png"] = rng.integers(0, 255, (h, w, 3)).astype("u1")
        (tmp_path / f"{i}.png").write_bytes(images.encoded(made[f"{i}.png"]))
    found = images.pixels(spark, str(tmp_path)).toPandas()
    for name, image in made.items():
        part = found[found["path"].str.endswith(f"/{name}")]
        again = np.zeros(image.shape, int)
        again[part["yy"], part["xx"]] = np.stack(part["bands"])
        assert len(part) == image.shape[0] * image.shape[1] and np.array_equal(again, image)


def test_driver_lists_no_files(spark, sf_dir, monkeypatch):
    """The plan names the folders of the tiles, not the tiles, so the driver's part doesn't grow with their number; tiles are pixel by pixel what was written."""
    found = pipelines.png_tiles(spark, sf_dir)
    assert not found.inputFiles() and "FileScan image" not in found._jdf.queryExecution().toString()
    n = pipelines.images(spark, sf_dir).count()
    assert found.count() == found.select("img", "yy", "xx").distinct().count() == n * 48 * 64


def filtered(image, kinds):
    """A PNG file whose lines have the filters in kinds, in turn, as the format's text has them."""
    h, w, bands = image.shape
    a, body = image.astype(int), b""
    for y in range(h):
        kind, line = kinds[y % len(kinds)], []
        for x in range(w):
            for b in range(bands):
                left, up, corner = (int(a[q, p, b]) if q >= 0 and p >= 0 else 0 for q, p in ((y, x - 1), (y - 1, x), (y - 1, x - 1)))
                guess = left + up - corner
                paeth = left if abs(guess - left) <= abs(guess - up) and abs(guess - left) <= abs(guess - corner) else up if abs(guess - up) <= abs(guess - corner) else corner
                line.append((int(a[y, x, b]) - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
        body += bytes([kind, *line])
    piece = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    z = zlib.compress(body)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", head) + piece(b"tEXt", b"a\0b") + piece(b"IDAT", z[:9]) + piece(b"IDAT", z[9:]) + piece(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_filters(bands):
    image = np.random.default_rng(bands).integers(0, 256, (12, 7, bands)).astype("u1")
    for kinds in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert np.array_equal(images.decoded(filtered(image, kinds)), image)
    assert np.array_equal(images.decoded(images.encoded(image)), image)
    for broken in (b"GIF89a", images.encoded(image)[:-9], images.encoded(image)[:50] + b"?" + images.encoded(image)[51:]):
        with pytest.raises(ValueError):
            images.decoded(broken)


def test_files_below_a_folder(spark, tmp_path):
    """Files at any depth, large ones and others beside; what isn't named as asked for stays out."""
    rng, made = np.random.default_rng(6), {}
    for path, shape in {"a.png": (3, 4, 3), "b/c.PNG": (400, 300, 1), "b/d/e f.png": (2, 2, 4), "g/h.png": (1, 1, 2)}.items():
        made[path] = rng.integers(0, 256, shape).astype("u1")
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(images.encoded(made[path]))
    (tmp_path / "b" / "c.png.0123").write_bytes(b"half a file")
    (tmp_path / "empty").mkdir()
    found = images.of_png(images.files(spark, f"file://{tmp_path}"), ["path"], "content").toPandas()
    assert set(found["path"]) == set(made)
    for path, image in made.items():
        part, again = found[found["path"] == path], np.zeros(image.shape, int)
        again[part["yy"], part["xx"]] = np.stack(part["bands"])
        assert len(part) == image.shape[0] * image.shape[1] and np.array_equal(again, image)
    assert images.files(spark, str(tmp_path / "empty")).count() == 0
