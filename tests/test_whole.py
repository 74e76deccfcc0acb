"""Raster queries against brute force, and that they return every pixel of every image; test_queries has their SQL."""

import numpy as np
import pytest

from rasterloom import catalog
from rasterloom.sources.synthetic import HEIGHT, WIDTH, pixels


@pytest.fixture(scope="module")
def rasters(spark, sf_dir):
    found = {}
    for r in pixels(spark, sf_dir).collect():
        found.setdefault(r.img, np.zeros((HEIGHT, WIDTH), int))[r.yy, r.xx] = r.v
    return found


def labels_by_hand(inside):
    """The smallest label of each 8-connected region, by filling from each pixel in order."""
    label = np.zeros(inside.shape, int)
    for y, x in np.argwhere(inside):
        todo = [(y, x)] if not label[y, x] else []
        n = y * inside.shape[1] + x + 1
        while todo:
            a, b = todo.pop()
            if 0 <= a < inside.shape[0] and 0 <= b < inside.shape[1] and inside[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


def distances_by_hand(inside):
    off = np.argwhere(~inside)
    out = np.zeros(inside.shape)
    for y, x in np.argwhere(inside):
        d = np.abs(off - (y, x))
        out[y, x] = (1.3693 * d.min(1) + 0.955 * (d.max(1) - d.min(1))).min()
    return out


def test_components(spark, sf_dir, rasters):
    groups = {}
    for r in catalog.QUERIES["components"](spark, sf_dir).collect():
        groups.setdefault((r.img, r.label), set()).add((r.yy, r.xx))
    want = {}
    for img, v in rasters.items():
        label = labels_by_hand(v < 96)
        for y, x in np.argwhere(label):
            want.setdefault((img, label[y, x]), set()).add((y, x))
    assert sorted((k[0], sorted(p)) for k, p in groups.items()) == sorted((k[0], sorted(p)) for k, p in want.items())


def test_distances(spark, sf_dir, rasters):
    want = {img: distances_by_hand(v < 96) for img, v in rasters.items()}
    found = catalog.QUERIES["distance"](spark, sf_dir).collect()
    assert len(found) == len(rasters) * HEIGHT * WIDTH and all(abs(r.d - want[r.img][r.yy, r.xx]) < 2e-6 for r in found)


@pytest.mark.parametrize("name", ["watershed", "mask_to_distance", "laplacian", "nms", "regr_decode", "percentile_stretch", "hsv_shift", "minmax_stretch", "height_fallback"])
def test_every_pixel(spark, sf_dir, rasters, name):
    found = catalog.QUERIES[name](spark, sf_dir).select("img", "yy", "xx")
    assert found.distinct().count() == found.count() == len(rasters) * HEIGHT * WIDTH
