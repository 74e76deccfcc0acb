"""Rock instances and contour trees against plain versions on whole images."""

import numpy as np
import pytest

from rasterloom import catalog
from rasterloom.operators import regions
from rasterloom.plans.rasters import hills
from test_whole import labels_by_hand


def around(a, edge="reflect"):
    wide = np.pad(a, 1, mode=edge) if edge == "reflect" else np.pad(a.astype(float), 1, constant_values=edge)
    return {(dy, dx): wide[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def scharr(a):
    n = around(a)
    side = lambda s: 3 * n[s(-1)] + 10 * n[s(0)] + 3 * n[s(1)]
    return side(lambda y: (y, 1)) - side(lambda y: (y, -1)), side(lambda x: (1, x)) - side(lambda x: (-1, x))


def laplacian(a):
    n = around(a)
    return n[-1, 0] + n[1, 0] + n[0, -1] + n[0, 1] - 4 * a


def lowest(a):
    return np.min(list(around(a, np.inf).values()), axis=0)


def highest(a):
    return np.max(list(around(a, -np.inf).values()), axis=0)


def otsu(v):
    best = (-1.0, 0)
    for t in np.unique(v)[:-1]:
        a, b = v[v <= t], v[v > t]
        best = max(best, (round(a.size / v.size * b.size / v.size * (a.mean() - b.mean()) ** 2, 3), -int(t)))
    return -best[1]


def cores(v):
    lap = laplacian(v)
    gx, gy = scharr(v)
    steep = np.rint(np.minimum(abs(gx), 255) * 0.5 + np.minimum(abs(gy), 255) * 0.5) > 127
    crosses = ((lap > 0) & (lowest(lap) < 0)) | ((lap < 0) & (highest(lap) > 0))
    kept = (v > otsu(v)) & ~(crosses & steep)
    return highest(lowest(kept.astype(int))) > 0


def masks(v):
    b = np.floor(sum(around(v).values()) / 9 + 0.5).astype(int)
    gx, gy = (g // 32 for g in scharr(b))
    g = np.floor(np.sqrt(gx * gx + gy * gy))
    flow = np.rint((scharr(gx)[0] // 32) * 0.5 + (scharr(gy)[1] // 32) * 0.5)
    return (flow <= -0.255) & (b > 5.1) & (g < 2.55), (g < 25.5) & (b > 63.75)


def images(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r.img, {})[r.yy, r.xx] = r[value]
    for k, cells in out.items():
        h, w = (max(c[i] for c in cells) + 1 for i in (0, 1))
        a = np.zeros((h, w), type(next(iter(cells.values()))))
        for c, x in cells.items():
            a[c] = x
        out[k] = a
    return out


@pytest.fixture(scope="module")
def fields(spark, sf_dir):
    return images(hills(spark, sf_dir), "v")


def test_production(spark, sf_dir, fields):
    found = images(catalog.QUERIES["rock_production"](spark, sf_dir), "basin")
    several = 0
    for img, v in fields.items():
        core = cores(v)
        lap = laplacian(core * 255)
        label = labels_by_hand(core)
        markers = np.where(core, label + 1, np.where((lowest(lap) < 0) & (lap > 0), 0, 1))
        assert np.array_equal(found[img], regions.flood_by_difference(v, markers)), img
        several += len(np.unique(label)) > 2
    assert several


def test_two_scales(spark, sf_dir, fields):
    from rasterloom.plans.objects import _field

    coarse = images(_field(spark, sf_dir, 6.0), "p")
    found = images(catalog.QUERIES["rock_scales"](spark, sf_dir), "rock")
    assert any(f.any() and not f.all() for f in found.values())
    for img, v in fields.items():
        c = np.floor(coarse[img] * 0.8 * 255).astype(int)
        (little, big), (_, other) = masks(v), masks(c)
        core = (little & (c <= 5.1)) | big | other
        possible = (v > 12.75) | (c > 12.75)
        markers = np.where(core, labels_by_hand(core) + 1, np.where(possible, 0, 1))
        assert np.array_equal(found[img], regions.flood_by_difference(possible * 255, markers) > 1), img


def test_flood_by_difference():
    """Every pixel inside gets the number of a marker that reaches it, or is a line next to two numbers."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        v = rng.integers(0, 4, (9, 11))
        markers = np.where(rng.random(v.shape) < 0.06, rng.integers(1, 5, v.shape), 0)
        markers[4, 5] = 1
        out = regions.flood_by_difference(v, markers)
        assert (out[[0, -1]] == -1).all() and (out[:, [0, -1]] == -1).all()
        inner = (slice(1, -1), slice(1, -1))
        assert np.array_equal(out[inner][markers[inner] > 0], markers[inner][markers[inner] > 0])
        for y, x in np.argwhere(out[inner] == -1) + 1:
            assert len({int(out[y + a, x + b]) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))} - {-1, 0}) > 1
        for k in set(np.unique(out)) - {-1, 0}:
            reach = regions.label_array(out == k, regions._STRAIGHT)
            assert set(np.unique(reach[reach > 0])) == set(np.unique(reach[(markers == k) & (out == k)]))
    assert (regions.flood_by_difference(np.zeros((2, 3)), np.ones((2, 3))) == -1).all()


def test_borders():
    """A border passes exactly the set pixels with a straight neighbour in the region or hole on its other side, and the tree alternates."""
    rng = np.random.default_rng(6)
    for share in (0.35, 0.6, 0.8):
        for _ in range(15):
            mask = rng.random((10, 12)) < share
            wide = np.pad(mask, 1)
            fore, rear = regions.label_array(wide), regions.label_array(~wide, regions._STRAIGHT)
            number = {k: (divmod(k - 1, 14)[0] - 1) * 12 + divmod(k - 1, 14)[1] for k in {*np.unique(fore), *np.unique(rear)} - {0, 1}}
            want = {}
            for y, x in np.argwhere(wide):
                for dy, dx in regions._STRAIGHT:
                    if not wide[y + dy, x + dx]:
                        want.setdefault((int(fore[y, x]), int(rear[y + dy, x + dx])), set()).add((x - 1, y - 1))
            found = {}
            kinds = {}
            for k, parent, hole, points in regions.borders(mask):
                cells = set(points)
                for a, b in zip(points, points[1:] + points[:1], strict=True):
                    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
                    cells |= {(a[0] + (b[0] - a[0]) * i // n, a[1] + (b[1] - a[1]) * i // n) for i in range(n)} if n else set()
                found[parent, k, hole] = cells
                kinds[k] = hole
            assert all(not p or kinds[p] != hole for p, _, hole in found)
            sides = {}
            for (f, r), cells in want.items():
                up = number.get(r, 0)
                hole = (number[f], up, True) in found
                sides[(number[f], up, True) if hole else (up, number[f], False)] = cells
            assert sides == found
