"""Kernels on drawn images: segments with gaps, blended equalisation, ridges of several widths; the whole camera model."""

import math
import random

import numpy as np
import pytest

from trackloom.functions import geo
from trackloom.operators import vision


def drawn(*segments, shape=(120, 200)):
    e = np.zeros(shape, bool)
    for x0, y0, x1, y1 in segments:
        n = max(abs(x1 - x0), abs(y1 - y0))
        for t in range(n + 1):
            e[round(y0 + (y1 - y0) * t / n), round(x0 + (x1 - x0) * t / n)] = True
    return e


def ends(found):
    return sorted(tuple(sorted(((round(x0), round(y0)), (round(x1), round(y1))))) for x0, y0, x1, y1 in found)


def test_collinear_streaks_are_two_segments():
    two = drawn((10, 50, 70, 50), (110, 50, 190, 50))
    assert ends(vision.lines(two)) == [((10, 50), (70, 50)), ((110, 50), (190, 50))]
    assert ends(vision.lines(two, gap=60)) == [((10, 50), (190, 50))]
    near = drawn((10, 50, 70, 50), (76, 50, 190, 50))
    assert ends(vision.lines(near)) == [((10, 50), (190, 50))]


def test_segments_that_cross_and_lie_side_by_side():
    cross = drawn((10, 10, 110, 110), (110, 10, 10, 110))
    assert ends(vision.lines(cross)) == [((10, 10), (110, 110)), ((10, 110), (110, 10))]
    side = drawn((10, 20, 150, 20), (30, 60, 150, 60), (180, 5, 180, 100))
    assert ends(vision.lines(side)) == [((10, 20), (150, 20)), ((30, 60), (150, 60)), ((180, 5), (180, 100))]
    assert len(vision.lines(side, most=2)) == 2 and vision.lines(drawn((0, 0, 12, 0))) == [] and vision.lines(np.zeros((9, 9), bool)) == []
    scattered = np.zeros((120, 200), bool)
    r = random.Random(2)
    for _ in range(60):
        scattered[r.randrange(120), r.randrange(200)] = True
    assert vision.lines(scattered) == []


def test_ends_are_cells_of_the_run():
    r = random.Random(7)
    for _ in range(30):
        a = r.uniform(0, math.pi)
        x0, y0, n = 100, 60, r.randint(30, 50)
        e = drawn((x0, y0, round(x0 + n * math.cos(a)), round(y0 + n * math.sin(a))))
        (x1, y1, x2, y2), *more = vision.lines(e, least=15)
        assert e[int(y1), int(x1)] and e[int(y2), int(x2)] and math.hypot(x2 - x1, y2 - y1) >= 0.9 * n - 2


def test_equalisation_has_no_steps():
    """On a ramp the output rises in small steps, also over the borders of tiles; tables of single tiles would jump."""
    ramp = np.tile(np.linspace(20, 220, 256), (64, 1))
    out = vision.equalize(ramp, tiles=4, clip=3.0)
    step = np.abs(np.diff(out, axis=1))
    assert out.shape == ramp.shape and 0 <= out.min() and out.max() <= 255
    assert step[:, 40:216].max() < 12
    flat = vision.equalize(np.full((40, 40), 90.0))
    assert np.ptp(flat) == 0
    low = 100 + 4 * np.sin(np.arange(64)[:, None] / 3) + np.zeros((64, 64))
    assert np.ptp(vision.equalize(low)) > 3 * np.ptp(low)
    for shape in ((1, 1), (3, 50), (9, 9)):
        assert vision.equalize(np.arange(shape[0] * shape[1]).reshape(shape) % 256).shape == shape


@pytest.mark.parametrize("width", [2, 8])
def test_ridges_of_several_widths(width):
    img = np.full((80, 120), 40.0)
    img[40 - width // 2 : 40 + (width + 1) // 2] += 120
    wide = vision.ridge(img)
    assert wide[40, 20:100].min() > 200 and wide[:20].max() < 60 and wide[62:].max() < 60
    assert vision.ridge(-img + 255)[40, 20:100].max() < 60
    # without the fitting scale the centre of a wide streak answers less than its rims
    if width == 8:
        assert vision.ridge(img, scales=(1.0,))[40, 60] < wide[40, 60]


def test_blobs_answer_less_than_lines():
    y, x = np.mgrid[:80, :120]
    img = 200 * np.exp(-((x - 30) ** 2 + (y - 40) ** 2) / 8.0) + sum(200 * np.exp(-((x - c) ** 2) / 8.0) for c in (60, 75, 90, 105))
    # the response saturates at its 95th percentile, which the four lines fill
    raw = vision.ridge(img, scales=(2.0,), beta=0.3)
    assert raw[10:70, 90].min() > 200 > raw[40, 30]
    assert vision.ridge(np.zeros((10, 10))).max() == 0


def test_camera_and_its_ray(spark):
    r = random.Random(1)
    a, b = 0.4, -0.7
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    rz = np.array([[math.cos(b), -math.sin(b), 0], [math.sin(b), math.cos(b), 0], [0, 0, 1]])
    rotation = rx @ rz
    turn = tuple(tuple(map(float, row)) for row in rotation)
    k = (-0.2, 0.05, 0.001, -0.0015, -0.004)
    rows = [(i, r.uniform(-4, 4), r.uniform(-4, 4), r.uniform(-2, 9)) for i in range(300)] + [(300, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, e double, n double, u double")
    cols = tuple(df[c] for c in "enu")
    px, py = geo.camera(cols, turn, 1_000.0, 900.0, 640.0, 360.0, k)
    df = df.withColumns({"x": px, "y": py})
    ray = geo.camera_ray(df["x"], df["y"], turn, 1_000.0, 900.0, 640.0, 360.0, k, 60)
    seen = 0
    for got in df.select("*", *[c.alias(f"r{i}") for i, c in enumerate(ray)]).collect():
        if got["e"] is None:
            assert got["x"] is None
            continue
        p = rotation @ np.array([got["e"], got["n"], got["u"]])
        if p[2] <= 0:
            assert got["x"] is None and got["r0"] is None
            continue
        u, v = p[0] / p[2], p[1] / p[2]
        r2 = u * u + v * v
        f = 1 + k[0] * r2 + k[1] * r2**2 + k[4] * r2**3
        x, y = u * f + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u), v * f + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v
        assert got["x"] == pytest.approx(1_000 * x + 640, rel=1e-9, abs=1e-6) and got["y"] == pytest.approx(900 * y + 360, rel=1e-9, abs=1e-6)
        if r2 < 0.6:
            seen += 1
            back = rotation.T @ np.array([u, v, 1.0])
            assert np.allclose([got["r0"], got["r1"], got["r2"]], back, atol=1e-6)
    assert seen > 40
