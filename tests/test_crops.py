"""Crops: halo, detection over rows, direction of flight, clock reading."""

import datetime as dt

import numpy as np
import pytest

from trackloom.operators import crops, vision

SCHEMA = "id long, pixels binary, height int, width int, heading double"


def streak(h=80, w=120):
    img = np.full((h, w), 40, np.uint8)
    for x in range(10, w - 10):
        img[20 + x // 3 : 23 + x // 3, x] = 220
    return img


@pytest.mark.parametrize("kind", ["none", "local_contrast", "cross_grad"])
@pytest.mark.parametrize("box", [(0, 0, 90, 70), (31, 22, 60, 47), (-5, 40, 20, 900)])
def test_a_crop_is_part_of_the_whole(kind, box):
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 255, (70, 90, 3)).astype(np.uint8) for _ in range(2))
    how = dict(previous=b, vector=(0.6, 0.8), kind=kind, sigma=4.0, smooth=1.5)
    whole, part = crops.prepared(a, (0, 0, 90, 70), **how), crops.prepared(a, box, **how)
    assert np.allclose(part, whole[max(0, box[1]) : box[3], max(0, box[0]) : box[2]])
    assert crops.prepared(a, (95, 0, 99, 10)).size == 0


def test_direction_of_flight_counts():
    level = np.full((60, 60), 50.0)
    level[30] = 200
    on = lambda f, v: f(level, v)[30, 20:40].mean()
    # a line along the bar is kept by the opening and so no top hat, one across it is
    assert on(lambda x, v: vision.top_hat_along(x, v, 21, 1), (0.0, 1.0)) > 100 > on(lambda x, v: vision.top_hat_along(x, v, 21, 1), (1.0, 0.0))
    side = lambda v: vision.across(level, v)[29, 20:40].mean()
    assert side((1.0, 0.0)) > 100 and side((0.0, 1.0)) == 0 and side(None) == side((1.0, 0.0))
    assert vision.apply_chain(level, ["cross_grad"], vector=(0.0, 1.0)).max() == 0


def test_detections_over_rows_equal_the_kernel(spark):
    img = streak()
    rows = [(1, img.tobytes(), 80, 120, None), (2, img.tobytes(), 80, 120, 108.0), (3, None, 80, 120, 0.0), (4, np.zeros((9, 9, 3), np.uint8).tobytes(), 9, 9, None)]
    df = crops.detections(spark.createDataFrame(rows, SCHEMA), heading="heading")
    assert "pixels" not in df.columns
    got = {r["id"]: r for r in df.collect()}
    want = vision.detect(img)
    assert (got[1]["score"], got[1]["pixel_line"], got[1]["num_long_lines"]) == (want["score"], want["pixel_line"], want["num_long_lines"])
    assert got[2]["score"] == vision.detect(img, 108.0)["score"] < got[1]["score"]
    assert (got[3]["score"], got[3]["pixel_line"], got[4]["score"]) == (0.0, None, 0.0)
    assert crops.detections(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_is_excluded_does_not_count():
    found = vision.examine(streak())
    assert found["edges"].any() and found["best"] in found["aligned"]
    assert not vision.examine(streak(), excluded=(0, 80, 0, 120))["lines"]
    assert not vision.examine(streak(), excluded=(-9, 30, 0, 40))["edges"][:30, :40].any()


def test_growing_stops_when_the_span_does():
    spans = {10: 5.0, 20: 9.0, 30: 9.0, 40: 50.0}
    assert vision.grown_length(spans.__getitem__, 10, 10, 40) == 9.0
    assert vision.grown_length(spans.__getitem__, 10, 10, 15) == 5.0


def test_clock_is_read_back(spark):
    r = np.random.default_rng(5)
    bank = {c: (r.random((9, 7)) > 0.5).astype(float) for c in "0123456789/:"}
    for g in bank.values():
        g[0, 0] = g[-1, -1] = 1
    text, blank = "04/09/202613:05:59", 10
    slots = [(i * 10, 2, 9, 11, "/" if text[i] == "/" else ":" if text[i] == ":" else "0123456789") for i in range(len(text))]
    frame = np.full((40, 300), 30, np.uint8)
    for i, c in enumerate(text):
        x = 300 - 180 + i * 10 + r.integers(0, 3)
        frame[3:12, x : x + 7] = np.where(bank[c] > 0, 255, 30)
    rows = [(1, frame.tobytes(), 40, 300, None), (2, np.zeros((40, 300), np.uint8).tobytes(), 40, 300, None), (3, None, 40, 300, None)]
    got = {x["id"]: x for x in crops.clock_reads(spark.createDataFrame(rows, SCHEMA), slots, bank, (16, 180), "top_right", blank).collect()}
    assert got[1]["text"] == "04/09/2026 13:05:59" and got[1]["confidence"] == pytest.approx(1.0)
    assert (got[1]["parsed"], got[1]["ocr_status"]) == (dt.datetime(2026, 4, 9, 13, 5, 59), "ok")
    assert [got[i]["ocr_status"] for i in (2, 3)] == ["parse_failed"] * 2 and got[3]["text"] is None
    with pytest.raises(ValueError):
        crops.corner(frame, (1, 1), "middle")


def test_glyphs_are_centred_and_fit():
    small, large = np.zeros((5, 5)), np.ones((30, 20))
    small[4, 4] = 1
    assert np.argwhere(crops.glyph(small, 9, 7)).tolist() == [[4, 3]]
    assert crops.glyph(large, 9, 7).sum() == 63 and not crops.glyph(np.zeros((3, 0)), 9, 7).any()
