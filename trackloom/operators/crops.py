"""Image crops as rows: preparation with a halo, detection and clock reading as Arrow functions over a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import parse_overlay
from trackloom.operators import vision


def prepared(frame: np.ndarray, box: tuple[int, int, int, int], previous: np.ndarray | None = None, vector: tuple | None = None, kind: str = "none", sigma: float = 25.0, smooth: float = 0.0) -> np.ndarray:
    """The cells (x0, y0, x1, y1) of a frame, ready for edges: difference to the previous frame, then kind (local_contrast or
    cross_grad), then a blur.

    The steps see as many cells around the box as they reach, so the result equals that part of the whole frame's. A
    previous frame of another size is not used; a box outside the frame gives no cells.
    """
    h, w = frame.shape[:2]
    x0, x1 = (min(max(int(v), 0), w) for v in (box[0], box[2]))
    y0, y1 = (min(max(int(v), 0), h) for v in (box[1], box[3]))
    if x1 <= x0 or y1 <= y0:
        return np.zeros((max(0, y1 - y0), max(0, x1 - x0)))
    reach = {"local_contrast": math.ceil(3 * sigma), "cross_grad": 1}.get(kind, 0) + math.ceil(3 * smooth) + 1
    part = (slice(max(0, y0 - reach), y1 + reach), slice(max(0, x0 - reach), x1 + reach))
    out = vision.gray(frame[part])
    if previous is not None and previous.shape[:2] == frame.shape[:2]:
        out = np.abs(out - vision.gray(previous[part]))
    if kind == "local_contrast":
        out = np.clip(out - vision.blur(out, sigma) + 128, 0, 255)
    elif kind == "cross_grad" and vector:
        out = vision.across(out, vector)
    if smooth:
        out = vision.blur(out, smooth)
    top, left = y0 - part[0].start, x0 - part[1].start
    return out[top : top + y1 - y0, left : left + x1 - x0]


def _image(pixels: bytes, height: int, width: int) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8)
    return x.reshape(height, width) if len(x) == height * width else x.reshape(height, width, 3)


def detections(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", heading: str | None = None, **options) -> DataFrame:
    """df without its pixels, and score, pixel_line, num_long_lines and aligned_lines per row; a null image scores 0.

    pixels holds height x width bytes of gray or three times as many of BGR. A row is one crop; only one batch is in memory.
    """
    keys = [c for c in df.columns if c != pixels]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keys).dtypes), "score double, pixel_line array<double>, num_long_lines int, aligned_lines int"])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        none = {"score": 0.0, "pixel_line": None, "num_long_lines": 0, "aligned_lines": 0}
        for b in batches:
            angles = b[heading] if heading else [None] * len(b)
            found = [none if p is None else vision.detect(_image(p, h, w), None if a is None or a != a else a, **options) for p, h, w, a in zip(b[pixels], b[height], b[width], angles, strict=True)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(found, columns=list(none))], axis=1)

    return df.mapInPandas(run, schema)


def corner(frame: np.ndarray, size: tuple[int, int], place: str) -> np.ndarray:
    """A corner of (height, width): top_left, top_right, bottom_left or bottom_right."""
    if place not in {"top_left", "top_right", "bottom_left", "bottom_right"}:
        raise ValueError(f"unknown corner: {place}")
    h, w = min(size[0], frame.shape[0]), min(size[1], frame.shape[1])
    rows = slice(0, h) if place.startswith("top") else slice(frame.shape[0] - h, None)
    return frame[rows, slice(0, w) if place.endswith("left") else slice(frame.shape[1] - w, None)]


def glyph(cell: np.ndarray, height: int, width: int) -> np.ndarray:
    """The bright cells of a slot cut out and put in the middle of (height, width); larger ones are thinned out to fit."""
    out = np.zeros((height, width))
    ys, xs = np.nonzero(cell)
    if len(ys):
        cut = cell[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        rows, cols = (np.arange(m) * n // m for n, m in ((cut.shape[0], min(height, cut.shape[0])), (cut.shape[1], min(width, cut.shape[1]))))
        cut = cut[np.ix_(rows, cols)]
        y, x = (height - cut.shape[0]) // 2, (width - cut.shape[1]) // 2
        out[y : y + cut.shape[0], x : x + cut.shape[1]] = cut
    return out


def read_slots(frame: np.ndarray, slots: list[tuple[int, int, int, int, str]], bank: dict[str, np.ndarray], threshold: int = 200) -> tuple[str, float]:
    """(text, mean confidence): in each slot (x, y, width, height, allowed characters) the character of the likest template.

    Likeness is the cosine of the bright cells. A slot without any, or outside the frame, reads as a blank with confidence 0.
    """
    bright = vision.gray(frame) > threshold
    out = []
    for x, y, w, h, allowed in slots:
        g = glyph(bright[y : y + h, x : x + w], *next(iter(bank.values())).shape)
        sure = {c: float((g * bank[c]).sum() / max(1e-9, np.linalg.norm(g) * np.linalg.norm(bank[c]))) for c in allowed if c in bank}
        out.append(max(sorted(sure.items()), key=lambda k: k[1]) if g.any() and sure else (" ", 0.0))
    return "".join(c for c, _ in out), sum(v for _, v in out) / max(1, len(out))


def clock_reads(df: DataFrame, slots: list, bank: dict[str, np.ndarray], size: tuple[int, int], place: str, blank_after: int, pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """df without its pixels, and text, confidence, parsed and ocr_status of the clock in a corner; a null image has no text."""
    keys = [c for c in df.columns if c != pixels]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keys).dtypes), "text string, confidence double"])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            reads = [(None, 0.0) if p is None else read_slots(corner(_image(p, h, w), size, place), slots, bank) for p, h, w in zip(b[pixels], b[height], b[width], strict=True)]
            texts = [(t and t[:blank_after] + " " + t[blank_after:], c) for t, c in reads]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(texts, columns=["text", "confidence"])], axis=1)

    rows = df.mapInPandas(run, schema).withColumn("parsed", parse_overlay(F.col("text")))
    return rows.withColumn("ocr_status", F.when(F.col("parsed").isNull(), "parse_failed").otherwise("ok"))
