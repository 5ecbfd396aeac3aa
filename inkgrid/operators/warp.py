"""Crop and perspective: homographies, projection and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .screens import sample, taps

#: Output pixels of all different sizes of images that are broadcast as points.
FEW_POINTS = 1 << 16

Quad = list[tuple[float, float]]


def homography(dst: Quad, src: Quad) -> list[float] | None:
    """The nine numbers (the last 1) that take dst's corners to src's; None for degenerate corners."""
    rows, right = [], []
    for (x, y), (u, v) in zip(dst, src):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if np.linalg.matrix_rank(a, tol=1e-9) < 8:
        return None
    return [*np.linalg.solve(a, np.array(right, float)).tolist(), 1.0]


def project(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < 1e-12, 1e-12).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def bake(pixels: DataFrame, h: list[float], out_w: int, out_h: int) -> DataFrame:
    """The warped image: each output centre is projected and sampled; channels r, g, b as bytes.

    Images of one size are read at the same places: while those are few they are computed once a size and brought to the pixels.
    """
    frame = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    kinds = frame.select("w", "h").distinct()
    most = FEW_POINTS // (out_w * out_h)
    few = 0 < len(some := kinds.limit(most + 1).collect()) <= most
    points = pixels.sparkSession.createDataFrame(some, kinds.schema) if few else frame
    at = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("oy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))).alias("ox"))
    u, v = project(h, F.col("ox") + 0.5, F.col("oy") + 0.5)
    at = at.withColumn("px", u - 0.5).withColumn("py", v - 0.5)
    if few:
        own = pixels.select("image_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"), "r", "g", "b")
        own = own.join(frame, "image_id") if len(some) > 1 else own.withColumns({k: F.lit(x) for s in some for k, x in s.asDict().items()})
        near = F.broadcast(taps(at).select("w", "h", "_tx", "_ty", "ox", "oy", "_t"))
        got = own.join(near, ["w", "h", "_tx", "_ty"]).groupBy("image_id", "ox", "oy").agg(*(F.sum(F.col("_t") * F.col(c)).alias(c) for c in "rgb"))
    else:
        got = sample(at, pixels, ["image_id"], ("r", "g", "b"))
    return got.select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), *(F.round(c).cast("int").alias(c) for c in "rgb"))


def normalize_crop(x0: float, y0: float, x1: float, y1: float, least: float = 0.02) -> tuple[float, float, float, float]:
    """A crop inside [0, 1], its corners in order and at least ``least`` apart."""

    def axis(a: float, b: float) -> tuple[float, float]:
        a, b = sorted((min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)))
        if b - a < least:
            b = min(a + least, 1.0)
            a = min(a, b - least)
        return a, b

    (a, b), (c, d) = axis(x0, x1), axis(y0, y1)
    return a, c, b, d


def crop_and_warp(pixels: DataFrame, w: int, h: int, quad: Quad | None = None, crop: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """quad: where the view's corners lie in the image, in shares of it; the identity is a plan without a warp."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    quad = quad or square
    x0, y0, x1, y1 = normalize_crop(*crop)
    if max(abs(a - b) for p, q in zip(quad, square) for a, b in zip(p, q)) < 1e-4 and max(abs(x0), abs(y0), abs(x1 - 1), abs(y1 - 1)) < 1e-4:
        return pixels
    view = homography(square, quad)
    if view is None:
        raise ValueError("the corners are degenerate")

    def at(x: float, y: float) -> tuple[float, float]:
        k = view[6] * x + view[7] * y + view[8]
        return (view[0] * x + view[1] * y + view[2]) / k * w, (view[3] * x + view[4] * y + view[5]) / k * h

    out_w, out_h = max(round((x1 - x0) * w), 1), max(round((y1 - y0) * h), 1)
    corners = [(0.0, 0.0), (float(out_w), 0.0), (float(out_w), float(out_h)), (0.0, float(out_h))]
    m = homography(corners, [at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1)])
    if m is None:
        raise ValueError("the corners are degenerate")
    return bake(pixels, m, out_w, out_h)
