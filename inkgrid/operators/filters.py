"""Neighbourhood operators over dense rasters: rows and columns as arrays or windows, a shuffle for each direction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["image_id", "channel"]


def kernel(sigma: float) -> list[tuple[int, float]]:
    r = math.ceil(3 * sigma)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [(i - r, x / sum(w)) for i, x in enumerate(w)]


def taken(n: int, r: int) -> np.ndarray:
    """Places that a line of n values is read at, r beyond each end: reflected once, then the end itself."""
    at = np.arange(-r, n + r)
    return np.clip(np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - at - 1, at)), 0, n - 1)


def _along(df: DataFrame, axis: str, other: str, value: str, taps: list[tuple[int, float]], keys: list[str]) -> DataFrame:
    """Lines as arrays; a batch's lines of one length are a matrix, and each tap a shifted sum of it."""
    lines = df.groupBy(*keys, other).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, value))), lambda s: s[value]).alias("_a"))
    r = max(o for o, _ in taps)

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index("_a"))
            values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            out, size = np.empty(len(values)), np.diff(offsets)
            for n in np.unique(size[size > 0]).tolist():
                at = offsets[:-1][size == n][:, None] + np.arange(n)
                padded = values[at][:, taken(n, r)]
                out[at] = sum(w * padded[:, r + o : r + o + n] for o, w in taps)
            smooth = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*(c for c, k in zip(b.columns, b.schema.names) if k != "_a"), smooth], names=[*(k for k in b.schema.names if k != "_a"), "_a"])

    return lines.mapInArrow(run, lines.schema).select(*keys, other, F.posexplode("_a").alias(axis, value))


def gaussian(df: DataFrame, sigma: float, value: str = "d", keys: list[str] | None = None) -> DataFrame:
    """Separable blur with reflected edges; sigma of 0 or less is the identity."""
    keys = keys or [k for k in KEYS if k in df.columns]
    if sigma <= 0:
        return df
    base = df.select(*keys, "x", "y", value)
    return _along(_along(base, "x", "y", value, kernel(sigma), keys), "y", "x", value, kernel(sigma), keys)


def dog_edges(df: DataFrame, small: float, large: float, threshold: float, value: str = "d") -> DataFrame:
    """1 where the finer blur is over the coarser one by more than the threshold."""
    lo, hi = sorted((small, large))
    keys = [k for k in KEYS if k in df.columns]
    a, b = gaussian(df, lo, value).withColumnRenamed(value, "_fine"), gaussian(df, hi, value).withColumnRenamed(value, "_coarse")
    return a.join(b, [*keys, "x", "y"]).select(*keys, "x", "y", F.when(F.col("_fine") - F.col("_coarse") > threshold, 1.0).otherwise(0.0).alias(value))


def gradients(df: DataFrame, value: str = "d") -> DataFrame:
    """Central differences gx and gy; border pixels take their nearest inner pixel's. Images under 3 x 3 give no rows."""
    keys = [k for k in KEYS if k in df.columns]
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    diff = lambda w: (F.lead(value).over(w) - F.lag(value).over(w)) / 2
    inner = df.select(*keys, "x", "y", diff(row).alias("gx"), diff(col).alias("gy")).where(F.col("gx").isNotNull() & F.col("gy").isNotNull())
    sizes = df.groupBy(*keys).agg(F.max("x").alias("_mx"), F.max("y").alias("_my")).where("_mx >= 2 and _my >= 2")
    inside = lambda c, m: F.greatest(F.least(F.col(c), F.col(m) - 1), F.lit(1))
    every = df.select(*keys, "x", "y").join(sizes, keys).withColumn("_x", inside("x", "_mx")).withColumn("_y", inside("y", "_my"))
    return every.join(inner.withColumnsRenamed({"x": "_x", "y": "_y"}), [*keys, "_x", "_y"]).select(*keys, "x", "y", "gx", "gy")


def orientation(df: DataFrame, sigma: float, bins: int, value: str = "d") -> DataFrame:
    """theta of the blurred structure tensor, and its bin of as many equal parts of half a turn."""
    bins = min(max(bins, 1), 24)
    g = gradients(df, value)
    keys = [k for k in KEYS if k in df.columns]
    parts = [gaussian(g.withColumn(n, e), sigma, n) for n, e in (("jxx", F.col("gx") * F.col("gx")), ("jxy", F.col("gx") * F.col("gy")), ("jyy", F.col("gy") * F.col("gy")))]
    j = parts[0].join(parts[1], [*keys, "x", "y"]).join(parts[2], [*keys, "x", "y"])
    theta = 0.5 * F.atan2(2 * F.col("jxy"), F.col("jxx") - F.col("jyy"))
    part = F.floor(F.pmod(theta / math.pi, F.lit(1.0)) * bins).cast("int")
    return j.select(*keys, "x", "y", theta.alias("theta"), F.least(F.coalesce(F.when(F.isnan(theta), 0).otherwise(part), F.lit(0)), F.lit(bins - 1)).alias("bin"))


def max_filter(df: DataFrame, value: str, radius: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Largest value in the square around each pixel, clipped at the borders."""
    keys = keys or [k for k in (*KEYS, "layer") if k in df.columns]
    row = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-radius, radius)
    return df.withColumn("_m", F.max(value).over(row)).withColumn("ridge", F.max("_m").over(col)).drop("_m")


FAR = 65531


def chamfer(keep: np.ndarray) -> np.ndarray:
    """3-4 distance to the nearest cut pixel (1 pixel is 3); rows in sequence, each row at once."""
    h, w = keep.shape
    d = np.where(keep, FAR, 0).astype(np.int64)
    ramp = 3 * np.arange(w)
    for lines, side in ((range(h), -1), (range(h - 1, -1, -1), 1)):
        for y in lines:
            row = d[y]
            if 0 <= y + side < h:
                up = d[y + side]
                row = np.minimum(row, up + 3)
                row[1:] = np.minimum(row[1:], up[:-1] + 4)
                row[:-1] = np.minimum(row[:-1], up[1:] + 4)
            row = np.minimum.accumulate(row - ramp) + ramp
            d[y] = (np.minimum.accumulate((row + ramp)[::-1])[::-1]) - ramp
    return np.minimum(d, FAR)


def distance(mask: DataFrame, keys: list[str]) -> DataFrame:
    """dist of every pixel of masks (keep: boolean); an image is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        keep = np.zeros((h, w), bool)
        keep[pdf["y"], pdf["x"]] = pdf["keep"]
        return pdf.assign(dist=chamfer(keep)[pdf["y"], pdf["x"]].astype("int32"))

    used = mask.select(*keys, "x", "y", "keep")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema) + ", dist int"
    return used.groupBy(*keys).applyInPandas(run, schema)


def stiffness(mask: DataFrame, keys: list[str]) -> DataFrame:
    """removed: share cut; neck_px: twice the lower twentieth of the ridge distances, less half a pixel a side."""
    ridge = max_filter(distance(mask, keys), "dist", 3, keys)
    capped = F.least(F.col("ridge"), F.lit(511))
    p05 = F.expr("percentile_disc(0.05) within group (order by least(ridge, 511)) filter (where keep)")
    out = ridge.withColumn("_c", capped).groupBy(*keys).agg((F.sum(F.when(~F.col("keep"), 1).otherwise(0)) / F.count("*")).alias("removed"), p05.alias("_p"))
    return out.select(*keys, "removed", F.coalesce(2 * F.greatest(F.col("_p") / 3.0 - 0.5, F.lit(0.0)), F.lit(0.0)).alias("neck_px"))


def auto_levels(df: DataFrame, low: float = 0.005, high: float = 0.995, value: str = "d", keys: list[str] | None = None, bins: int = 4096) -> DataFrame:
    """white and black points: exact ranks of the sorted values, (0, 1) where they meet.

    Counts by bin, pre-aggregated, tell which bins hold the two ranks; only those bins' different values are put in order.
    """
    keys = keys or [k for k in KEYS if k in df.columns]
    part = F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    base = df.select(*keys, F.col(value).alias("_v"), part.alias("_bin"))
    counts = base.groupBy(*keys, "_bin").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin"))
    ranks = counts.select(*keys, "_bin", (upto - F.col("_k")).alias("_from"), upto.alias("_to"), F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"))
    rank = lambda p: F.round(p * (F.col("_n") - 1)) + 1
    inside = lambda p: (rank(p) > F.col("_from")) & (rank(p) <= F.col("_to"))
    wanted = ranks.where(inside(low) | inside(high))
    own = base.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_from", "_n", "_v").agg(F.count("*").alias("_k"))
    place = F.col("_from") + F.sum("_k").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ordered = own.withColumn("_last", place).withColumn("_first", place - F.col("_k") + 1)
    at = lambda p: F.max(F.when((rank(p) >= F.col("_first")) & (rank(p) <= F.col("_last")), F.col("_v")))
    out = ordered.groupBy(*keys).agg(at(low).alias("_w"), at(high).alias("_b"))
    ok = F.col("_w") < F.col("_b")
    return out.select(*keys, F.when(ok, F.col("_w")).otherwise(0.0).alias("white"), F.when(ok, F.col("_b")).otherwise(1.0).alias("black"))
