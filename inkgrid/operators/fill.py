"""Scanline fill, ink composites and stencil previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill(ribbons: DataFrame, frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pixels inside closed polygons by the even-odd rule, each once a key. frame: keys, w and h.

    An edge crosses a row of pixel centres; crossings are paired in order along the row; a pair covers whole pixels.
    """
    keys = keys or ["image_id", "channel"]
    n = F.size("pts")
    edges = ribbons.where(n >= 3).select(*keys, "ribbon_id", "pts", F.posexplode("pts").alias("k", "a")).withColumn("b", F.element_at("pts", (F.pmod(F.col("k") + 1, n) + 1).cast("int"))).drop("pts")
    edges = edges.join(frame, keys)
    low, high = F.least(F.col("a.y"), F.col("b.y")), F.greatest(F.col("a.y"), F.col("b.y"))
    # centres py + 0.5 with low <= centre < high: one end counts, as with the other edge at that corner
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(high - 0.5) - 1, F.col("h") - 1).cast("int")
    rows = edges.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").select(*keys, "ribbon_id", "w", "a", "b", F.explode(F.sequence("_f", "_l")).alias("y"))
    x = F.col("a.x") + (F.col("y") + 0.5 - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x"))
    w = Window.partitionBy(*keys, "ribbon_id", "y").orderBy("cross")
    paired = rows.select(*keys, "ribbon_id", "y", "w", x.alias("cross")).withColumn("rn", F.row_number().over(w)).withColumn("to", F.lead("cross").over(w)).where("rn % 2 = 1 and to is not null")
    span = paired.withColumn("_a", F.greatest(F.ceil("cross"), F.lit(0)).cast("int")).withColumn("_b", F.least(F.floor("to"), F.col("w") - 1).cast("int")).where("_a <= _b")
    return span.select(*keys, "y", F.explode(F.sequence("_a", "_b")).alias("x")).distinct()


def composite(cut: DataFrame, inks: DataFrame, grid: DataFrame) -> DataFrame:
    """White times the colours of all inks that cover a pixel, as truncated bytes; every pixel of the grid."""
    hit = cut.join(F.broadcast(inks.select("channel", "rgb")), "channel")
    mixed = hit.groupBy("image_id", "x", "y").agg(*(F.product(F.col("rgb")[i]).alias(c) for i, c in enumerate("rgb")))
    return grid.join(mixed, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *(F.floor(F.coalesce(c, F.lit(1.0)) * 255 + 1e-9).cast("int").alias(c) for c in "rgb"))


def masks(cut: DataFrame, grid: DataFrame, channels: list[str]) -> DataFrame:
    """keep of every pixel for each channel: what is not cut."""
    every = grid.select("*", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    return every.join(cut.select("image_id", "channel", "x", "y", F.lit(True).alias("_cut")), ["image_id", "channel", "x", "y"], "left").select("image_id", "channel", "x", "y", F.col("_cut").isNull().alias("keep"))


def stencil_preview(kept: DataFrame, palette: DataFrame, grid: DataFrame) -> DataFrame:
    """Palette colour of the last layer that keeps a pixel, over white."""
    top = kept.where("keep").groupBy("image_id", "x", "y").agg(F.max("layer").alias("label"))
    return grid.join(top, ["image_id", "x", "y"], "left").join(palette.select("image_id", "label", "r", "g", "b"), ["image_id", "label"], "left").select("image_id", "x", "y", *(F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"))
