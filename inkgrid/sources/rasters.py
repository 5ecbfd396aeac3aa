"""Rasters as DataFrames keyed by (image_id, x, y): from tables, from image files and from formulas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..params import Ink

SIDE = 64


def raster_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64 x 64 image for each 1500 orders of lineitem; cells without rows are white.

    A cell's values are added in the order of the files and of their rows: sums of doubles depend on the order to the last bit, which
    thresholds and ties show, and merged partial sums come in any order.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = [F.col(c).alias(n) for n, c in (("f", "_metadata.file_name"), ("i", "_metadata.row_index"))]
    at = F.floor(F.col("l_orderkey") / 1500).cast("int").alias("image_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"), (F.col("l_partkey") % SIDE).cast("int").alias("y")
    rows = item.select(*at, F.struct(*place, "l_quantity", "l_discount", "l_tax").alias("_s")).groupBy("image_id", "x", "y").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    cell = rows.select("image_id", "x", "y", (_mean("l_quantity") / 50).alias("r"), (_mean("l_discount") / 0.1).alias("g"), (_mean("l_tax") / 0.08).alias("b"))
    images = cell.select("image_id").distinct()  # of the cells, so the table is read and shuffled once
    dense = grid(images.withColumn("w", F.lit(SIDE)).withColumn("h", F.lit(SIDE)))
    return dense.join(cell, ["image_id", "x", "y"], "left").fillna(1.0, ["r", "g", "b"])


def _mean(name: str) -> Column:
    """The mean of a field of the structs in _s, added from left to right; null without values."""
    got = F.filter(F.transform("_s", lambda v: v[name].cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, v: a + v) / F.size(got))


def grid(sizes: DataFrame) -> DataFrame:
    """image_id, x, y of every pixel of images with w and h: generated, not joined."""
    return sizes.select("image_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("image_id", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), "y")


def raster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one image: a row for each vector, scaled to [0, 1] over the table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    lo, hi = e.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    lo, hi = (0.0, 1.0) if lo is None else (lo, hi)
    return e.select(F.lit(0).alias("image_id"), F.lit("k").alias("channel"), "x", "y", ((F.col("v").cast("double") - lo) / (hi - lo)).alias("d"))


def analytic(spark: SparkSession, w: int, h: int, d, channel: str = "k", image_id: int = 0) -> DataFrame:
    """A density map by a formula of columns x and y."""
    at = grid(spark.range(1).select(F.lit(image_id).alias("image_id"), F.lit(w).alias("w"), F.lit(h).alias("h")))
    return at.select("image_id", F.lit(channel).alias("channel"), "x", "y", (d(F.col("x"), F.col("y")) + F.lit(0.0)).alias("d"))


def separated(pixels: DataFrame, kind: str = "cmyk") -> DataFrame:
    """Pixels with an ink column each."""
    inks = color.cmyk(F.col("r"), F.col("g"), F.col("b"))
    out = pixels.select("image_id", "x", "y", *(v.alias(k) for k, v in inks.items()))
    if kind == "cmykog":
        split = color.split_extended(F.col("c"), F.col("m"), F.col("y"))
        out = pixels.select("image_id", "x", F.col("y").alias("py"), *(v.alias(k) for k, v in inks.items()))
        return out.select("image_id", "x", F.col("py").alias("y_"), *(v.alias(f"d_{k}") for k, v in split.items()), F.col("k").alias("d_k"))
    return pixels.select("image_id", "x", F.col("y").alias("y_"), *(v.alias(f"d_{k}") for k, v in inks.items()))


def densities(pixels: DataFrame, set_: list[Ink]) -> DataFrame:
    """Long form: image_id, channel, x, y, d. The yellow ink and the row share a name only inside."""
    wide = separated(pixels, "cmykog" if any(i.channel == "o" for i in set_) else "cmyk")
    pairs = ", ".join(f"'{i.channel}', d_{i.channel}" for i in set_)
    return wide.selectExpr("image_id", "x", "y_ as y", f"stack({len(set_)}, {pairs}) as (channel, d)").select("image_id", "channel", "x", "y", "d")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Widths and heights without decoding pixels into rows."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("image_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files in [0, 1]. The reader knows png, jpg, bmp and gif; its bytes are BGR."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                w, h, n = row["width"], row["height"], row["nChannels"]
                a = np.frombuffer(row["data"], np.uint8).reshape(h, w, n)
                bgr = a[..., :3] if n >= 3 else np.repeat(a, 3, 2)
                y, x = np.divmod(np.arange(w * h), w)
                for k in range(0, w * h, 1 << 16):
                    s = slice(k, k + (1 << 16))
                    part = bgr.reshape(-1, 3)[s] / 255.0
                    yield pa.RecordBatch.from_arrays([pa.array([row["origin"]] * len(part)), pa.array(x[s].astype(np.int32)), pa.array(y[s].astype(np.int32)), *(pa.array(part[:, c]) for c in (2, 1, 0))], names=["image_id", "x", "y", "r", "g", "b"])

    return spark.read.format("image").load(path).select("image.*").mapInArrow(run, "image_id string, x int, y int, r double, g double, b double")
