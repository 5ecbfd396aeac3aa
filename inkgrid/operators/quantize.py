"""Flat colours: k-means in Lab from fixed seeds, snapped palettes, nearest colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..sources.scratch import materialise

LAB = ("L", "a", "b_")


def colours(pixels: DataFrame) -> DataFrame:
    """Distinct 8-bit colours of each image with their counts, the first pixel that has one, and Lab."""
    c = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("_first"))
    return c.select("*", *(v.alias(k) for k, v in color.lab(F.col("r") / 255.0, F.col("g") / 255.0, F.col("b") / 255.0).items()))


def seeds(cols: DataFrame, k: int) -> DataFrame:
    """The pixels at k even ranks of all pixels in order of L; a colour counts as often as it occurs."""
    w = Window.partitionBy("image_id").orderBy("L", "_first")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = cols.withColumn("_to", upto).withColumn("_total", F.sum("n").over(Window.partitionBy("image_id")))
    m = F.least(F.lit(k), F.col("_total")).cast("int")
    at = ranked.withColumn("_m", m).withColumn("label", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    rank = F.floor(F.col("label") * (F.col("_total") - 1) / F.col("_m"))
    return at.where((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("n"))).select("image_id", "label", *LAB)


def nearest(cols: DataFrame, centres: DataFrame | list[tuple[int, float, float, float]], keep: list[str]) -> DataFrame:
    """keep and the label of the nearest centre of the same image, the first of equals; a list holds centres for all images.

    An image has at most 256 centres: they are gathered into one row an image, so that the pair of colour and centre never becomes a row.
    """
    if isinstance(centres, list):
        few = F.array(*(F.struct(F.lit(i).alias("label"), *(F.lit(float(v)).alias(k) for k, v in zip(LAB, lab))) for i, *lab in centres))
        cols = cols.withColumn("_c", few)
    else:
        cols = cols.join(centres.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", *LAB))).alias("_c")), "image_id")
    far = lambda c: sum(((F.col(k) - c[k]) * (F.col(k) - c[k]) for k in LAB[1:]), (F.col("L") - c["L"]) * (F.col("L") - c["L"]))
    best = F.array_min(F.transform("_c", lambda c: F.struct(far(c).alias("d"), c["label"].alias("label"))))
    return cols.select("image_id", *keep, best["label"].alias("label"))


def lloyd_step(cols: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres after one assignment and update; a centre without colours stays."""
    got = nearest(cols, centres, ["n", *LAB])
    mean = got.groupBy("image_id", "label").agg(*((F.sum(F.col(k) * F.col("n")) / F.sum("n")).alias(f"_{k}") for k in LAB))
    return centres.join(mean, ["image_id", "label"], "left").select("image_id", "label", *(F.coalesce(f"_{k}", k).alias(k) for k in LAB))


def kmeans(cols: DataFrame, k: int, rounds: int = 20, eps: float = 1e-4) -> DataFrame:
    """Lloyd's rounds until no centre moves. Works on distinct colours; each round's centres (k an image) are cut from the lineage."""
    cols = materialise(cols, "colours")
    now = materialise(seeds(cols, k), "centres")
    for _ in range(rounds):
        after = materialise(lloyd_step(cols, now), "centres")
        moved = after.alias("p").join(now.alias("q"), ["image_id", "label"]).where(sum((F.pow(F.col(f"p.{c}") - F.col(f"q.{c}"), 2) for c in LAB), F.lit(0.0)) > eps).limit(1).count()
        now = after
        if not moved:
            break
    return now


def palette(pixels: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """Colours of each image, dark to light: label, snapped r, g, b, inks, Lab. Empty clusters are black."""
    cols = colours(pixels)
    centres = kmeans(cols, k, rounds)
    got = nearest(cols, centres, ["r", "g", "b", "n"])
    mean = got.groupBy("image_id", "label").agg(*(F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c) for c in "rgb"))
    every = centres.select("image_id", "label").join(mean, ["image_id", "label"], "left").fillna(0, ["r", "g", "b"])
    snap = color.snapped(F.col("r"), F.col("g"), F.col("b"))
    s = every.select("image_id", F.col("label").alias("_l"), *(snap[c].alias(c) for c in "rgb"), *(snap[c].alias(f"ink_{c}") for c in "cmyk"))
    order = Window.partitionBy("image_id").orderBy(color.luma(F.col("r").cast("double"), F.col("g").cast("double"), F.col("b").cast("double")), "_l")
    lab = color.lab(F.col("r") / 255.0, F.col("g") / 255.0, F.col("b") / 255.0)
    return s.select("image_id", (F.row_number().over(order) - 1).alias("label"), "r", "g", "b", *(f"ink_{c}" for c in "cmyk"), *(v.alias(n) for n, v in lab.items()))


def labels(pixels: DataFrame, pal: DataFrame) -> DataFrame:
    """label of every pixel: decided for each distinct colour, joined back by colour."""
    cols = colours(pixels)
    of = nearest(cols, pal.select("image_id", "label", *LAB), ["r", "g", "b"])
    return pixels.join(of, ["image_id", "r", "g", "b"]).select("image_id", "x", "y", "label")
