"""The two pipelines: halftone (images to ink ribbons) and stencil (images to flat, tied, traced layers)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tone
from ..functions.color import hex_colour
from ..operators import fill, filters, quantize, regions, screens, smooth, svg
from ..params import Ink, LineParams, StencilParams
from ..sources.rasters import densities
from ..sources.scratch import materialise


@dataclass
class Halftone:
    ribbons: DataFrame
    cut: DataFrame
    preview: DataFrame
    stiffness: DataFrame
    sheets: DataFrame


def halftone(pixels: DataFrame, p: LineParams, set_: list[Ink], paper: str | None = None, margin: float = 10.0) -> Halftone:
    """Screens once: ribbons and cut pixels are written to the shared folder and shared by the sheets, the preview and the report.

    stiffness has a row an image and ink, with the number of its ribbons.
    """
    density = densities(pixels, set_)
    ribbons = materialise(screens.screen(density, p, set_), "ribbons")
    inks = screens.ink_table(pixels.sparkSession, set_)
    label = F.format_string(f"%s %d/{len(set_)}", F.upper("name"), F.col("ord") + 1)
    shade = hex_colour(*(F.floor(F.col("rgb")[i] * 255).cast("int") for i in range(3)))
    frame = screens.sizes(density).join(F.broadcast(inks.select("channel", label.alias("label"), shade.alias("fill"))), "channel")
    cut = materialise(fill.fill(ribbons, frame), "cut")
    grid = pixels.select("image_id", "x", "y")
    masks = fill.masks(cut, grid, [i.channel for i in set_])
    counts = ribbons.groupBy("image_id", "channel").agg(F.count("*").alias("n_ribbons"))
    report = filters.stiffness(masks, ["image_id", "channel"]).withColumn("band", tone.stiffness_band(F.col("neck_px"))).join(counts, ["image_id", "channel"], "left").fillna(0, ["n_ribbons"])
    return Halftone(ribbons, cut, fill.composite(cut, inks, grid), report, svg.ribbons_svg(ribbons, frame, ["image_id", "channel"], paper, margin, 2.0, p.min_material))


@dataclass
class Stencil:
    palette: DataFrame
    masks: DataFrame
    rings: DataFrame
    preview: DataFrame
    sheets: DataFrame
    report: DataFrame


def prepared(pixels8: DataFrame, p: StencilParams) -> DataFrame:
    """Blur, then levels, of 8-bit channels."""
    out = pixels8
    if p.blur_px > 0:
        parts = [filters.gaussian(pixels8.select("image_id", "x", "y", F.col(c).cast("double").alias(c)), p.blur_px, c, ["image_id"]) for c in "rgb"]
        out = parts[0].join(parts[1], ["image_id", "x", "y"]).join(parts[2], ["image_id", "x", "y"])
        out = out.select("image_id", "x", "y", *(F.round(c).cast("int").alias(c) for c in "rgb"))
    return out.select("image_id", "x", "y", *(tone.byte_levels(F.col(c), p.white, p.black, p.gamma).alias(c) for c in "rgb"))


def stencil(pixels8: DataFrame, p: StencilParams) -> Stencil:
    """report has a row an image and layer: pixels kept, outer rings and holes. Layers that keep nothing have blank sheets."""
    p.validate()
    px = materialise(prepared(pixels8, p), "prepared")
    palette = materialise(quantize.palette(px, p.colors), "palette")
    labels = materialise(regions.merge_small_regions(quantize.labels(px, palette), p.min_feature_px, ["image_id"]), "labels")
    masks = regions.stack_masks(labels, list(range(p.colors)))
    if p.bridges:
        masks = regions.bridge_islands(masks, p.bridge_px, ["image_id", "layer"]).drop("warnings")
    masks = materialise(masks, "masks")
    rings = materialise(regions.rings(masks, ["image_id", "layer"], p.min_feature_px), "rings")
    layers = palette.select("image_id", F.col("label").alias("layer"), hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("fill"))
    frame = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).join(layers, "image_id")
    curves = rings.withColumn("curve", smooth.curve(F.col("pts"), p.smooth))
    kept = masks.groupBy("image_id", "layer").agg(F.sum(F.col("keep").cast("long")).alias("n_kept"))
    kinds = rings.groupBy("image_id", "layer").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}s") for k in ("outer", "hole")))
    report = kept.join(kinds, ["image_id", "layer"], "left").fillna(0, ["n_outers", "n_holes"])
    return Stencil(palette, masks, rings, fill.stencil_preview(masks, palette, px.select("image_id", "x", "y")), svg.polygons_svg(curves, frame, ["image_id", "layer"]), report)
