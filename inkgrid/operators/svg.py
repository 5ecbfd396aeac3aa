"""SVG text of ribbons and curves, as expressions; a document is one row a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import paper


def fit(name: str, margin: float, w: Column, h: Column) -> dict[str, Column]:
    """A paper turned like the image, with the scale and offsets that centre it inside the margin."""
    a, b = paper(name)
    wide = w > h
    pw, ph = F.when(wide, max(a, b)).otherwise(min(a, b)), F.when(wide, min(a, b)).otherwise(max(a, b))
    m = F.least(F.lit(max(margin, 0.0)), F.least(pw, ph) / 2 - 1)
    scale = F.least((pw - 2 * m) / w, (ph - 2 * m) / h)
    return {"paper_w": pw, "paper_h": ph, "scale": scale, "off_x": (pw - w * scale) / 2, "off_y": (ph - h * scale) / 2, "art_w": w * scale, "art_h": h * scale}


def _p(x: Column, y: Column) -> Column:
    return F.format_string("%.3f %.3f", x, y)


def path_of_points(pts: Column) -> Column:
    return F.concat(F.lit("M"), F.array_join(F.transform(pts, lambda p: _p(p["x"], p["y"])), " L"), F.lit(" Z"))


def path_of_curve(c: Column) -> Column:
    seg = lambda s: F.concat(F.lit(" C"), _p(s["c1"]["x"], s["c1"]["y"]), F.lit(" "), _p(s["c2"]["x"], s["c2"]["y"]), F.lit(" "), _p(s["p"]["x"], s["p"]["y"]))
    return F.concat(F.lit("M"), _p(c["start"]["x"], c["start"]["y"]), F.array_join(F.transform(c["segs"], seg), ""), F.lit(" Z"))


def registration_marks(w: Column, h: Column, mark: float) -> Column:
    """Plus signs at three corners."""
    m = max(mark, 1.0)
    plus = lambda x, y: F.concat(F.lit('<path stroke="red" fill="none" d="M'), _p(x - m, y), F.lit(" L"), _p(x + m, y), F.lit(" M"), _p(x, y - m), F.lit(" L"), _p(x, y + m), F.lit('"/>'))
    z = F.lit(0.0)
    return F.concat(plus(z, z), plus(w + 0.0, z), plus(z, h + 0.0))


def paper_marks(pw: Column, ph: Column, inset: Column, hole: Column, label: Column) -> Column:
    """A crosshair and a hole at each corner, and the sheet's name."""

    def one(x: Column, y: Column) -> Column:
        cross = F.concat(F.lit('<path stroke="red" fill="none" d="M'), _p(x - hole, y), F.lit(" L"), _p(x + hole, y), F.lit(" M"), _p(x, y - hole), F.lit(" L"), _p(x, y + hole), F.lit('"/>'))
        return F.concat(cross, F.format_string('<circle cx="%.3f" cy="%.3f" r="%.3f" fill="none" stroke="red"/>', x, y, hole))

    corners = [one(x, y) for x in (inset, pw - inset) for y in (inset, ph - inset)]
    return F.concat(*corners, F.format_string('<text x="%.3f" y="%.3f" font-size="4">%s</text>', inset * 2, ph - inset, label))


def _joined(df: DataFrame, keys: list[str], order: list[str], path: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, path.alias("_d")))), lambda s: s["_d"]), " ").alias("d"))


def ribbons_svg(ribbons: DataFrame, frame: DataFrame, keys: list[str], paper_name: str | None = None, margin: float = 10.0, hole: float = 3.0, min_material: float | None = None) -> DataFrame:
    """One document a sheet: millimetres with punch holes on a paper, else pixels with registration marks. Sheets without ribbons are blank.

    frame has the keys, w and h, and may have fill (a colour) and label. With min_material given (in pixels) holes are at least that wide on
    the paper, and at least 2 mm in radius.
    """
    paths = frame.join(_joined(ribbons, keys, ["ribbon_id"], path_of_points(F.col("pts"))), keys, "left").withColumn("d", F.coalesce("d", F.lit("")))
    colour = F.col("fill") if "fill" in frame.columns else F.lit("black")
    label = F.col("label") if "label" in frame.columns else F.concat_ws(" ", *keys)
    body = F.concat(F.lit('<path fill="'), colour, F.lit('" fill-rule="evenodd" d="'), F.col("d"), F.lit('"/>'))
    if paper_name is None:
        head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%dpx" height="%dpx" viewBox="0 0 %d %d">', "w", "h", "w", "h")
        return paths.select(*keys, F.concat(head, body, registration_marks(F.col("w"), F.col("h"), 5.0), F.lit("</svg>")).alias("svg"))
    lay = fit(paper_name, margin, F.col("w"), F.col("h"))
    radius = F.lit(float(hole)) if min_material is None else F.greatest(lay["scale"] * min_material, F.lit(2.0))
    gap = (F.least(lay["paper_w"], lay["paper_h"]) - F.least(lay["art_w"], lay["art_h"])) / 4
    inset = F.least(F.greatest(radius + gap, radius + 2.0), F.greatest(F.lit(12.0), radius + 2.0))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.3fmm" height="%.3fmm" viewBox="0 0 %.3f %.3f">', lay["paper_w"], lay["paper_h"], lay["paper_w"], lay["paper_h"])
    moved = F.concat(F.format_string('<g transform="translate(%.3f %.3f) scale(%.6f)">', lay["off_x"], lay["off_y"], lay["scale"]), body, F.lit("</g>"))
    return paths.select(*keys, F.concat(head, moved, paper_marks(lay["paper_w"], lay["paper_h"], inset, radius, label), F.lit("</svg>")).alias("svg"))


def polygons_svg(curves: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """One even-odd path a sheet, outers before holes, from rings with kind and curve; frame may have fill (a colour)."""
    good = curves.where(F.col("curve").isNotNull()).withColumn("_k", F.when(F.col("kind") == "outer", 0).otherwise(1))
    paths = frame.join(_joined(good, keys, ["_k", "ring_id"], path_of_curve(F.col("curve"))), keys, "left").withColumn("d", F.coalesce("d", F.lit("")))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%dpx" height="%dpx" viewBox="0 0 %d %d">', "w", "h", "w", "h")
    colour = F.concat(F.lit(' fill="'), F.col("fill"), F.lit('"')) if "fill" in frame.columns else F.lit("")
    return paths.select(*keys, F.concat(head, F.lit("<path"), colour, F.lit(' fill-rule="evenodd" d="'), F.col("d"), F.lit('"/></svg>')).alias("svg"))
