"""Colour arithmetic as Column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def clamp(x: C, low: float = 0.0, high: float = 1.0) -> C:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def cmyk(r: C, g: C, b: C) -> dict[str, C]:
    """Black is what all three channels lack; the other inks are shares of the rest."""
    top = F.greatest(r, g, b)
    share = lambda v: F.when(top <= 0, F.lit(0.0)).otherwise((top - v) / top)
    return {"c": share(r), "m": share(g), "y": share(b), "k": 1 - top}


def rgb(c: C, m: C, y: C, k: C) -> dict[str, C]:
    return {n: (1 - v) * (1 - k) for n, v in (("r", c), ("g", m), ("b", y))}


def to_byte(x: C) -> C:
    return F.round(clamp(x) * 255).cast("int")


def snapped(r8: C, g8: C, b8: C) -> dict[str, C]:
    """8-bit colours after a round trip through inks, with the inks."""
    inks = cmyk(r8 / 255.0, g8 / 255.0, b8 / 255.0)
    return {**{n: to_byte(v) for n, v in rgb(**inks).items()}, **inks}


def split_extended(c: C, m: C, y: C) -> dict[str, C]:
    """Orange and green taken out of the three inks, both from the original values."""
    o = F.greatest(F.least(m, y) - c, F.lit(0.0))
    g = F.greatest(F.least(c, y) - m, F.lit(0.0))
    none = lambda x: F.greatest(x, F.lit(0.0))
    return {"c": none(c - g), "m": none(m - o), "y": none(y - o - g), "o": o, "g": g}


def luma(r: C, g: C, b: C) -> C:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def lab(r: C, g: C, b: C) -> dict[str, C]:
    """CIE Lab under D65 of sRGB in [0, 1]."""
    lin = [F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))) for v in (r, g, b)]
    # fixed values: sRGB to XYZ, divided by the white point
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0) for t in ((lin[0] * p + lin[1] * q + lin[2] * s) / w for p, q, s, w in rows))
    return {"L": 116 * fy - 16, "a": 500 * (fx - fy), "b_": 200 * (fy - fz)}


def hex_colour(r8: C, g8: C, b8: C) -> C:
    return F.format_string("#%02x%02x%02x", r8, g8, b8)


def ink_text(c: C, m: C, y: C, k: C) -> C:
    return F.concat_ws(" ", *(F.concat(F.lit(n), F.round(v * 100).cast("int").cast("string")) for n, v in zip("CMYK", (c, m, y, k))))
