"""Tone curves and cut widths as Column expressions. Identities are left out of the plan where parameters say so."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import LineParams
from .color import clamp

GOLDEN = 0.618034


def levels(i: Column, white: Column | float, black: Column | float, gamma: float = 1.0) -> Column:
    """Stretch between white and black points; a hard threshold where they meet or cross."""
    if not isinstance(white, Column) and not isinstance(black, Column):
        if (white, black, gamma) == (0.0, 1.0, 1.0):
            return clamp(i)
        if black <= white:
            return F.when(i >= white, 1.0).otherwise(0.0)
    wp, bp = (x if isinstance(x, Column) else F.lit(float(x)) for x in (white, black))
    t = clamp((i - wp) / (bp - wp))
    return F.when(bp <= wp, F.when(i >= wp, 1.0).otherwise(0.0)).otherwise(t if gamma == 1.0 else F.pow(t, F.lit(1.0 / gamma)))


def byte_levels(ch: Column, white: float, black: float, gamma: float) -> Column:
    """levels() of the ink in an 8-bit channel."""
    if (white, black, gamma) == (0.0, 1.0, 1.0) or white >= black:
        return ch
    return F.round(clamp(1 - levels(1 - ch / 255.0, white, black, gamma)) * 255).cast("int")


def scurve(d: Column, k: float) -> Column:
    if k <= 0:
        return d
    s = lambda x: 1 / (1 + math.exp(-k * (x - 0.5)))
    return clamp((1 / (1 + F.exp(-k * (d - 0.5))) - s(0.0)) / (s(1.0) - s(0.0)))


def tone(d: Column, p: LineParams, white: Column | None = None, black: Column | None = None) -> Column:
    return scurve(levels(d, p.white if white is None else white, p.black if black is None else black, p.gamma), p.scurve)


def cut_extent(d: Column, p: LineParams, max_cut: Column | float, load: Column | float = 1.0) -> Column:
    """Width to cut: nothing under the least width, else less the kerf and within the cap."""
    raw = d * p.spacing * load
    cap = max_cut if isinstance(max_cut, Column) else F.lit(float(max_cut))
    return F.when(raw < p.w_min, 0.0).otherwise(F.greatest(F.least(raw - p.kerf, cap), F.lit(0.0)))


def deep_clip(d: Column, threshold: float, gamma: float) -> Column:
    if threshold >= 1:
        return F.lit(0.0)
    return F.when(d < threshold, 0.0).otherwise(F.pow(clamp((d - threshold) / (1 - threshold)), F.lit(float(gamma))))


def effective_k(k: Column, others: list[Column], p: LineParams) -> Column:
    """Black less the grey that the other inks make already, clipped to the deep tones."""
    grey = F.lit(0.0) if not others else others[0] if len(others) == 1 else F.least(*others)
    return deep_clip(F.greatest(k - grey * p.ucr, F.lit(0.0)), p.k_deep_clip, p.k_gamma)


def bridge_phase(li: Column, interval: float) -> Column:
    return F.pmod(li * GOLDEN, F.lit(1.0)) * interval


def stiffness_band(neck: Column) -> Column:
    return F.when(neck >= 2, "ok").when(neck >= 1, "thin").otherwise("fragile")
