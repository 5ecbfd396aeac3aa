"""Screens: density maps to closed polygons (ribbons). Samples are generated from sequences, looked up by an equi-join and
joined to runs by a window; only blue noise and the order of hatch bins are sequential."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import clamp
from ..functions.tone import GOLDEN, bridge_phase, cut_extent, effective_k, tone
from ..params import Ink, LineParams
from ..sources.scratch import materialise
from .filters import auto_levels, dog_edges, kernel, taken

KEYS = ["image_id", "channel"]
POINTS = "array<struct<x:double,y:double>>"


def sizes(density: DataFrame) -> DataFrame:
    return density.groupBy(*KEYS).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def ink_table(spark: SparkSession, set_: list[Ink]) -> DataFrame:
    """At most a handful of rows; broadcast wherever it is joined."""
    rows = [(n, i.channel, i.name, list(i.rgb), i.angle, i.load, i.tamed) for n, i in enumerate(set_)]
    return spark.createDataFrame(rows, "ord int, channel string, name string, rgb array<double>, angle double, load double, tamed boolean")


def taps(points: DataFrame) -> DataFrame:
    """points (w, h, px, py, clamped to the raster) with the pixels _tx, _ty that they read and their weights _t over 0: four rows a point at most."""
    x, y = F.greatest(F.least(F.col("px"), F.col("w") - 1.0), F.lit(0.0)), F.greatest(F.least(F.col("py"), F.col("h") - 1.0), F.lit(0.0))
    fx, fy = x - F.floor(x), y - F.floor(y)
    tap = lambda dx, dy: F.struct(
        F.least(F.floor(x) + dx, F.col("w") - 1).cast("int").alias("x"), F.least(F.floor(y) + dy, F.col("h") - 1).cast("int").alias("y"),
        ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("t"),
    )
    every = points.select("*", F.explode(F.array(tap(0, 0), tap(1, 0), tap(0, 1), tap(1, 1))).alias("_s")).where("_s.t > 0")
    return every.select(*points.columns, F.col("_s.x").alias("_tx"), F.col("_s.y").alias("_ty"), F.col("_s.t").alias("_t"))


def sample(points: DataFrame, raster: DataFrame, keys: list[str] | None = None, values: tuple[str, ...] = ("d",)) -> DataFrame:
    """points with bilinear values at px, py (clamped to the raster): four weighted taps a point, one equi-join, one partial sum.

    points needs the keys, w, h, px and py; its columns ride along with the taps, so nothing is joined back. Equal rows are one point.
    """
    keys = keys or KEYS
    at = raster.select(*keys, F.col("x").alias("_tx"), F.col("y").alias("_ty"), *(F.col(v).alias(f"_v_{v}") for v in values))
    return taps(points).join(at, [*keys, "_tx", "_ty"]).groupBy(*points.columns).agg(*(F.sum(F.col("_t") * F.col(f"_v_{v}")).alias(v) for v in values))


def _caps(p: LineParams) -> Column:
    """Largest cut of each ink: loads scale it, waves and the tamed ink have their own bounds."""
    own = F.lit(p.max_cut) * F.col("load")
    if p.shape == "wavy":
        own = F.least(own, F.lit(p.wave_width * p.spacing))
    return F.when(F.col("tamed"), F.lit(max(min(p.k_width_frac * p.spacing, p.spacing - p.min_material), 0.0))).otherwise(own)


def toned(density: DataFrame, p: LineParams, set_: list[Ink], held: bool = True) -> DataFrame:
    """Density maps as the screens read them, with cap and load: tamed inks by grey removal or edges, others by the tone curve."""
    spark = density.sparkSession
    table = ink_table(spark, set_)
    tamed = [i.channel for i in set_ if i.tamed]
    if p.auto_levels or tamed:
        density = materialise(density, "density")  # read several times
    plain = density.where(~F.col("channel").isin(tamed)) if tamed else density
    if p.auto_levels:
        plain = plain.join(auto_levels(plain), KEYS)
        out = plain.select(*KEYS, "x", "y", tone(F.col("d"), p, F.col("white"), F.col("black")).alias("d"))
    else:
        out = plain.select(*KEYS, "x", "y", F.col("d").alias("_d")).select(*KEYS, "x", "y", tone(F.col("_d"), p).alias("d"))
    for k in tamed:
        own = density.where(F.col("channel") == k)
        if p.k_mode == "contour":
            black = dog_edges(own, p.dog_small, p.dog_large, p.dog_threshold)
        else:
            grey = density.where(~F.col("channel").isin(tamed)).groupBy("image_id", "x", "y").agg(F.min("d").alias("_u"))
            black = own.join(grey, ["image_id", "x", "y"], "left").select(*KEYS, "x", "y", effective_k(F.col("d"), [F.coalesce("_u", F.lit(0.0))], p).alias("d"))
        out = out.unionByName(black)
    out = out.join(F.broadcast(table), "channel").select(*KEYS, "x", "y", "d", "angle", F.when(F.col("tamed"), 1.0).otherwise(F.col("load")).alias("load"), _caps(p).alias("cap"))
    # every screen but the hatch reads its maps twice: for their sizes and at its points
    return materialise(out, "toned") if held else out


def _frames(maps: DataFrame) -> DataFrame:
    """One row for each image and ink: size, angle, load and cap."""
    return maps.groupBy(*KEYS).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.first("angle").alias("angle"), F.first("load").alias("load"), F.first("cap").alias("cap"))


def segments(frames: DataFrame, p: LineParams) -> DataFrame:
    """Line li, segment i from v to v_next, and the canvas point px, py of its middle; waves displace it."""
    half = F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) / 2 + p.spacing
    n = F.ceil(half / p.spacing).cast("int")
    count = F.ceil(2 * half / p.v_step).cast("int")
    at = frames.withColumn("half", half).select("*", F.explode(F.sequence(-n, n)).alias("li")).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    v = -F.col("half") + F.col("i") * p.v_step
    at = at.withColumn("v", v).withColumn("v_next", F.least(v + p.v_step, F.col("half"))).where("v < half")
    return placed(at, p, (F.col("v") + F.col("v_next")) / 2, "px", "py")


def placed(df: DataFrame, p: LineParams, v: Column, x: str, y: str) -> DataFrame:
    """Canvas coordinates of distance v along line li."""
    s, c = F.sin(F.radians("angle")), F.cos(F.radians("angle"))
    u = F.col("li") * p.spacing
    if p.shape == "wavy":
        u = u + F.greatest(F.least(F.lit(p.wave_amp * p.spacing), (F.lit(p.spacing) - F.col("cap")) / 2), F.lit(0.0)) * F.sin(2 * math.pi * v / max(p.wave_len * p.spacing, 1.0))
    return df.withColumn(x, F.col("w") / 2 - u * s + v * c).withColumn(y, F.col("h") / 2 + u * c + v * s)


def widths(maps: DataFrame, p: LineParams, proximity: DataFrame | None = None) -> DataFrame:
    """segments() with the half width to cut; 0 outside the canvas and on bridges."""
    seg = segments(_frames(maps), p)
    inside = seg.where((F.col("px") >= 0) & (F.col("px") < F.col("w")) & (F.col("py") >= 0) & (F.col("py") < F.col("h")))
    got = sample(inside, maps)
    hw = cut_extent(F.col("d"), p, F.col("cap"), F.col("load")) / 2
    if p.bridge_interval > 0 and p.bridge_px > 0:
        hw = F.when(F.pmod(F.col("v") - bridge_phase(F.col("li"), p.bridge_interval), F.lit(p.bridge_interval)) < p.bridge_px, 0.0).otherwise(hw)
    got = got.withColumn("hw", hw)
    if proximity is not None:
        near = proximity.select(*KEYS, F.col("x").alias("_x"), F.col("y").alias("_y"), "near")
        got = got.withColumn("_x", F.floor("px").cast("int")).withColumn("_y", F.floor("py").cast("int")).join(near, [*KEYS, "_x", "_y"], "left")
        got = got.withColumn("hw", F.when(F.col("near").isNull(), F.col("hw")).otherwise(F.least(F.col("hw"), F.greatest(F.col("near") - p.min_material - p.v_step - 1, F.lit(0.0)))))
    return got


def runs(cut: DataFrame, p: LineParams) -> DataFrame:
    """Maximal runs of cut segments as knots (px, py, hw): a run's first place, then each segment's end with its width."""
    w = Window.partitionBy(*KEYS, "li").orderBy("i")
    live = cut.where("hw > 0").withColumn("_g", F.col("i") - F.row_number().over(w))
    ends = placed(placed(live, p, F.col("v"), "x0", "y0"), p, F.col("v_next"), "x1", "y1")
    segs = ends.groupBy(*KEYS, "li", "_g").agg(F.array_sort(F.collect_list(F.struct("i", "x0", "y0", "x1", "y1", "hw"))).alias("s"), F.first("angle").alias("angle"))
    knot = lambda x, y, hw: F.struct(x.alias("x"), y.alias("y"), hw.alias("hw"))
    first = F.element_at("s", 1)
    knots = F.concat(F.array(knot(first["x0"], first["y0"], first["hw"])), F.transform("s", lambda a: knot(a["x1"], a["y1"], a["hw"])))
    return segs.select(*KEYS, "li", first["i"].alias("first"), F.size("s").alias("n_segments"), "angle", knots.alias("knots"))


def outline(run: DataFrame, own_normals: bool, id: str | None = None) -> DataFrame:
    """Runs as closed polygons: one edge forward, the other back. Normals are the screen's, or across each knot's neighbours."""
    at = lambda i: F.element_at("knots", (F.greatest(F.least(i, F.size("knots") - 1), F.lit(0)) + 1).cast("int"))

    def edge(side: float):
        def point(a, i):
            if own_normals:
                dx, dy = at(i + 1)["x"] - at(i - 1)["x"], at(i + 1)["y"] - at(i - 1)["y"]
                length = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
                nx, ny = -dy / length, dx / length
            else:
                nx, ny = -F.sin(F.radians("angle")), F.cos(F.radians("angle"))
            return F.struct((a["x"] + side * a["hw"] * nx).alias("x"), (a["y"] + side * a["hw"] * ny).alias("y"))

        return F.transform("knots", point)

    return run.select(*KEYS, (F.col(id) if id else F.xxhash64(*KEYS, "li", "first")).alias("ribbon_id"), F.concat(edge(-1.0), F.reverse(edge(1.0))).alias("pts"))


def dots(maps: DataFrame, p: LineParams) -> DataFrame:
    """Centres cx, cy and radii of a rotated grid of dots."""
    frames = _frames(maps)
    reach = (F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) / 2 + p.spacing) / p.spacing
    n = F.ceil(reach).cast("int")
    at = frames.select("*", F.explode(F.sequence(-n, n)).alias("gi")).select("*", F.explode(F.sequence(-n, n)).alias("gj"))
    s, c = F.sin(F.radians("angle")), F.cos(F.radians("angle"))
    u, v = F.col("gi") * p.spacing, F.col("gj") * p.spacing
    at = at.withColumn("px", F.col("w") / 2 - u * s + v * c).withColumn("py", F.col("h") / 2 + u * c + v * s)
    at = at.where((F.col("px") >= 0) & (F.col("px") < F.col("w")) & (F.col("py") >= 0) & (F.col("py") < F.col("h")))
    got = sample(at, maps)
    return got.select(*KEYS, "gi", "gj", F.col("px").alias("cx"), F.col("py").alias("cy"), (cut_extent(F.col("d"), p, F.col("cap"), F.col("load")) / 2).alias("r")).where("r > 0")


def circles(centres: DataFrame, by: list[str]) -> DataFrame:
    """Dots as polygons of 8 to 48 corners, about 1.5 pixels apart."""
    n = F.greatest(F.least(F.ceil(2 * math.pi * F.col("r") / 1.5), F.lit(48)), F.lit(8)).cast("int")
    turn = lambda k: 2 * math.pi * k / n
    pts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.col("cx") + F.col("r") * F.cos(turn(k))).alias("x"), (F.col("cy") + F.col("r") * F.sin(turn(k))).alias("y")))
    return centres.select(*KEYS, F.xxhash64(*KEYS, *by).alias("ribbon_id"), pts.alias("pts"))


def coarse_tones(maps: DataFrame, p: LineParams) -> DataFrame:
    """Tone at the centre of each cell of the blue-noise grid; too light cells are 0."""
    step = max(p.spacing, 1.0)
    at = _frames(maps).withColumn("nx", F.ceil(F.col("w") / step).cast("int")).withColumn("ny", F.ceil(F.col("h") / step).cast("int"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("gi")).select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("gj"))
    at = at.withColumn("px", (F.col("gi") + 0.5) * step).withColumn("py", (F.col("gj") + 0.5) * step)
    got = sample(at, maps)
    return got.select(*KEYS, "gi", "gj", F.when(F.col("d") < p.w_min / step, 0.0).otherwise(F.col("d")).alias("t"), "cap")


def diffuse(tones: np.ndarray) -> np.ndarray:
    """Serpentine error diffusion at threshold one half: which cells get a dot."""
    h, w = tones.shape
    out, err = np.zeros((h, w), bool), np.zeros((2, w + 2))
    for y in range(h):
        now, nxt = err[y % 2], err[(y + 1) % 2]
        nxt[:] = 0
        ahead = 1 if y % 2 == 0 else -1
        for x in range(w) if ahead > 0 else range(w - 1, -1, -1):
            v = tones[y, x] + now[x + 1]
            out[y, x] = v >= 0.5
            e = v - out[y, x]
            now[x + 1 + ahead] += e * 7 / 16
            nxt[x + 1 - ahead] += e * 3 / 16
            nxt[x + 1] += e * 5 / 16
            nxt[x + 1 + ahead] += e / 16
    return out


def bluenoise(maps: DataFrame, p: LineParams) -> DataFrame:
    """Dots where the diffusion places them. Angles play no part; loads act through the cap only."""
    step = max(p.spacing, 1.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["gj"].max() + 1, pdf["gi"].max() + 1))
        grid[pdf["gj"], pdf["gi"]] = pdf["t"]
        return pdf[diffuse(grid)[pdf["gj"], pdf["gi"]]]

    tones = coarse_tones(maps, p)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tones.schema)
    placed_ = tones.groupBy(*KEYS).applyInPandas(run, schema)
    safe = F.greatest(F.col("cap") / 2 - p.kerf / 2, F.lit(0.0))
    most = F.least(F.lit(p.dot_max / 2), safe)
    least = F.greatest(F.least(F.lit(p.dot_min / 2), most), F.least(F.lit(p.w_min / 2), most))
    return placed_.where(safe > 0).select(*KEYS, "gi", "gj", ((F.col("gi") + 0.5) * step).alias("cx"), ((F.col("gj") + 0.5) * step).alias("cy"), (least + (most - least) * clamp(F.col("t"))).alias("r")).where("r > 0")


def stamp_proximity(filled: DataFrame, reach: float, before: DataFrame | None = None) -> DataFrame:
    """near: distance to the closest filled pixel within reach. Offsets come from the literal radius; nothing is a range join."""
    n = math.floor(reach)
    offsets = [(dx, dy, math.hypot(dx, dy)) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if math.hypot(dx, dy) <= reach]
    disk = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(r).alias("near")) for dx, dy, r in offsets))
    out = filled.select(*KEYS, "x", "y", F.explode(disk).alias("o")).select(*KEYS, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "o.near")
    return (out if before is None else out.unionByName(before)).groupBy(*KEYS, "x", "y").agg(F.min("near").alias("near"))


def _blurred(a: np.ndarray, taps_: list[tuple[int, float]]) -> np.ndarray:
    """filters.gaussian() of one image."""
    r = max(o for o, _ in taps_)
    for _ in range(2):  # along x, then along y
        padded, n = a[:, taken(a.shape[1], r)], a.shape[1]
        a = sum(w * padded[:, r + o : r + o + n] for o, w in taps_).T
    return a


def _bins(d: np.ndarray, sigma: float, bins: int) -> np.ndarray:
    """The bins of filters.orientation() of one image of 3 x 3 or more."""
    h, w = d.shape
    x, y = np.clip(np.arange(w), 1, w - 2)[None, :], np.clip(np.arange(h), 1, h - 2)[:, None]
    gx, gy = (d[y, x + 1] - d[y, x - 1]) / 2, (d[y + 1, x] - d[y - 1, x]) / 2
    jxx, jxy, jyy = (_blurred(v, kernel(sigma)) for v in (gx * gx, gx * gy, gy * gy))
    turn = np.fmod(0.5 * np.arctan2(2 * jxy, jxx - jyy) / math.pi, 1.0)
    turn = np.where(turn < 0, np.fmod(turn + 1.0, 1.0), turn)
    return np.minimum(np.floor(np.nan_to_num(turn) * bins).astype(int), bins - 1)


def _lines(w: int, h: int, angle: float, p: LineParams) -> tuple:
    """segments() of one size and angle that lie inside: li, i, v, their two ends, their pixel, and their four taps with weights."""
    half = math.sqrt(w * w + h * h) / 2 + p.spacing
    n = math.ceil(half / p.spacing)
    li, i = (v.ravel() for v in np.meshgrid(np.arange(-n, n + 1), np.arange(math.ceil(2 * half / p.v_step)), indexing="ij"))
    v = -half + i * p.v_step
    to, u, s, c = np.minimum(v + p.v_step, half), li * p.spacing, math.sin(math.radians(angle)), math.cos(math.radians(angle))
    at = lambda t: (w / 2 - u * s + t * c, h / 2 + u * c + t * s)
    px, py = at((v + to) / 2)
    inside = (v < half) & (px >= 0) & (px < w) & (py >= 0) & (py < h)
    li, i, v, px, py, ends = li[inside], i[inside], v[inside], px[inside], py[inside], [e[inside] for t in (v, to) for e in at(t)]
    x, y = np.minimum(px, w - 1.0), np.minimum(py, h - 1.0)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    taps_ = [(np.minimum(y0 + dy, h - 1), np.minimum(x0 + dx, w - 1), (fx if dx else 1 - fx) * (fy if dy else 1 - fy)) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))]
    return li, i, v, ends, (np.floor(py).astype(int), np.floor(px).astype(int)), taps_


def _filled(x: np.ndarray, y: np.ndarray, starts: np.ndarray, w: int, h: int) -> np.ndarray:
    """fill() of the polygons of one image, whose corners begin at starts."""
    ribbon = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    after = np.arange(len(x)) + 1
    after[np.append(starts[1:], len(x)) - 1] = starts
    bx, by = x[after], y[after]
    first = np.maximum(np.ceil(np.minimum(y, by) - 0.5), 0).astype(int)
    times = np.maximum(np.minimum(np.ceil(np.maximum(y, by) - 0.5) - 1, h - 1).astype(int) - first + 1, 0)
    e = np.repeat(np.arange(len(x)), times)
    row = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times)
    cross = x[e] + (row + 0.5 - y[e]) / (by[e] - y[e]) * (bx[e] - x[e])
    order = np.lexsort((cross, row, ribbon[e]))
    line, cross = (ribbon[e] * h + row)[order], cross[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line, "left")
    k = np.flatnonzero((rank[:-1] % 2 == 0) & (line[:-1] == line[1:]))
    a, b = np.maximum(np.ceil(cross[k]), 0).astype(int), np.minimum(np.floor(cross[k + 1]), w - 1).astype(int)
    ok, marks = a <= b, np.zeros((h, w + 1), int)
    np.add.at(marks, (line[k][ok] % h, a[ok]), 1)
    np.add.at(marks, (line[k][ok] % h, b[ok] + 1), -1)
    return np.cumsum(marks, 1)[:, :w] > 0


def _proximity(filled: np.ndarray, reach: float) -> np.ndarray:
    """stamp_proximity() of one image; inf beyond reach. First along rows, then down columns."""
    n, (h, w) = math.floor(reach), filled.shape
    apart = np.full((h + 2 * n, w), n + 1)
    padded = np.pad(filled, n)
    for dx in range(n, -1, -1):
        apart[padded[:, n - dx : n - dx + w] | padded[:, n + dx : n + dx + w]] = dx
    far = np.array([[r if (r := math.hypot(dx, dy)) <= reach and dx <= n else math.inf for dx in range(n + 2)] for dy in range(n + 1)])
    return np.min([far[abs(dy)][apart[n + dy : n + dy + h]] for dy in range(-n, n + 1)], axis=0)


def hatch(maps: DataFrame, p: LineParams) -> DataFrame:
    """Lines across each bin of orientations, in order of the bins, kept apart by the distance to what is filled already.

    Each bin reads what the ones before it filled, so an image and ink is one group: its pixels are shuffled once and its lines come back.
    """
    bins = min(max(p.hatch_bins, 1), 24)
    reach, kinds = p.min_material + p.v_step + 1 + p.max_cut / 2, maps.select(*KEYS).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", bin int, li int, first int, angle double, knots array<struct<x:double,y:double,hw:double>>"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y, d = (table[c].to_numpy() for c in ("x", "y", "d"))
        angle, load, cap = (table[c][0].as_py() for c in ("angle", "load", "cap"))
        w, h, out = int(x.max()) + 1, int(y.max()) + 1, []
        tones = np.zeros((h, w))
        tones[y, x] = d
        if w >= 3 and h >= 3:
            own, near = _bins(tones, max(p.spacing, 1.0), bins), None
            for b in range(bins):
                # the bin's own angle, at right angles to the gradient; the ink's own as an offset
                turned = angle + 180.0 * b / bins + 90.0
                lines = cut(np.where(own == b, tones, 0.0), turned, load, cap, near)
                if lines is not None:
                    out.append((b, turned, *lines))
                    if b + 1 < bins:
                        stamped = _proximity(_filled(*sides(turned, *lines[2:]), w, h), reach)
                        near = stamped if near is None else np.minimum(near, stamped)
        return rows(key, table, out)

    def cut(tones: np.ndarray, angle: float, load: float, cap: float, near: np.ndarray | None):
        """runs() of one bin: li and first segment of each, where its knots start, and the knots."""
        if (at := (*tones.shape, angle)) not in known:
            known[at] = _lines(tones.shape[1], tones.shape[0], angle, p)
        li, i, v, (x0, y0, x1, y1), pixel, taps_ = known[at]
        raw = sum(t * tones[ty, tx] for ty, tx, t in taps_) * p.spacing * load
        hw = np.where(raw < p.w_min, 0.0, np.maximum(np.minimum(raw - p.kerf, cap), 0.0)) / 2
        if p.bridge_interval > 0 and p.bridge_px > 0:
            hw = np.where(np.mod(v - np.mod(li * GOLDEN, 1.0) * p.bridge_interval, p.bridge_interval) < p.bridge_px, 0.0, hw)
        if near is not None:
            hw = np.minimum(hw, np.maximum(near[pixel] - p.min_material - p.v_step - 1, 0.0))
        k = np.flatnonzero(hw > 0)
        if not len(k):
            return None
        new = np.flatnonzero(np.concatenate([[True], (li[k][1:] != li[k][:-1]) | (i[k][1:] != i[k][:-1] + 1)]))
        one = k[new]
        ends = [np.insert(e[k], new, s[one]) for e, s in ((x1, x0), (y1, y0), (hw, hw))]
        return li[one], i[one], new + np.arange(len(new)), *ends

    def sides(angle: float, starts: np.ndarray, x: np.ndarray, y: np.ndarray, hw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """outline() of the runs: corners, and where each polygon's begin."""
        nx, ny = -math.sin(math.radians(angle)), math.cos(math.radians(angle))
        to = np.append(starts[1:], len(x))
        place = np.concatenate([np.concatenate([np.arange(a, b), np.arange(b - 1, a - 1, -1)]) for a, b in zip(starts.tolist(), to.tolist())])
        side = np.concatenate([np.repeat([-1.0, 1.0], b - a) for a, b in zip(starts.tolist(), to.tolist())])
        return x[place] + side * hw[place] * nx, y[place] + side * hw[place] * ny, 2 * starts

    def rows(key: tuple, table: pa.Table, out: list[tuple]) -> pa.Table:
        joined = lambda k, kind: np.concatenate([np.zeros(0, kind), *(o[k] for o in out)]).astype(kind)
        many, offsets = np.array([len(o[2]) for o in out], np.int64), [0]
        for o in out:
            offsets += (np.append(o[4][1:], len(o[5])) + offsets[-1]).tolist()
        knots = pa.StructArray.from_arrays([pa.array(joined(k, float)) for k in (5, 6, 7)], names=["x", "y", "hw"])
        own = [pa.array([v.as_py()] * int(many.sum()), table[k].type) for k, v in zip(KEYS, key)]
        part = [pa.array(np.repeat(np.array([o[k] for o in out], kind), many)) for k, kind in ((0, np.int32), (1, float))]
        return pa.Table.from_arrays([*own, part[0], pa.array(joined(2, np.int32)), pa.array(joined(3, np.int32)), part[1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), knots)], names=[*KEYS, "bin", "li", "first", "angle", "knots"])

    known: dict = {}
    lines = maps.select(*KEYS, "x", "y", "d", "angle", "load", "cap").groupBy(*KEYS).applyInArrow(run, schema)
    ribbon = F.xxhash64(F.xxhash64(*KEYS, "li", "first"), F.col("bin"))
    return outline(lines.withColumn("ribbon_id", ribbon), False, "ribbon_id")


def screen(density: DataFrame, p: LineParams, set_: list[Ink]) -> DataFrame:
    """Ribbons of every image and ink: image_id, channel, ribbon_id, pts."""
    p.validate(set_)
    maps = toned(density, p, set_, p.shape != "hatch")
    if p.shape == "lines":
        return outline(runs(widths(maps, p), p), False)
    if p.shape == "wavy":
        return outline(runs(widths(maps, p), p), True)
    if p.shape == "dots":
        return circles(dots(maps, p), ["gi", "gj"])
    if p.shape == "bluenoise":
        return circles(bluenoise(maps, p), ["gi", "gj"])
    return hatch(maps, p)
