"""Regions of label rasters and masks. What depends on an order within an image runs once a group (image, layer); where the
order was left open, the smallest label, cell or corner goes first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOURS = ((0, -1), (-1, 0), (1, 0), (0, 1))


def adjacency(raster: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Each pixel with its right and lower neighbours' values: two shifted equi-joins."""
    base = raster.select(*keys, "x", "y", value)
    shifted = lambda dx, dy: base.select(*keys, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(value).alias("other"))
    right = base.join(shifted(1, 0), [*keys, "x", "y"]).withColumn("side", F.lit("right"))
    return right.unionByName(base.join(shifted(0, 1), [*keys, "x", "y"]).withColumn("side", F.lit("below")))


def components_of(values: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """4-connected components of equal values: runs of rows joined by union-find; ids in order of first pixel, -1 outside."""
    h, w = values.shape
    if inside is None:
        inside = np.ones((h, w), bool)
    starts = np.ones((h, w), bool)
    starts[:, 1:] = (values[:, 1:] != values[:, :-1]) | (inside[:, 1:] != inside[:, :-1])
    run = (np.cumsum(starts.ravel()) - 1).reshape(h, w)
    touch = (values[1:] == values[:-1]) & inside[1:] & inside[:-1]
    pairs = np.unique(np.stack([run[:-1][touch], run[1:][touch]], 1), axis=0)
    up = np.arange(run.max() + 1)

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(up))])
    out = root[run]
    out = np.where(inside, out, -1)
    ids = np.unique(out[inside])
    back = np.full(len(up), -1)
    back[ids] = np.arange(len(ids))
    return np.where(inside, back[np.maximum(out, 0)], -1)


def merge_small(labels: np.ndarray, min_area: float) -> np.ndarray:
    """Components under min_area take the label most of their neighbours have by then; smallest first, one pass."""
    if min_area <= 1:
        return labels
    out, comp = labels.copy(), components_of(labels)
    h, w = labels.shape
    size = np.bincount(comp.ravel())
    cells = np.split(np.argsort(comp.ravel(), kind="stable"), np.cumsum(size)[:-1])
    # places in a raster with a border, where the border belongs to no component
    inner = lambda cell: (cell // w + 1) * (w + 2) + cell % w + 1
    wide, around = np.pad(out, 1), np.pad(comp, 1, constant_values=-1).ravel()
    flat = wide.ravel()
    steps = np.array([dy * (w + 2) + dx for dx, dy in NEIGHBOURS])
    for c in sorted(np.flatnonzero(size < min_area).tolist(), key=lambda c: (size[c], c)):
        own = inner(cells[c])
        near = (own[:, None] + steps).ravel()
        near = near[(around[near] >= 0) & (around[near] != c)]
        if len(near):
            found, votes = np.unique(flat[near], return_counts=True)
            flat[own] = found[votes.argmax()]
    return wide[1:-1, 1:-1]


class Gaps:
    """Steps through cut cells from anchored material, and the cell each was reached from; kept up as material is anchored.

    Places are those of a raster with a border of material that nothing is reached through.
    """

    FAR = np.iinfo(np.int32).max

    def __init__(self, keep: np.ndarray):
        self.w = keep.shape[1] + 2
        self.keep = np.pad(keep, 1, constant_values=True).ravel()
        self.dist, self.parent = np.full(len(self.keep), self.FAR, np.int32), np.full(len(self.keep), -1, np.int64)
        self.steps = [dy * self.w + dx for dx, dy in NEIGHBOURS]

    def anchor(self, front: np.ndarray) -> None:
        """A wave from newly anchored places, as far as it is nearer than what was anchored before.

        Ways end at anchored places: one that a tab covered had its own way, which can lead through a cell that is now reached from it.
        """
        self.parent[front] = -1
        d = 0
        while len(front):
            d, after = d + 1, []
            for step in self.steps:
                to = front + step
                ok = ~self.keep[to] & (self.dist[to] > d)
                to, first = np.unique(to[ok], return_index=True)
                self.dist[to], self.parent[to] = d, front[ok][first]
                after.append(to)
            front = np.concatenate(after)


def disk(width: float, row: int) -> np.ndarray:
    """Places around one, in a raster of rows that long, that a tab of this width covers."""
    r2 = int((max(width, 1.0) / 2) ** 2)
    n = int(r2**0.5)
    dx, dy = np.meshgrid(np.arange(-n, n + 1), np.arange(-n, n + 1))
    return np.stack([dx, dy], 2)[dx * dx + dy * dy <= r2]


def carve(gaps: Gaps, cell: int, offsets: np.ndarray) -> np.ndarray:
    """Places covered by disks along the way back to the anchor, the material cell included; inside the raster only."""
    way = [cell]
    while gaps.parent[way[-1]] >= 0:
        way.append(int(gaps.parent[way[-1]]))
    y, x = np.divmod(np.array(way), gaps.w)
    x, y = (x[:, None] + offsets[:, 0]).ravel(), (y[:, None] + offsets[:, 1]).ravel()
    ok = (x > 0) & (x < gaps.w - 1) & (y > 0) & (y < len(gaps.keep) // gaps.w - 1)
    return np.unique(y[ok] * gaps.w + x[ok])


def bridge(keep: np.ndarray, width: float) -> tuple[np.ndarray, list[str]]:
    """Ties every island to the frame by the shortest tabs, nearest island first; specks under 2 pixels are dropped."""
    h, w = keep.shape
    warnings: list[str] = []
    comp = components_of(keep.astype(int), keep)
    n = comp.max(initial=-1) + 1
    cells = np.split(np.argsort(comp.ravel(), kind="stable"), np.cumsum(np.bincount(comp.ravel() + 1, minlength=n + 1)))[1:-1]
    keep, islands, frame = keep.copy(), {}, []
    for c, own in enumerate(cells):
        ys, xs = np.divmod(own, w)
        if ys.min() == 0 or xs.min() == 0 or ys.max() == h - 1 or xs.max() == w - 1:
            frame.append(c)
            continue
        span = max(np.ptp(xs), np.ptp(ys)) + 1
        if span < 2:
            keep[ys, xs] = False
            warnings.append(f"dropped speck at {xs[0]},{ys[0]}")
        else:
            islands[c] = ((ys + 1) * (w + 2) + xs + 1, int(span))
    gaps, around = Gaps(keep), np.pad(np.where(keep, comp, -1), 1, constant_values=-1).ravel()
    places = lambda c: (cells[c] // w + 1) * (w + 2) + cells[c] % w + 1
    if frame:
        gaps.anchor(np.concatenate([places(c) for c in frame]))
    offsets, steps = disk(width, w + 2), np.array(gaps.steps)
    # places around each island, with the island's number
    edge = {c: np.unique((own[:, None] + steps).ravel()) for c, (own, _) in islands.items()}
    edge = {c: e[~gaps.keep[e]] for c, e in edge.items()}
    while islands:
        who = np.repeat(list(islands), [len(edge[c]) for c in islands])
        at = np.concatenate([edge[c] for c in islands])
        ok = gaps.keep[at] == False  # noqa: E712
        who, at = who[ok], at[ok]
        if not len(at) or gaps.dist[at].min() == Gaps.FAR:
            warnings.append(f"{len(islands)} islands can't be reached")
            break
        best = np.lexsort((who, at, gaps.dist[at]))[0]
        c = int(who[best])
        sites = at[(who == c) & (gaps.dist[at] < Gaps.FAR)]
        sites = sites[np.lexsort((sites, gaps.dist[sites]))]
        own, span = islands.pop(c)
        tabs = [int(sites[0])]
        wanted = min(max(span // 40, 1), len(sites))
        apart = np.full(len(sites), np.inf)
        while len(tabs) < wanted:
            apart = np.minimum(apart, (sites % gaps.w - tabs[-1] % gaps.w) ** 2 + (sites // gaps.w - tabs[-1] // gaps.w) ** 2.0)
            tabs.append(int(sites[np.lexsort((sites, -apart))[0]]))
        new = np.unique(np.concatenate([carve(gaps, t, offsets) for t in tabs]))
        gaps.keep[new] = True
        # islands that the tabs touch are anchored with this one
        touched = np.unique(around[np.concatenate([new, (new[:, None] + steps).ravel()])]).tolist()
        gaps.anchor(np.concatenate([new, own, *(islands.pop(k)[0] for k in touched if k in islands)]))
    return gaps.keep.reshape(h + 2, w + 2)[1:-1, 1:-1].copy(), warnings


def trace(keep: np.ndarray, min_area: float = 0.0) -> list[tuple[str, list[tuple[float, float]]]]:
    """Boundary rings of kept cells along cell edges: outers have negative area, holes positive.

    At a corner where two cells touch diagonally a ring turns to stay with its own cell, so 4-connected regions stay apart
    and the signed areas sum to minus the number of kept cells.
    """
    h, w = keep.shape
    pad = np.pad(keep, 1)
    inner = pad[1:-1, 1:-1]
    # directed edges by where they lead: left, down, right, up; along the top, left, bottom and right of a kept cell
    move = ((-1, 0), (0, 1), (1, 0), (0, -1))
    found = [np.nonzero(inner & ~pad[a : a + h, b : b + w]) for a, b in ((0, 1), (1, 0), (2, 1), (1, 2))]
    corner = ((1, 0), (0, 0), (0, 1), (1, 1))
    x = np.concatenate([xs + corner[d][0] for d, (_, xs) in enumerate(found)])
    y = np.concatenate([ys + corner[d][1] for d, (ys, _) in enumerate(found)])
    way = np.repeat(np.arange(4), [len(ys) for ys, _ in found])
    edge = np.full((4, (h + 1) * (w + 1)), -1)  # by direction and first corner
    edge[way, y * (w + 1) + x] = np.arange(len(x))
    dx, dy = np.array(move)[way].T
    end = (y + dy) * (w + 1) + x + dx
    after = np.full(len(x), -1)
    for turn in (1, 0, 3):  # the turn that keeps the same cell on its side comes first
        after = np.where(after < 0, edge[(way + turn) % 4, end], after)
    before = np.empty(len(x), np.int64)
    before[after] = np.arange(len(x))
    bend = (way != way[before]).tolist()
    xs, ys, follow, seen, rings = x.tolist(), y.tolist(), after.tolist(), [False] * len(x), []
    for start in np.lexsort((dy, dx, y, x)).tolist():
        if seen[start]:
            continue
        ring, at = [], start
        while not seen[at]:
            seen[at] = True
            if bend[at]:
                ring.append((float(xs[at]), float(ys[at])))
            at = follow[at]
        area = signed_area(ring)
        if len(ring) >= 3 and abs(area) >= min_area:
            rings.append(("outer" if area < 0 else "hole", ring))
    return rings


def collapse(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Vertices where the direction changes; the ring itself if under three are left."""
    n = len(ring)
    turn = lambda i: (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) - (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0])
    out = [ring[i] for i in range(n) if abs(turn(i)) > 1e-9]
    return out if len(out) >= 3 else ring


def signed_area(ring: list[tuple[float, float]]) -> float:
    return 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def area(pts) -> F.Column:
    """signed_area() as an expression over an array of points."""
    after = lambda i: F.element_at(pts, (F.pmod(i + 1, F.size(pts)) + 1).cast("int"))
    return 0.5 * F.aggregate(F.transform(pts, lambda a, i: a["x"] * after(i)["y"] - after(i)["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def _array(pdf: pd.DataFrame, value: str) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), pdf[value].dtype)
    out[pdf["y"], pdf["x"]] = pdf[value]
    return out


def _grouped(df: DataFrame, keys: list[str], value: str, fn, extra: str) -> DataFrame:
    used = df.select(*keys, "x", "y", value)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema) + extra
    return used.groupBy(*keys).applyInPandas(fn, schema)


def components(mask: DataFrame, keys: list[str]) -> DataFrame:
    """comp of kept pixels (null: cut), and whether it touches the border."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = _array(pdf, "keep").astype(bool)
        comp = components_of(keep.astype(int), keep)
        edge = np.unique(np.concatenate([comp[0], comp[-1], comp[:, 0], comp[:, -1]]))
        got = comp[pdf["y"], pdf["x"]]
        return pdf.assign(comp=pd.array(np.where(got < 0, 0, got), "Int32").astype("Int32"), touches_border=np.isin(got, edge) & (got >= 0)).assign(comp=lambda d: d["comp"].mask(got < 0))

    return _grouped(mask, keys, "keep", run, ", comp int, touches_border boolean")


def label_components(raster: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """comp of every pixel: 4-connected regions of equal labels, numbered by first pixel."""
    return _grouped(raster, keys, value, lambda pdf: pdf.assign(comp=components_of(_array(pdf, value))[pdf["y"], pdf["x"]].astype("int32")), ", comp int")


def merge_small_regions(raster: DataFrame, min_area: float, keys: list[str]) -> DataFrame:
    if min_area <= 1:
        return raster
    return _grouped(raster, keys, "label", lambda pdf: pdf.assign(label=merge_small(_array(pdf, "label"), min_area)[pdf["y"], pdf["x"]]), "")


def bridge_islands(mask: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """The mask with its islands tied, and the warnings of its group on the row of its corner pixel (0, 0); other rows have none.

    There is a warning a speck, so on every pixel they would take the square of an image's size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, warnings = bridge(_array(pdf, "keep").astype(bool), width)
        corner = ((pdf["y"] == 0) & (pdf["x"] == 0)).tolist()
        return pdf.assign(keep=keep[pdf["y"], pdf["x"]], warnings=[warnings if c else [] for c in corner])

    return _grouped(mask, keys, "keep", run, ", warnings array<string>")


def rings(mask: DataFrame, keys: list[str], min_area: float = 0.0) -> DataFrame:
    """keys, ring_id, kind and pts of the traced boundaries."""
    used = mask.select(*keys, "x", "y", "keep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = trace(_array(pdf, "keep").astype(bool), min_area)
        pts = pd.Series([[{"x": a, "y": b} for a, b in r] for _, r in got], dtype=object)  # also where there is no ring
        return pd.DataFrame({**{k: pd.Series([pdf[k].iloc[0]] * len(got), dtype=pdf[k].dtype) for k in keys}, "ring_id": pd.Series(range(len(got)), dtype="int64"), "kind": pd.Series([k for k, _ in got], dtype=object), "pts": pts})

    schema = ", ".join(f"`{k}` {used.schema[k].dataType.simpleString()}" for k in keys) + ", ring_id long, kind string, pts array<struct<x:double,y:double>>"
    return used.groupBy(*keys).applyInPandas(run, schema)


def stack_masks(raster: DataFrame, layers: list[int]) -> DataFrame:
    """keep of every pixel for each layer, in one scan: masks are disjoint."""
    return raster.select("image_id", F.explode(F.array(*map(F.lit, layers))).alias("layer"), "x", "y", "label").select("image_id", "layer", "x", "y", (F.col("label") == F.col("layer")).alias("keep"))
