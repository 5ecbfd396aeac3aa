"""Invariants of the raster operators on small rasters made in code."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgrid import cli
from inkgrid.functions import color, tone
from inkgrid.operators import fill, filters, quantize, regions, screens, smooth, svg, warp
from inkgrid.params import LineParams, Preset, StencilParams, inks, paper, rotated, switched
from inkgrid.plans import pipelines
from inkgrid.sources import rasters, sinks
from inkgrid.streaming import jobs

BASE = LineParams(spacing=10, w_min=1, min_material=2)
BLACK = [i for i in inks() if i.channel == "c"]


def ink(angle=0.0, load=1.0, channel="c"):
    return inks("cmyk", {channel: angle}, {channel: load})[["c", "m", "y", "k"].index(channel)]


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first().asDict()


def mask_df(spark, a, layer=0):
    y, x = np.divmod(np.arange(a.size), a.shape[1])
    return spark.createDataFrame(pd.DataFrame({"image_id": 0, "layer": layer, "x": x, "y": y, "keep": a.ravel()})).withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int"))


def test_colours(spark):
    for rgb, want in (((1, 0, 0), (0, 1, 1, 0)), ((1, 1, 1), (0, 0, 0, 0)), ((0, 0, 0), (0, 0, 0, 1))):
        got = one(spark, **color.cmyk(*(F.lit(float(v)) for v in rgb)))
        assert [got[k] for k in "cmyk"] == pytest.approx(want, abs=1e-5)
    for rgb in ((255, 0, 0), (0, 128, 64), (200, 200, 200), (0, 0, 0), (255, 255, 255)):
        got = one(spark, **color.snapped(*(F.lit(v) for v in rgb)))
        assert max(abs(got[k] - v) for k, v in zip("rgb", rgb)) <= 1
    assert one(spark, **color.lab(*[F.lit(0.0)] * 3))["L"] == pytest.approx(0, abs=1)
    assert one(spark, **color.lab(*[F.lit(1.0)] * 3))["L"] == pytest.approx(100, abs=1)
    got = one(spark, **color.split_extended(F.lit(0.2), F.lit(0.8), F.lit(0.7)))
    assert got["o"] == pytest.approx(0.5) and got["g"] == 0 and got["m"] == pytest.approx(0.3) and got["y"] == pytest.approx(0.2)


def test_tones(spark):
    lv = lambda *a: one(spark, v=tone.levels(F.lit(a[0]), *a[1:]))["v"]
    assert [lv(0.1, 0.2, 0.8), lv(0.9, 0.2, 0.8), lv(0.5, 0.2, 0.8)] == pytest.approx([0, 1, 0.5])
    assert lv(0.0, 0.0, 0.0) == 1 and lv(0.2, 0.5, 0.5) == 0 and math.isfinite(lv(0.5, 0.8, 0.2))
    sc = [one(spark, v=tone.scurve(F.lit(x), k))["v"] for x, k in ((0.0, 8), (1.0, 8), (0.37, 0), (0.3, 8))]
    assert sc[:3] == pytest.approx([0, 1, 0.37]) and sc[3] < 0.3
    assert [one(spark, v=tone.deep_clip(F.lit(x), 0.75, 2))["v"] for x in (0.6, 0.75, 0.85, 1.0)] == pytest.approx([0, 0, 0.16, 1])
    grey = lambda u: one(spark, v=tone.effective_k(F.lit(0.9), [F.lit(u)] * 3, BASE))["v"]
    assert grey(0.5) == 0 and grey(0.0) > 0
    ph = [r["p"] for r in spark.range(-50, 51).select(tone.bridge_phase(F.col("id"), 20.0).alias("p")).collect()]
    far = lambda a, b: min(abs(a - b), 20 - abs(a - b))
    assert all(far(ph[i], ph[i + k]) >= 4 for k in (1, 2) for i in range(len(ph) - k))
    assert one(spark, v=tone.byte_levels(F.lit(200), 0.3, 1.0, 1.0))["v"] == 255 and one(spark, v=tone.byte_levels(F.lit(200), 0.0, 1.0, 1.0))["v"] == 200


def test_auto_levels(spark):
    vals = [0.0] * 5 + [0.2] * 45 + [0.8] * 45 + [1.0] * 5
    df = spark.createDataFrame([(0, "k", i, 0, v) for i, v in enumerate(vals)], "image_id int, channel string, x int, y int, d double")
    got = filters.auto_levels(df, 0.06, 0.94).first()
    assert 0 < got["white"] <= 0.2 and 0.8 <= got["black"] < 1
    flat = filters.auto_levels(df.withColumn("d", F.lit(0.5))).first()
    assert (flat["white"], flat["black"]) == (0.0, 1.0)


def test_lines(spark):
    run = lambda d, p=BASE, i=ink(), n=40: screens.runs(screens.widths(screens.toned(rasters.analytic(spark, n, n, lambda x, y: F.lit(d), "c"), p, [i]), p), p).collect()
    assert not run(0.05)
    half = run(0.5)
    assert 0 < len(half) <= 6 and len(half[0]["knots"]) > 2
    assert 2 * run(1.0)[0]["knots"][0]["hw"] == pytest.approx(8, abs=0.01)
    assert 2 * run(0.5, LineParams(spacing=10, w_min=1, min_material=2, kerf=1))[0]["knots"][0]["hw"] == pytest.approx(4, abs=0.01)
    assert 2 * run(1.0, BASE, ink(load=0.5))[0]["knots"][0]["hw"] == pytest.approx(4, abs=0.01)
    plain, tied = run(1.0, n=100), run(1.0, LineParams(spacing=10, w_min=1, min_material=0.5, bridge_interval=20, bridge_px=4), n=100)
    assert len(plain) < len(tied) < 200


@pytest.mark.parametrize("shape", ["lines", "wavy", "dots", "bluenoise", "hatch"])
def test_shapes(spark, shape):
    p = LineParams(spacing=10, w_min=1, min_material=2, shape=shape, hatch_bins=2)
    cover = {}
    for d in (0.05, 0.25, 0.85):
        den = rasters.analytic(spark, 40, 40, lambda x, y, d=d: F.lit(d) + 0 * x, "c")
        rib = screens.screen(den, p, [ink(15.0)])
        assert all(r["n"] >= 3 for r in rib.select(F.size("pts").alias("n")).collect())
        cover[d] = fill.fill(rib, screens.sizes(den)).count()
    assert cover[0.05] == 0 and cover[0.85] > cover[0.25]


def test_tamed_black(spark):
    den = rasters.analytic(spark, 60, 60, lambda x, y: F.lit(1.0) + 0 * x, "k").unionByName(*[rasters.analytic(spark, 60, 60, lambda x, y: F.lit(0.0) + 0 * x, c) for c in "c"])
    p = LineParams(spacing=10, w_min=1, min_material=2, ucr=0)
    maps = screens.toned(den, p, [ink(), ink(channel="k")]).where("channel = 'k'")
    got = screens.runs(screens.widths(maps, p), p).collect()
    assert got and max(2 * k["hw"] for r in got for k in r["knots"]) <= 4.01


def test_distance_is_the_closed_form():
    rng = np.random.default_rng(2)
    for _ in range(20):
        keep = rng.random((9, 11)) < 0.8
        if keep.all():
            continue
        cy, cx = np.nonzero(~keep)
        y, x = np.mgrid[0:9, 0:11]
        dx, dy = abs(x[..., None] - cx), abs(y[..., None] - cy)
        assert (filters.chamfer(keep) == (3 * np.maximum(dx, dy) + np.minimum(dx, dy)).min(-1)).all()


def test_stiffness(spark):
    for m in (1, 2, 4):
        a = np.tile(np.arange(48) % 8 < m, (48, 1))
        got = filters.stiffness(mask_df(spark, a), ["image_id"]).first()
        assert got["neck_px"] == pytest.approx(m, abs=1.01) and got["removed"] == pytest.approx(1 - m / 8, abs=0.02)
    solid = filters.stiffness(mask_df(spark, np.ones((16, 16), bool)), ["image_id"]).first()
    none = filters.stiffness(mask_df(spark, np.zeros((16, 16), bool)), ["image_id"]).first()
    assert solid["removed"] == 0 and solid["neck_px"] > 4 and none["removed"] == 1 and none["neck_px"] == 0


def test_edges_and_blur(spark):
    flat = rasters.analytic(spark, 20, 20, lambda x, y: F.lit(0.5) + 0 * x)
    step = rasters.analytic(spark, 20, 20, lambda x, y: F.when(x < 10, 0.0).otherwise(1.0))
    assert filters.dog_edges(flat, 1, 2, 0.02).agg(F.sum("d")).first()[0] == 0
    assert filters.dog_edges(step, 1, 2, 0.02).agg(F.sum("d")).first()[0] > 0
    assert filters.gaussian(flat, 0) is flat
    assert filters.gaussian(flat, 1.5).agg(F.max(F.abs(F.col("d") - 0.5))).first()[0] < 1e-9


def test_regions_and_bridges():
    lab = np.zeros((5, 5), int)
    lab[2, 2] = 1
    assert not regions.merge_small(lab, 4).any()
    lab = np.zeros((6, 6), int)
    lab[1:5, 1:5] = 1
    assert regions.merge_small(lab, 4).sum() == 16
    k = np.ones((13, 13), bool)
    k[3:10, 3:10] = False
    k[5:8, 5:8] = True
    out, _ = regions.bridge(k, 3)
    assert len(np.unique(regions.components_of(out.astype(int), out)[out])) == 1
    k = np.ones((11, 11), bool)
    k[1:6, 2:9] = False
    k[2:5, 3] = True
    out, _ = regions.bridge(k, 1)
    assert len(np.unique(regions.components_of(out.astype(int), out)[out])) == 1 and not out[1:6, 5:9].any()
    k = np.ones((7, 7), bool)
    k[2:5, 2:5] = False
    k[3, 3] = True
    out, warnings = regions.bridge(k, 3)
    assert not out[3, 3] and "dropped speck" in warnings[0]


def test_trace():
    k = np.ones((6, 6), bool)
    k[2:4, 2:4] = False
    kinds = sorted((kind, regions.signed_area(r)) for kind, r in regions.trace(k))
    assert [x for x, _ in kinds] == ["hole", "outer"] and kinds[0][1] > 0 > kinds[1][1]
    two = regions.trace(np.eye(2, dtype=bool))
    assert [(a, regions.signed_area(r)) for a, r in two] == [("outer", -1.0)] * 2
    rng = np.random.default_rng(1)
    for _ in range(30):
        k = rng.random((8, 9)) < 0.6
        assert sum(regions.signed_area(r) for _, r in regions.trace(k)) == pytest.approx(-k.sum())


def test_quantize(spark):
    px = spark.createDataFrame([(0, i, 0, v, v, v) for i in range(50) for v in (0,)] + [(0, i, 1, 255, 255, 255) for i in range(50)], "image_id int, x int, y int, r int, g int, b int")
    pal = quantize.palette(px, 2).orderBy("label").collect()
    assert [p["r"] for p in pal] == [0, 255]
    got = quantize.labels(px, quantize.palette(px, 2)).groupBy("y").agg(F.min("label"), F.max("label")).orderBy("y").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0), (1, 1)]


def test_smooth():
    stairs = [(float(i), float(i + j)) for i in range(10) for j in (0, 1)] + [(10.0, 0.0)]
    assert len(smooth.simplify_ring(stairs, 1.5)) < len(stairs) / 2
    start, segs = smooth.smooth_ring([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 0.5)
    at = start
    for c1, c2, p in segs:
        assert math.dist(c1, at) < 1e-3 and math.dist(c2, p) < 1e-3
        at = p
    _, segs = smooth.smooth_ring([(0.0, 0.0), (10.0, 1.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)], 0.1)
    assert any(math.dist(c1, a) > 0.01 for (c1, _, _), (_, _, a) in zip(segs[1:], segs))
    assert smooth.smooth_ring([(0.0, 0.0), (1.0, 1.0)], 1) is None


def test_svg(spark):
    lay = one(spark, **svg.fit("a4", 10.0, F.lit(100.0), F.lit(50.0)))
    assert (lay["paper_w"], lay["paper_h"]) == (297, 210) and lay["scale"] == pytest.approx(2.77)
    rib = spark.createDataFrame([(0, "c", 1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], "image_id int, channel string, ribbon_id long, pts array<struct<x:double,y:double>>")
    frame = spark.createDataFrame([(0, "c", 50, 40)], "image_id int, channel string, w int, h int")
    text = svg.ribbons_svg(rib, frame, ["image_id", "channel"]).first()["svg"]
    assert text.startswith("<svg") and "M0.000 0.000" in text and text.count('stroke="red"') == 3 and text.endswith("</svg>")
    text = svg.ribbons_svg(rib, frame, ["image_id", "channel"], "A5", 8, 3).first()["svg"]
    assert text.count("<circle") == 4 and "r=\"3.000\"" in text and "mm" in text and "translate" in text


def test_warp_computes_places_once_a_size(spark, monkeypatch):
    rows = [(i, x, y, float(i * 7 + x * 11 % 5), float(x * y), float(y * 3 % 4 + i)) for i in range(4) for x in range(6 + i % 2) for y in range(5)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, r double, g double, b double")
    h = warp.homography([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(0.3, 0.2), (5.1, 0.4), (5.3, 4.1), (0.6, 3.9)])
    values = lambda df: sorted(map(tuple, df.collect()))
    once = warp.bake(px, h, 4, 3)
    assert "BroadcastHashJoin" in once._jdf.queryExecution().executedPlan().toString() and len(values(once)) == 4 * 12
    one = values(warp.bake(px.where("image_id % 2 = 0"), h, 4, 3))
    monkeypatch.setattr(warp, "FEW_POINTS", 12)
    apart = warp.bake(px, h, 4, 3)
    assert values(apart) == values(once) and one == [r for r in values(once) if r[0] % 2 == 0]
    assert warp.bake(px.limit(0), h, 4, 3).count() == 0


def test_warp(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 20.0), (0.0, 20.0)]
    h = warp.homography(square, square)
    assert warp.homography([(0.0, 0.0)] * 4, square) is None
    u, v = warp.project(h, F.lit(3.0), F.lit(7.0))
    assert tuple(one(spark, u=u, v=v).values()) == pytest.approx((3, 7), abs=1e-6)
    h = warp.homography([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(2.0, 1.0), (9.0, 0.0), (8.0, 6.0), (1.0, 5.0)])
    u, v = warp.project(h, F.lit(4.0), F.lit(4.0))
    assert tuple(one(spark, u=u, v=v).values()) == pytest.approx((8, 6), abs=1e-6)
    px = spark.createDataFrame([(0, x, y, x * 10, y * 10, 5) for x in range(6) for y in range(5)], "image_id int, x int, y int, r int, g int, b int")
    assert warp.crop_and_warp(px, 6, 5) is px
    got = warp.crop_and_warp(px, 6, 5, crop=(0.5, 0.0, 1.0, 1.0))
    assert {(r["x"], r["y"]): r["r"] for r in got.collect()}[0, 0] == 30
    assert warp.normalize_crop(0.9, 0.2, 0.1, 0.2) == pytest.approx((0.1, 0.2, 0.9, 0.22))


def test_params():
    for bad in (dict(spacing=0), dict(w_min=20), dict(kerf=9), dict(white=0.9, black=0.1), dict(ucr=2), dict(k_deep_clip=1), dict(shape="x")):
        with pytest.raises(ValueError):
            LineParams(**bad).validate()
    with pytest.raises(ValueError):
        LineParams().validate(inks(loads={"c": 0}))
    with pytest.raises(ValueError):
        StencilParams(colors=300).validate()
    with pytest.raises(ValueError):
        paper("B5")
    assert rotated(inks(), 50)[1].angle == 5
    p = Preset(lines=LineParams(spacing=7.5, shape="dots"))
    assert Preset().loads_text(p.dumps()) == p
    assert Preset().loads_text("spacing = x\nunknown = 3\nshape = blob") == Preset()
    assert len(Preset().loads_text("inks = cmykog\nangles = 1 2 3 4").angles) == 6


def test_files_and_pipelines(spark, tmp_path):
    a = np.full((12, 12, 4), 255, np.uint8)
    a[3:9, 3:9, :3] = (20, 40, 60)
    (tmp_path / "a.png").write_bytes(sinks.png(a))
    px = rasters.images(spark, str(tmp_path))
    assert px.count() == 144 and rasters.image_sizes(spark, str(tmp_path)).first()["w"] == 12
    assert px.where("x = 4 and y = 4").first()["b"] == pytest.approx(60 / 255)
    set_ = inks()
    got = pipelines.halftone(px, LineParams(spacing=3, w_min=0.2, min_material=0.5), set_)
    assert got.sheets.count() == 4 and got.preview.count() == 144 and got.stiffness.count() == 4
    px8 = px.select("image_id", "x", "y", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb"))
    st = pipelines.stencil(px8, StencilParams(colors=2, min_feature_px=2))
    assert st.sheets.count() == 2 and st.preview.where("x = 4 and y = 4").first()["r"] == 20
    assert sinks.stencil_pngs(st.masks.select("image_id", "layer", "x", "y", "keep"), st.palette).count() == 2
    assert sinks.palette_table(st.palette).orderBy("layer").first()["rgb_hex"] == "#14283c"
    sinks.write_text(st.sheets, str(tmp_path / "out"), ["layer"])
    assert spark.read.text(str(tmp_path / "out")).count() >= 2


def test_command_line(spark, tmp_path, capsys):
    a = np.full((16, 20, 4), 255, np.uint8)
    a[3:12, 3:14, :3] = (20, 40, 60)
    a[5:9, 6:9, :3] = (250, 240, 10)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(sinks.png(a))
    src, out = str(tmp_path / "in"), tmp_path / "out"
    base = ["--input", src, "--out-prefix", str(out / "x")]
    need = ["--spacing-px", "4", "--min-material-px", "1", "--min-cut-px", "0.5"]
    assert cli.main(["halftone", *base, *need, "--paper", "a5", "--angles", "0,30,60,90", "--shape", "dots"]) == 0
    assert sorted(p.name for p in out.iterdir() if p.is_file()) == ["x_c.svg", "x_k.svg", "x_m.svg", "x_preview.png", "x_y.svg"]
    text = (out / "x_m.svg").read_text()
    assert 'fill="#ff00ff"' in text and "MAGENTA 2/4" in text and text.count("<circle") == 4
    scale = min((210 - 20) / 20, (148 - 20) / 16)
    assert f'r="{max(1 * scale, 2):.3f}"' in text
    said = capsys.readouterr().err
    assert said.count(" ribbons, cut ") == 4 and "layer k" in said
    assert cli.main(["stencil", *base, "--colors", "2", "--min-feature-px", "2"]) == 0
    assert {"x_0.svg", "x_1.svg", "x_palette.txt"} <= {p.name for p in out.iterdir()}
    assert (out / "x_palette.txt").read_text().splitlines()[0] == "layer\trgb_hex\tcmyk" and " px kept, " in capsys.readouterr().err
    (tmp_path / "in" / "two.png").write_bytes(sinks.png(np.full((8, 8, 4), 255, np.uint8)))  # one colour: a layer keeps nothing
    assert cli.main(["stencil", *base, "--colors", "3", "--format", "png", "--bridges", "on", "--min-material-px", "2"]) == 0
    assert {"x_one_0.png", "x_two_2.png", "x_two_palette.txt"} <= {p.name for p in out.iterdir()}
    capsys.readouterr()
    for bad in (["halftone", *base], ["halftone", *base, *need, "--paper", "B1"], ["halftone", *base, *need, "--angles", "1,2"], ["halftone", *base, *need, "--loads", "a,b,c,d"], ["halftone", *base, *need[:-1], "x"], ["halftone", *base, *need, "--gamma", "0"],
                ["stencil", *base], ["stencil", *base, "--colors", "1"], ["stencil", *base, "--colors", "x"], ["stencil", *base, "--colors", "2", "--bridges", "on"], ["stencil", *base, "--colors", "2", "--format", "gif"], ["stencil", *base, "--colors", "2", "--white-point", "0.9", "--black-point", "0.2"]):
        assert cli.main(bad) == 1, bad
        assert capsys.readouterr().err.startswith("error: ")
    assert cli.main([]) == cli.main(["other", "--x", "1"]) == 2


def test_command_line_parameters(tmp_path):
    p = cli.line_params({"spacing-px": "6", "shape": "blue-noise", "k-mode": "contour", "auto-levels": "on", "gamma": "odd", "unknown": "1"}, LineParams())
    assert (p.spacing, p.shape, p.k_mode, p.auto_levels, p.gamma) == (6, "bluenoise", "contour", True, 1)
    s = cli.stencil_params({"colors": "3", "min-feature-px": "4", "coarsen-px": "1.5"}, StencilParams())
    assert (s.colors, s.min_feature_px, s.blur_px, s.bridges) == (3, 16, 1.5, False)
    s = cli.stencil_params({"colors": "3", "bridges": "on", "min-material-px": "2", "bridge-px": "-1"}, StencilParams())
    assert (s.bridges, s.bridge_px) == (True, 2)
    assert [i.angle for i in cli.ink_set({"angle-k": "7"}, Preset())] == [15, 135, 0, 7] and len(cli.ink_set({"inks": "cmykog"}, Preset())) == 6
    mine = Preset("cmykog", LineParams(shape="hatch"), (1.0,) * 6, (0.5,) * 6, StencilParams(colors=7, bridges=False), "stencil", "A3", 4.0, True)
    mine.save(str(tmp_path / "p.txt"))
    assert Preset.load(str(tmp_path / "p.txt")) == mine
    assert Preset().loads_text("paper = b9\nmode = x\nmargin = y\nstencil.colors = z\nangles_locked = maybe") == Preset()
    assert switched("cmykog").angles == (15, 135, 0, 30, 60, 45) and switched("cmykog").loads == (1,) * 6
    assert LineParams(spacing=4, min_material=9, kerf=-1).clamped().min_material == pytest.approx(3.99) and LineParams(kerf=-1).clamped().kerf == 0


def test_images_of_one_colour(spark):
    px = spark.createDataFrame([(k, x, y, v, v, v) for k, v in ((0, 255), (1, 7)) for x in range(9) for y in range(7)], "image_id int, x int, y int, r int, g int, b int")
    got = pipelines.stencil(px, StencilParams(colors=3))
    assert got.sheets.count() == 6 and got.rings.count() == 2 and got.preview.where("image_id = 1").agg(F.max("r")).first()[0] == 7
    assert {r["n_kept"] for r in got.report.collect()} == {0, 63}


def brute_merge(labels, least):
    """Flood fill, smallest first; each takes the label that most of its edges lead to."""
    h, w = labels.shape
    comp, cells = -np.ones((h, w), int), []
    for y in range(h):
        for x in range(w):
            if comp[y, x] < 0:
                todo, own = [(y, x)], []
                comp[y, x] = len(cells)
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < h and 0 <= d < w and comp[c, d] < 0 and labels[c, d] == labels[y, x]:
                            comp[c, d] = len(cells)
                            todo.append((c, d))
                cells.append(own)
    out = labels.copy()
    for k in sorted(range(len(cells)), key=lambda k: (len(cells[k]), k)):
        if len(cells[k]) < least:
            votes = {}
            for a, b in cells[k]:
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < h and 0 <= d < w and comp[c, d] != k:
                        votes[out[c, d]] = votes.get(out[c, d], 0) + 1
            if votes:
                for a, b in cells[k]:
                    out[a, b] = min(votes, key=lambda v: (-votes[v], v))
    return out, comp


def test_merging_is_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        labels = rng.integers(0, 3, (9, 11)) if _ % 2 else rng.integers(0, 3, (3, 4)).repeat(3, 0).repeat(3, 1)[:9, :11]
        want, comp = brute_merge(labels, 5)
        assert (regions.merge_small(labels, 5) == want).all() and (regions.components_of(labels) == comp).all()


def test_bridges_tie_all_islands():
    rng = np.random.default_rng(5)
    for k in range(30):
        keep = rng.random((24, 26)) < 0.55
        keep[[0, -1]] = keep[:, [0, -1]] = True
        width = (1, 3, 4)[k % 3]
        out, warnings = regions.bridge(keep, width)
        comp = regions.components_of(keep.astype(int), keep)
        sizes = np.bincount(comp[keep])
        specks = {c for c in range(len(sizes)) if sizes[c] == 1 and comp[0, 0] != c}
        assert sum("dropped speck" in w for w in warnings) == len(specks) == len(warnings)
        rest = keep & ~np.isin(comp, list(specks))
        assert (out | ~rest).all()  # nothing else is lost
        assert len(np.unique(regions.components_of(out.astype(int), out)[out])) == 1
    # the first tab is a shortest one
    keep = np.ones((15, 15), bool)
    keep[2:13, 1:13] = False
    keep[4:6, 6:9] = True
    out, _ = regions.bridge(keep, 1)
    assert out.sum() - keep.sum() == 2 and out[2:4, 6:9].sum() == 2


def test_trace_turns_and_places():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keep = rng.random((7, 9)) < 0.5
        pad = np.pad(keep, 1).astype(int)
        corners = pad[:-1, :-1] + pad[1:, :-1] + pad[:-1, 1:] + pad[1:, 1:]
        diagonal = (corners == 2) & (pad[:-1, :-1] == pad[1:, 1:])
        rings = regions.trace(keep)
        assert sum(len(r) for _, r in rings) == (corners % 2).sum() + 2 * diagonal.sum()
        for kind, r in rings:
            assert (kind == "outer") == (regions.signed_area(r) < 0) and regions.collapse(r) == r
        assert sum(k == "outer" for k, _ in rings) == regions.components_of(keep.astype(int), keep).max(initial=-1) + 1


def test_loads_change_their_ink_only(spark):
    maps = rasters.analytic(spark, 40, 40, lambda x, y: F.lit(1.0) + 0 * x, "m").unionByName(rasters.analytic(spark, 40, 40, lambda x, y: F.lit(0.5) + 0 * x, "c"))
    cut = lambda load: {(r["channel"], r["li"]): [tuple(k) for k in r["knots"]] for r in screens.runs(screens.widths(screens.toned(maps, BASE, [ink(channel="c"), ink(channel="m", load=load)]), BASE), BASE).collect()}
    full, half = cut(1.0), cut(0.5)
    assert {k: v for k, v in full.items() if k[0] == "c"} == {k: v for k, v in half.items() if k[0] == "c"}  # bit for bit
    assert {2 * v[0][2] for k, v in full.items() if k[0] == "m"} == {8.0} and {2 * v[0][2] for k, v in half.items() if k[0] == "m"} == {4.0}


def test_necks_grow_as_loads_shrink(spark):
    den = rasters.analytic(spark, 48, 48, lambda x, y: F.lit(0.9) + 0 * x, "c")
    necks = []
    for load in (0.4, 0.6, 0.8, 1.0):
        rib = screens.screen(den, BASE, [ink(load=load)])
        grid = den.select("image_id", "x", "y")
        mask = fill.masks(fill.fill(rib, screens.sizes(den)), grid, ["c"])
        necks.append(filters.stiffness(mask, ["image_id", "channel"]).first()["neck_px"])
    assert necks == sorted(necks, reverse=True)


def test_blue_noise(spark):
    p = LineParams(spacing=10, w_min=1, min_material=2, shape="bluenoise", dot_min=1, dot_max=8)
    ramp = rasters.analytic(spark, 200, 40, lambda x, y: 1 - x / 199.0, "c")
    maps = screens.toned(ramp, p, [ink()])
    got, again = ([tuple(r) for r in screens.bluenoise(maps, p).orderBy("gi", "gj").collect()] for _ in range(2))
    assert got == again and got
    x, r = np.array([g[4] for g in got]), np.array([g[6] for g in got])
    assert 2 * r[x < 67].mean() > 2 * r[x > 133].mean() + 1 and 2 * r.max() <= 8.01
    full = screens.bluenoise(screens.toned(rasters.analytic(spark, 80, 80, lambda x, y: F.lit(1.0) + 0 * x, "c"), p, [ink()]), LineParams(spacing=10, w_min=1, min_material=2, shape="bluenoise", dot_min=0, dot_max=1000)).collect()
    at = np.array([(c["cx"], c["cy"]) for c in full])
    apart = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))[~np.eye(len(at), dtype=bool)]
    assert max(2 * c["r"] for c in full) <= 8.01 and apart.min() >= 9.99


def test_hatch_lines_keep_apart(spark):
    p = LineParams(spacing=10, w_min=1, min_material=2, shape="hatch", hatch_bins=4)
    den = rasters.analytic(spark, 64, 64, lambda x, y: F.sin(F.atan2(y - 32.0, x - 32.0)) * 0.5 + 0.5, "c")
    rib = screens.screen(den, p, [ink()]).collect()
    assert len(rib) > 5
    lines = [np.array([(q["x"], q["y"]) for q in r["pts"]]) for r in rib]
    near = min(np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)).min() for i, a in enumerate(lines) for b in lines[:i])
    assert near >= p.min_material - 1


def test_hatch_is_its_operators_in_one_group(spark, monkeypatch):
    """As segments, samples, fill and proximity of the raster operators bin by bin, but nothing is written in between."""
    from inkgrid.operators.filters import orientation

    p, bins = LineParams(spacing=6, w_min=1, min_material=1, shape="hatch", hatch_bins=3, kerf=0.25, bridge_interval=20, bridge_px=4), 3
    den = rasters.analytic(spark, 37, 29, lambda x, y: F.sin(F.atan2(y - 12.0, x - 20.0) * 2) * 0.5 + 0.5, "c").unionByName(rasters.analytic(spark, 2, 2, lambda x, y: F.lit(0.9) + 0 * x, "c", 1)).unionByName(rasters.analytic(spark, 9, 8, lambda x, y: F.lit(0.0) + 0 * x, "c", 2))
    maps = screens.toned(den, p, [ink(15.0)]).cache()
    binned = maps.join(orientation(maps, p.spacing, bins).select("image_id", "channel", "x", "y", "bin"), ["image_id", "channel", "x", "y"]).cache()
    want, near = {}, None
    for b in range(bins):
        own = binned.select("image_id", "channel", "x", "y", F.when(F.col("bin") == b, F.col("d")).otherwise(0.0).alias("d"), (F.col("angle") + 180.0 * b / bins + 90.0).alias("angle"), "load", "cap")
        rib = screens.outline(screens.runs(screens.widths(own, p, near), p), False).withColumn("ribbon_id", F.xxhash64("ribbon_id", F.lit(b))).cache()
        want |= {r["ribbon_id"]: r for r in rib.collect()}
        near = screens.stamp_proximity(fill.fill(rib, screens.sizes(binned)), p.min_material + p.v_step + 1 + p.max_cut / 2, near).cache()

    monkeypatch.setattr(screens, "materialise", lambda *a: pytest.fail("written"))
    got = {r["ribbon_id"]: r for r in screens.hatch(maps, p).collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    for k, r in want.items():
        assert (r["image_id"], r["channel"]) == (got[k]["image_id"], got[k]["channel"]) and np.allclose([(q["x"], q["y"]) for q in r["pts"]], [(q["x"], q["y"]) for q in got[k]["pts"]], atol=1e-9)


def test_latest_jobs_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 2, 2, 6.0), ("b", 1, 3, 7.0)], "session string, ts int, seq int, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    q = jobs.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted((r["session"], r["value"]) for r in out) == [("a", 6.0), ("b", 7.0)]


def test_cells_are_averaged_in_the_order_of_rows(spark, tmp_path):
    """Rows of one cell in many row groups: their partial sums, merged, differed in the last bits."""
    rng = np.random.default_rng(1)
    n = 3000
    item = pd.DataFrame({"l_orderkey": np.zeros(n, int), "l_partkey": np.arange(n) % 64, "l_quantity": rng.integers(1, 51, n) * 1.0, "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100})
    item.to_parquet(tmp_path / "lineitem.parquet", row_group_size=100)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r["y"]: (r["r"], r["g"], r["b"]) for r in rasters.raster_rgb(spark, str(tmp_path)).where("x = 0").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    for y in range(64):
        own = item[item["l_partkey"] == y]
        assert got[y] == tuple(list(itertools.accumulate(own[c].tolist()))[-1] / len(own) / k for c, k in (("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.08)))


def test_a_null_in_a_cell_is_left_out(spark, tmp_path):
    item = pd.DataFrame({"l_orderkey": [0, 0, 1], "l_partkey": [0, 0, 0], "l_quantity": [10.0, None, None], "l_discount": [0.1, 0.05, 0.0], "l_tax": [0.08, 0.0, 0.0]})
    item.to_parquet(tmp_path / "lineitem.parquet")
    got = {r["x"]: (r["r"], r["g"], r["b"]) for r in rasters.raster_rgb(spark, str(tmp_path)).where("y = 0 and x < 2").collect()}
    assert got[0] == pytest.approx((0.2, 0.75, 0.5)) and got[1] == (1.0, 0.0, 0.0)


def test_warnings_ride_on_one_row(spark):
    """A warning a speck on every pixel took the square of an image's size."""
    keep = np.zeros((12, 12), bool)
    keep[2::2, 2::2] = True
    keep[0] = True
    got = regions.bridge_islands(mask_df(spark, keep), 1.0, ["image_id", "layer"]).toPandas()
    sizes = got.set_index(["y", "x"])["warnings"].map(len)
    assert sizes[0, 0] == sizes.sum() == 25


@pytest.mark.parametrize("size, seed", [(16, 9), (24, 27), (24, 31), (24, 40)])
def test_ways_to_anchors_end(size, seed, monkeypatch):
    """A cell that a tab covered and the cell it had been reached from each led to the other: an endless way, held in memory."""
    carve = regions.carve

    def checked(gaps, cell, offsets):
        at, seen = cell, {cell}
        while gaps.parent[at] >= 0:
            at = int(gaps.parent[at])
            assert at not in seen
            seen.add(at)
        return carve(gaps, cell, offsets)

    monkeypatch.setattr(regions, "carve", checked)
    keep = np.random.default_rng(seed).random((size, size)) < 0.3
    out, _ = regions.bridge(keep, 3.0)
    comp = regions.components_of(out.astype(int), out)
    edge = set(np.concatenate([comp[0], comp[-1], comp[:, 0], comp[:, -1]]).tolist())
    assert set(np.unique(comp[out]).tolist()) <= edge
