"""Every registered query of the raster operators, over whole tables, with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, tone
from ..operators import fill, filters, quantize, regions, screens, svg, warp
from ..params import INK_COLOURS, LineParams, StencilParams, inks
from ..sources.rasters import densities, raster_density, raster_rgb
from ..sources.scratch import materialise
from ..streaming import jobs
from . import pipelines

P = LineParams()
SET = inks()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The raster of sources.rasters.raster_rgb, and its inks, for the second engine.
PX = """with axis as (select cast(range as int) v from range(64)),
cell as (select cast(floor(l_orderkey / 1500) as int) image_id, cast(l_orderkey % 64 as int) x, cast(l_partkey % 64 as int) y, avg(l_quantity)/50 r, avg(l_discount)/0.1 g, avg(l_tax)/0.08 b from lineitem group by 1, 2, 3),
imgs as (select distinct image_id from cell),
px as (select i.image_id, a.v x, o.v y, coalesce(r, 1.0) r, coalesce(g, 1.0) g, coalesce(b, 1.0) b from imgs i cross join axis a cross join axis o left join cell on cell.image_id = i.image_id and cell.x = a.v and cell.y = o.v),
ink as (select image_id, x, y, case when greatest(r,g,b) <= 0 then 0 else (greatest(r,g,b)-r)/greatest(r,g,b) end c, case when greatest(r,g,b) <= 0 then 0 else (greatest(r,g,b)-g)/greatest(r,g,b) end m, case when greatest(r,g,b) <= 0 then 0 else (greatest(r,g,b)-b)/greatest(r,g,b) end ye, 1-greatest(r,g,b) k from px),
den as (select image_id, 'c' channel, x, y, c d from ink union all select image_id, 'm', x, y, m from ink union all select image_id, 'y', x, y, ye from ink union all select image_id, 'k', x, y, k from ink)"""
R = lambda c, n=4: F.round(c, n)


@query(PX + " select image_id, x, y, round(r,6) r, round(g,6) g, round(b,6) b from px")
def raster_rgb_pixels(s: SparkSession, d: str) -> DataFrame:
    return raster_rgb(s, d).select("image_id", "x", "y", *(R(c, 6).alias(c) for c in "rgb"))


@query("""with e as (select cast(vec_id as int) y, i - 1 x, cast(embedding[i] as double) v from embeddings, unnest(range(1, 65)) t(i)), m as (select min(v) lo, max(v) hi from e)
select cast(x as int) x, y, round((v - lo) / (hi - lo), 6) d from e, m""")
def raster_density_pixels(s, d):
    return raster_density(s, d).select("x", "y", R("d", 6).alias("d"))


_LIN = lambda v: f"case when {v} <= 0.04045 then {v}/12.92 else pow(({v}+0.055)/1.055, 2.4) end"
_F = lambda v: f"case when {v} > 0.008856 then cbrt({v}) else 7.787*{v}+16.0/116.0 end"


@query(f"""{PX}, lin as (select *, {_LIN('r')} lr, {_LIN('g')} lg, {_LIN('b')} lb from px),
xyz as (select *, (0.4124564*lr+0.3575761*lg+0.1804375*lb)/0.95047 xx, 0.2126729*lr+0.7151522*lg+0.0721750*lb yy, (0.0193339*lr+0.1191920*lg+0.9503041*lb)/1.08883 zz from lin),
f as (select *, {_F('xx')} fx, {_F('yy')} fy, {_F('zz')} fz from xyz)
select f.image_id, f.x, f.y, round(c,10) c, round(m,10) m, round(ye,10) ye, round(k,10) k, round(116*fy-16,3) lab_l, round(500*(fx-fy),3) lab_a, round(200*(fy-fz),3) lab_b, round(0.2126*r+0.7152*g+0.0722*b,10) luma, round((1-c)*(1-k),7) back_r
from f join ink on f.image_id = ink.image_id and f.x = ink.x and f.y = ink.y""")
def color_scalars(s, d):
    px = raster_rgb(s, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    k, lab = color.cmyk(r, g, b), color.lab(r, g, b)
    back = color.rgb(**k)
    return px.select("image_id", "x", "y", *(R(k[a], 10).alias(n) for a, n in (("c", "c"), ("m", "m"), ("y", "ye"), ("k", "k"))), R(lab["L"], 3).alias("lab_l"), R(lab["a"], 3).alias("lab_a"), R(lab["b_"], 3).alias("lab_b"), R(color.luma(r, g, b), 10).alias("luma"), R(back["r"], 7).alias("back_r"))


@query("""with p as (select p_partkey, cast((p_partkey * 7) % 256 as int) r, cast((p_partkey * 13) % 256 as int) g, cast((p_size * 5) % 256 as int) b from part),
t as (select *, greatest(r,g,b)/255.0 top from p)
select p_partkey, r snap_r, g snap_g, b snap_b, printf('#%02x%02x%02x', r, g, b) hex, case when top <= 0 then 'C0 M0 Y0 K100' else concat('C', cast(round((top-r/255.0)/top*100) as int), ' M', cast(round((top-g/255.0)/top*100) as int), ' Y', cast(round((top-b/255.0)/top*100) as int), ' K', cast(round((1-top)*100) as int)) end inks from t""")
def palette_strings(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", *((v % 256).cast("int").alias(n) for n, v in (("r", F.col("p_partkey") * 7), ("g", F.col("p_partkey") * 13), ("b", F.col("p_size") * 5))))
    k = color.snapped(F.col("r"), F.col("g"), F.col("b"))
    q = p.select("p_partkey", *(k[n].alias(f"snap_{n}") for n in "rgb"), color.ink_text(k["c"], k["m"], k["y"], k["k"]).alias("inks"))
    return q.select("*", color.hex_colour(F.col("snap_r"), F.col("snap_g"), F.col("snap_b")).alias("hex"))


@query(PX + """, l as (select image_id, x, y, ye, k, c, m, pow(least(greatest((c-0.1)/0.8,0),1),1/1.5) lv from ink)
select image_id, x, y, round(lv,7) levels, round(least(greatest((1/(1+exp(-6*(c-0.5)))-1/(1+exp(3)))/(1/(1+exp(-3))-1/(1+exp(3))),0),1),7) scurve, round(case when m*8 < 0.5003 then 0 else least(greatest(m*8-0.3,0),7) end,7) cut,
round(case when k < 0.75 then 0 else pow(least(greatest((k-0.75)/0.25,0),1),2) end,7) deep, round(case when greatest(k-0.8*least(c,m,ye),0) < 0.75 then 0 else pow((greatest(k-0.8*least(c,m,ye),0)-0.75)/0.25,2) end,7) ucr,
round(((((x-32)*0.618034::double % 1)+1) % 1)*20,7) phase from l""")
def tone_scalars(s, d):
    px = raster_rgb(s, d)
    k = color.cmyk(F.col("r"), F.col("g"), F.col("b"))
    q = px.select("image_id", "x", F.col("y"), *(k[a].alias(f"i_{a}") for a in "cmyk"))
    p = LineParams(kerf=0.3, w_min=0.5003)
    return q.select("image_id", "x", "y", R(tone.levels(F.col("i_c"), 0.1, 0.9, 1.5), 7).alias("levels"), R(tone.scurve(F.col("i_c"), 6.0), 7).alias("scurve"), R(tone.cut_extent(F.col("i_m"), p, p.max_cut), 7).alias("cut"),
                    R(tone.deep_clip(F.col("i_k"), 0.75, 2.0), 7).alias("deep"), R(tone.effective_k(F.col("i_k"), [F.col("i_c"), F.col("i_m"), F.col("i_y")], p), 7).alias("ucr"), R(tone.bridge_phase(F.col("x") - 32, 20.0), 7).alias("phase"))


@query(PX + """, s as (select *, greatest(least(m,ye)-c,0) o, greatest(least(c,ye)-m,0) g from ink),
long as (select image_id, 'c' channel, greatest(c-g,0) d from s union all select image_id, 'm', greatest(m-o,0) from s union all select image_id, 'y', greatest(ye-o-g,0) from s union all select image_id, 'o', o from s union all select image_id, 'g', g from s union all select image_id, 'k', k from s)
select image_id, channel, count(*) n, round(sum(d),3) total from long group by 1, 2""")
def extended_inks(s, d):
    return densities(raster_rgb(s, d), inks("cmykog")).groupBy("image_id", "channel").agg(F.count("*").alias("n"), R(F.sum("d"), 3).alias("total"))


@query(PX + """, r as (select image_id, channel, d, row_number() over (partition by image_id, channel order by d) rn, count(*) over (partition by image_id, channel) n from den),
v as (select image_id, channel, max(case when rn = round(0.005*(n-1))+1 then d end) w, max(case when rn = round(0.995*(n-1))+1 then d end) b from r group by 1, 2)
select image_id, channel, round(case when w < b then w else 0 end,5) white, round(case when w < b then b else 1 end,5) black from v""")
def auto_levels(s, d):
    return filters.auto_levels(densities(materialise(raster_rgb(s, d), "raster"), SET)).select("image_id", "channel", R("white", 5).alias("white"), R("black", 5).alias("black"))


_INKS = "inks as (select * from (values ('c',15.0),('m',135.0),('y',0.0)) t(channel, angle))"
_SAMPLE = """tap as (select q.*, floor(least(greatest(px,0),63)) fx0, floor(least(greatest(py,0),63)) fy0, least(greatest(px,0),63) sx, least(greatest(py,0),63) sy from q where px >= 0 and px < 64 and py >= 0 and py < 64),
taps as (select *, dx, dy, cast(least(fx0+dx,63) as int) tx, cast(least(fy0+dy,63) as int) ty, (case when dx=1 then sx-fx0 else 1-(sx-fx0) end)*(case when dy=1 then sy-fy0 else 1-(sy-fy0) end) t from tap, (values (0,0),(1,0),(0,1),(1,1)) o(dx,dy))"""


@query(f"""{PX}, {_INKS}, n as (select cast(range as int) - 13 v from range(27)),
q as (select image_id, channel, a.v gi, o.v gj, 32 - a.v*8*sin(radians(angle)) + o.v*8*cos(radians(angle)) px, 32 + a.v*8*cos(radians(angle)) + o.v*8*sin(radians(angle)) py from imgs, inks, n a, n o),
{_SAMPLE}, v as (select taps.image_id, taps.channel, gi, gj, sum(t*d) d from taps join den on den.image_id = taps.image_id and den.channel = taps.channel and den.x = tx and den.y = ty group by 1,2,3,4),
r as (select image_id, channel, (case when d*8 < 0.5 then 0 else least(greatest(d*8,0),7) end)/2 r from v)
select image_id, channel, count(*) n, round(sum(r*r),3) total from r where r > 0 group by 1, 2""")
def dots_summary(s, d):
    """The flagship: rasters to inks to dots."""
    set_ = [i for i in SET if not i.tamed]
    p = LineParams(shape="dots")
    maps = screens.toned(densities(raster_rgb(s, d), set_), p, set_)
    return screens.dots(maps, p).groupBy("image_id", "channel").agg(F.count("*").alias("n"), R(F.sum(F.col("r") * F.col("r")), 3).alias("total"))


@query(f"""{PX}, {_INKS}, h as (select sqrt(64.0*64+64*64)/2+8 half), li as (select cast(range as int) - 7 li from range(15)), sg as (select cast(range as int) i from range(27)),
s0 as (select image_id, channel, angle, li, i, -half+i*4.0 v, least(-half+i*4.0+4, half) v2 from imgs, inks, h, li, sg where -half+i*4.0 < half and abs(li) <= ceil(half/8)),
q as (select *, 32 - li*8*sin(radians(angle)) + (v+v2)/2*cos(radians(angle)) px, 32 + li*8*cos(radians(angle)) + (v+v2)/2*sin(radians(angle)) py from s0),
{_SAMPLE}, d1 as (select taps.image_id, taps.channel, li, i, sum(t*d) d from taps join den on den.image_id = taps.image_id and den.channel = taps.channel and den.x = tx and den.y = ty group by 1,2,3,4),
hw as (select image_id, channel, li, i, (case when d*8 < 0.5 then 0 else least(greatest(d*8,0),7) end)/2 hw from d1),
g as (select *, i - row_number() over (partition by image_id, channel, li order by i) g from hw where hw > 0),
run as (select image_id, channel, li, g, count(*) n from g group by 1,2,3,4)
select image_id, channel, count(*) n_runs, sum(n)::bigint n_segments, max(n)::int longest from run group by 1, 2""")
def line_runs(s, d):
    set_ = [i for i in SET if not i.tamed]
    r = screens.runs(screens.widths(screens.toned(densities(raster_rgb(s, d), set_), P, set_), P), P)
    return r.groupBy("image_id", "channel").agg(F.count("*").alias("n_runs"), F.sum("n_segments").alias("n_segments"), F.max("n_segments").alias("longest"))


def _ribbons(shape: str):
    def f(s, d):
        p = LineParams(shape=shape, hatch_bins=3)
        return screens.screen(densities(raster_rgb(s, d), SET), p, SET).select("image_id", "channel", F.size("pts").alias("n_points"), R(regions.area(F.col("pts")), 5).alias("area"))

    f.__name__ = f"ribbons_{shape}"
    return f


for _shape in ("lines", "wavy", "dots", "bluenoise", "hatch"):
    query()(_ribbons(_shape))


@query(PX + """, q as (select image_id, channel, (a.v)::int gi, (o.v)::int gj, (a.v+0.5)*8 px, (o.v+0.5)*8 py from imgs, (values ('c'),('m'),('y')) c(channel), axis a, axis o where a.v < 8 and o.v < 8), """ + _SAMPLE + """,
v as (select taps.image_id, taps.channel, gi, gj, sum(t*d) d from taps join den on den.image_id = taps.image_id and den.channel = taps.channel and den.x = tx and den.y = ty group by 1,2,3,4)
select image_id, channel, gi, gj, round(case when d < 0.5/8 then 0 else d end, 4) t from v""")
def bluenoise_tones(s, d):
    set_ = [i for i in SET if not i.tamed]
    return screens.coarse_tones(screens.toned(densities(raster_rgb(s, d), set_), P, set_), P).select("image_id", "channel", "gi", "gj", R("t").alias("t"))


_K = ", ".join(f"({o},{w!r})" for o, w in filters.kernel(1.0))
_REFLECT = lambda e: f"case when {e} < 0 then -({e})-1 when {e} > 63 then 127-({e}) else {e} end"
_BLUR = lambda name, src, ks: f"""{name}_w as (select o, w from (values {ks}) t(o, w)), {name}_h as (select a.image_id, a.x, a.y, sum(w*b.d) d from {src} a cross join {name}_w join {src} b on b.image_id = a.image_id and b.y = a.y and b.x = {_REFLECT('a.x+o')} group by 1,2,3),
{name} as (select a.image_id, a.x, a.y, sum(w*b.d) d from {name}_h a cross join {name}_w join {name}_h b on b.image_id = a.image_id and b.x = a.x and b.y = {_REFLECT('a.y+o')} group by 1,2,3)"""  # noqa: E731


@query(f"{PX}, kd as (select image_id, x, y, k d from ink), {_BLUR('bl', 'kd', _K)} select image_id, x, y, round(d, 4) d from bl")
def gaussian_blur(s, d):
    k = densities(raster_rgb(s, d), SET).where("channel = 'k'")
    return filters.gaussian(k, 1.0).select("image_id", "x", "y", R("d").alias("d"))


_K2 = ", ".join(f"({o},{w!r})" for o, w in filters.kernel(2.0))


@query(f"{PX}, kd as (select image_id, x, y, k d from ink), {_BLUR('ba', 'kd', _K)}, {_BLUR('bb', 'kd', _K2)} select ba.image_id, ba.x, ba.y, case when ba.d - bb.d > 0.05 then 1.0::double else 0.0::double end d from ba join bb on ba.image_id = bb.image_id and ba.x = bb.x and ba.y = bb.y")
def dog_edges(s, d):
    return filters.dog_edges(densities(raster_rgb(s, d), SET).where("channel = 'k'"), 1.0, 2.0, 0.05).select("image_id", "x", "y", "d")


@query(PX + """, a as (select image_id, x, y, least(greatest(x,1),62) cx, least(greatest(y,1),62) cy from ink)
select a.image_id, a.x, a.y, round((e.k-w.k)/2,8) gx, round((s.k-n.k)/2,8) gy from a join ink e on e.image_id=a.image_id and e.x=cx+1 and e.y=cy join ink w on w.image_id=a.image_id and w.x=cx-1 and w.y=cy join ink s on s.image_id=a.image_id and s.x=cx and s.y=cy+1 join ink n on n.image_id=a.image_id and n.x=cx and n.y=cy-1""")
def gradients(s, d):
    return filters.gradients(densities(raster_rgb(s, d), SET).where("channel = 'k'")).select("image_id", "x", "y", R("gx", 8).alias("gx"), R("gy", 8).alias("gy"))


_DIST = PX + """, mk as (select image_id, x, y, c < 0.35 keep from ink), cut as (select * from mk where not keep),
dist as (select a.image_id, a.x, a.y, a.keep, coalesce(min(3*greatest(abs(a.x-c.x),abs(a.y-c.y))+least(abs(a.x-c.x),abs(a.y-c.y))),65531)::int dist from mk a left join cut c on c.image_id = a.image_id group by 1,2,3,4),
r1 as (select *, max(dist) over (partition by image_id, y order by x rows between 3 preceding and 3 following) m from dist),
ridge as (select *, max(m) over (partition by image_id, x order by y rows between 3 preceding and 3 following) ridge from r1)"""


def _c_mask(s, d):
    return densities(raster_rgb(s, d), SET).where("channel = 'c'").select("image_id", "x", "y", (F.col("d") < 0.35).alias("keep"))


@query(_DIST + " select image_id, x, y, dist, ridge from ridge")
def distance_ridge(s, d):
    return filters.max_filter(filters.distance(_c_mask(s, d), ["image_id"]), "dist", 3, ["image_id"]).select("image_id", "x", "y", "dist", "ridge")


@query(_DIST + """, g as (select image_id, avg(case when keep then 0.0 else 1.0 end) removed, percentile_disc(0.05) within group (order by least(ridge,511)) filter (where keep) p from ridge group by 1)
select image_id, round(removed,5) removed, round(coalesce(2*greatest(p/3.0-0.5,0),0),4) neck_px, case when coalesce(2*greatest(p/3.0-0.5,0),0) >= 2 then 'ok' when coalesce(2*greatest(p/3.0-0.5,0),0) >= 1 then 'thin' else 'fragile' end band from g""")
def stiffness(s, d):
    q = filters.stiffness(_c_mask(s, d), ["image_id"])
    return q.select("image_id", R("removed", 5).alias("removed"), R("neck_px").alias("neck_px"), tone.stiffness_band(F.col("neck_px")).alias("band"))


_POLY = """with c as (select p_partkey id, (p_partkey*7) % 60 + 2.37 cx, (p_partkey*11) % 60 + 2.41 cy, p_size/10.0 + 0.33 r from part),
p as (select id, k, cx + r*cos(2*pi()*k/9) x, cy + r*sin(2*pi()*k/9) y from c, (select cast(range as int) k from range(9)) n)"""


def _polygons(s, d):
    c = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ribbon_id"), (F.col("p_partkey") * 7 % 60 + 2.37).alias("cx"), (F.col("p_partkey") * 11 % 60 + 2.41).alias("cy"), (F.col("p_size") / 10 + 0.33).alias("r"))
    turn = lambda k: 2 * F.pi() * k / 9
    pts = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((F.col("cx") + F.col("r") * F.cos(turn(k))).alias("x"), (F.col("cy") + F.col("r") * F.sin(turn(k))).alias("y")))
    return c.select("ribbon_id", pts.alias("pts"))


@query(_POLY + """, e as (select a.id, a.x ax, a.y ay, b.x bx, b.y byy from p a join p b on b.id = a.id and b.k = (a.k+1) % 9),
rw as (select id, v.range y, ax + (v.range+0.5-ay)/(byy-ay)*(bx-ax) x from e, range(64) v where (ay <= v.range+0.5) <> (byy <= v.range+0.5)),
o as (select *, row_number() over (partition by id, y order by x) rn, lead(x) over (partition by id, y order by x) x2 from rw)
select id, count(*) n_pixels, sum(px.range + 64*y)::bigint checksum from o, range(64) px where rn % 2 = 1 and px.range >= x and px.range <= x2 group by 1""")
def scanline_fill(s, d):
    p = _polygons(s, d)
    frame = p.select("ribbon_id", F.col("ribbon_id").alias("id"), F.lit(64).alias("w"), F.lit(64).alias("h")).drop("ribbon_id")
    got = fill.fill(p.withColumn("id", F.col("ribbon_id")), frame, ["id"])
    return got.groupBy("id").agg(F.count("*").alias("n_pixels"), F.sum(F.col("x") + 64 * F.col("y")).cast("long").alias("checksum"))


@query(_POLY + ", a as (select id, k, x, y, lead(x, 1) over (partition by id order by k) x2, lead(y, 1) over (partition by id order by k) y2, first_value(x) over (partition by id order by k) x0, first_value(y) over (partition by id order by k) y0 from p) select id, round(0.5*sum(x*coalesce(y2,y0)-coalesce(x2,x0)*y),4) area, concat('M', string_agg(printf('%.3f %.3f', x, y), ' L' order by k), ' Z') path from a group by 1")
def ring_area_path(s, d):
    return _polygons(s, d).select(F.col("ribbon_id").alias("id"), R(regions.area(F.col("pts"))).alias("area"), svg.path_of_points(F.col("pts")).alias("path"))


_VALUES = ", ".join(f"('{c}',{v[1][0]!r}::double,{v[1][1]!r}::double,{v[1][2]!r}::double)" for c, v in INK_COLOURS.items())


@query(f"""{PX}, col as (select * from (values {_VALUES}) t(channel, r, g, b)), cut as (select image_id, channel, x, y from den where d > 0.40013),
mx as (select image_id, x, y, product(r) r, product(g) g, product(b) b from cut join col using (channel) group by 1,2,3)
select px.image_id, px.x, px.y, floor(coalesce(mx.r,1)*255+1e-9)::int r, floor(coalesce(mx.g,1)*255+1e-9)::int g, floor(coalesce(mx.b,1)*255+1e-9)::int b from px left join mx on mx.image_id = px.image_id and mx.x = px.x and mx.y = px.y""")
def ink_composite(s, d):
    px = materialise(raster_rgb(s, d), "raster")
    return fill.composite(densities(px, SET).where("d > 0.40013").drop("d"), screens.ink_table(s, SET), px.select("image_id", "x", "y"))


def _bytes(s, d):
    return raster_rgb(s, d).select("image_id", "x", "y", *(F.floor(F.least(F.col(c), F.lit(1.0)) * 255 / 16).cast("int").alias(c) for c in "rgb")).select("image_id", "x", "y", *((F.col(c) * 17).alias(c) for c in "rgb"))


_BYTES = PX + ", by8 as (select image_id, x, y, floor(least(r,1.0)*255/16)::int*17 r, floor(least(g,1.0)*255/16)::int*17 g, floor(least(b,1.0)*255/16)::int*17 b from px)"
_CENTRES = [(0, 20.0, 5.0, 5.0), (1, 45.0, -20.0, 10.0), (2, 70.0, 15.0, -15.0), (3, 95.0, 0.0, 0.0)]
_NEAR = f"""{_BYTES}, cl as (select image_id, r, g, b, count(*) n from by8 group by 1,2,3,4), u as (select *, r/255.0 ur, g/255.0 ug, b/255.0 ub from cl), lin as (select *, {_LIN('ur')} lr, {_LIN('ug')} lg, {_LIN('ub')} lb from u),
xyz as (select *, (0.4124564*lr+0.3575761*lg+0.1804375*lb)/0.95047 xx, 0.2126729*lr+0.7151522*lg+0.0721750*lb yy, (0.0193339*lr+0.1191920*lg+0.9503041*lb)/1.08883 zz from lin), f as (select *, {_F('xx')} fx, {_F('yy')} fy, {_F('zz')} fz from xyz),
lab as (select *, 116*fy-16 l, 500*(fx-fy) a, 200*(fy-fz) bb from f), cen as (select * from (values {', '.join(f'({i},{l},{a},{b})' for i, l, a, b in _CENTRES)}) t(label, cl, ca, cb)),
far as (select lab.*, label, cl, ca, cb, row_number() over (partition by image_id, r, g, b order by (l-cl)*(l-cl)+(a-ca)*(a-ca)+(bb-cb)*(bb-cb), label) rn from lab, cen), near as (select * from far where rn = 1)"""


def _centres(cols):
    few = F.array(*(F.struct(F.lit(i).alias("label"), F.lit(l).alias("L"), F.lit(a).alias("a"), F.lit(b).alias("b_")) for i, l, a, b in _CENTRES))
    return cols.select("image_id").distinct().select("image_id", F.inline(few))


@query(_NEAR + " select image_id, label, sum(n)::bigint n_pixels, count(*) n_colours from near group by 1, 2")
def nearest_palette(s, d):
    return quantize.nearest(quantize.colours(_bytes(s, d)), _CENTRES, ["n"]).groupBy("image_id", "label").agg(F.sum("n").alias("n_pixels"), F.count("*").alias("n_colours"))


@query(_NEAR + """, mean as (select image_id, label, sum(l*n)/sum(n) l, sum(a*n)/sum(n) a, sum(bb*n)/sum(n) b from near group by 1, 2)
select i.image_id, cen.label, round(coalesce(mean.l, cl),3) lab_l, round(coalesce(mean.a, ca),3) lab_a, round(coalesce(mean.b, cb),3) lab_b from imgs i cross join cen left join mean on mean.image_id = i.image_id and mean.label = cen.label""")
def lloyd_step(s, d):
    cols = materialise(quantize.colours(_bytes(s, d)), "colours")
    return quantize.lloyd_step(cols, _centres(cols)).select("image_id", "label", R("L", 3).alias("lab_l"), R("a", 3).alias("lab_a"), R("b_", 3).alias("lab_b"))


@query()
def quantized_palette(s, d):
    return quantize.palette(_bytes(s, d), 4).select("image_id", "label", "r", "g", "b")


@query(PX + """, t as (select image_id, x, y, floor(least(k,0.999)*4+0.0007)::int label from ink), e as (select a.image_id, a.label, b.label other, 'right' side from t a join t b on b.image_id=a.image_id and b.x=a.x+1 and b.y=a.y union all select a.image_id, a.label, b.label, 'below' from t a join t b on b.image_id=a.image_id and b.x=a.x and b.y=a.y+1)
select image_id, side, label, other, count(*) n from e group by 1,2,3,4""")
def adjacency(s, d):
    return regions.adjacency(_tones(s, d), "label", ["image_id"]).groupBy("image_id", "side", "label", "other").agg(F.count("*").alias("n"))


def _tones(s, d):
    k = densities(raster_rgb(s, d), SET).where("channel = 'k'")
    return k.select("image_id", "x", "y", F.floor(F.least(F.col("d"), F.lit(0.999)) * 4 + 0.0007).cast("int").alias("label"))


@query(PX + ", mk as (select image_id, c < 0.35 keep from ink) select image_id, -count(*)::bigint area from mk where keep group by 1")
def traced_area(s, d):
    """Signed areas of all traced rings: minus the kept pixels."""
    return regions.rings(_c_mask(s, d), ["image_id"]).groupBy("image_id").agg(F.round(F.sum(regions.area(F.col("pts")))).cast("long").alias("area"))


@query(PX + ", t as (select image_id, floor(least(k,0.999)*4+0.0007)::int layer from ink), l as (select range::int layer from range(4)) select i.image_id, l.layer, count(t.layer) n_kept from imgs i cross join l left join t on t.image_id = i.image_id and t.layer = l.layer group by 1, 2")
def stack_masks(s, d):
    return regions.stack_masks(_tones(s, d), [0, 1, 2, 3]).groupBy("image_id", "layer").agg(F.sum(F.col("keep").cast("long")).alias("n_kept"))


@query()
def components(s, d):
    return regions.components(_c_mask(s, d), ["image_id"]).groupBy("image_id").agg(F.countDistinct("comp").alias("n"), F.sum(F.col("touches_border").cast("int")).alias("border_pixels"))


@query()
def label_components(s, d):
    return regions.label_components(_tones(s, d), ["image_id"]).groupBy("image_id").agg(F.countDistinct("comp").alias("n"))


@query()
def merged_regions(s, d):
    return regions.merge_small_regions(_tones(s, d), 9, ["image_id"]).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query()
def bridged_islands(s, d):
    return regions.bridge_islands(_c_mask(s, d), 3.0, ["image_id"]).groupBy("image_id").agg(F.sum(F.col("keep").cast("int")).alias("kept"), F.max(F.size("warnings")).alias("n_warnings"))


_H = warp.homography([(0.0, 0.0), (48.0, 0.0), (48.0, 40.0), (0.0, 40.0)], [(3.1, 2.2), (60.3, 4.7), (57.9, 61.2), (5.4, 58.3)])


@query(f"""{PX}, o as (select image_id, a.v ox, b.v oy, ({_H[6]!r}::double*(a.v+0.5)+{_H[7]!r}::double*(b.v+0.5)+{_H[8]!r}::double) ww from imgs, axis a, axis b where a.v < 48 and b.v < 40),
q as (select image_id, ox, oy, ({_H[0]!r}::double*(ox+0.5)+{_H[1]!r}::double*(oy+0.5)+{_H[2]!r}::double)/ww-0.5 px, ({_H[3]!r}::double*(ox+0.5)+{_H[4]!r}::double*(oy+0.5)+{_H[5]!r}::double)/ww-0.5 py from o), {_SAMPLE}
select taps.image_id, ox x, oy y, round(sum(t*r*255))::int r, round(sum(t*g*255))::int g, round(sum(t*b*255))::int b from taps join px p on p.image_id = taps.image_id and p.x = tx and p.y = ty group by 1,2,3""")
def perspective_warp(s, d):
    px = materialise(raster_rgb(s, d).select("image_id", "x", "y", *((F.col(c) * 255).alias(c) for c in "rgb")), "raster")
    return warp.bake(px, _H, 48, 40)


@query("""with f as (select p_partkey id, p_size*10.0 w, (p_partkey % 37 + 5)*10.0 h from part), o as (select *, case when w > h then 297.0 else 210.0 end pw, case when w > h then 210.0 else 297.0 end ph from f)
select id, round(least((pw-20)/w,(ph-20)/h),5) scale, round((pw-w*least((pw-20)/w,(ph-20)/h))/2,4) off_x, round((ph-h*least((pw-20)/w,(ph-20)/h))/2,4) off_y from o""")
def paper_fit(s, d):
    f = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10.0).alias("w"), ((F.col("p_partkey") % 37 + 5) * 10.0).alias("h"))
    lay = svg.fit("A4", 10.0, F.col("w"), F.col("h"))
    return f.select("id", R(lay["scale"], 5).alias("scale"), R(lay["off_x"]).alias("off_x"), R(lay["off_y"]).alias("off_y"))


@query("select session, event_id, round(value, 4) value from (select user_id session, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def latest_jobs(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), "ts", "event_id", "value")
    return jobs.latest(e, "session", ["ts", "event_id"]).select("session", "event_id", R("value").alias("value"))


@query()
def halftone_report(s, d):
    got = pipelines.halftone(raster_rgb(s, d), P, SET).stiffness
    return got.select("image_id", "channel", R("removed").alias("removed"), R("neck_px", 3).alias("neck_px"), "band")


@query()
def halftone_sheets(s, d):
    return pipelines.halftone(raster_rgb(s, d), P, SET, "A4").sheets


@query()
def stencil_sheets(s, d):
    return pipelines.stencil(_bytes(s, d), StencilParams()).sheets
