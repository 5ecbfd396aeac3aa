"""More queries over whole tables, with SQL written from the definitions: ribbons, orientation, palettes, components, rings, curves, sheets and warps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tone
from ..operators import fill, filters, quantize, regions, screens, smooth, svg, warp
from ..params import LineParams, StencilParams
from ..sources.rasters import densities, raster_rgb
from ..sources.scratch import materialise
from . import pipelines
from .catalog import _BYTES, _F, _LIN, _POLY, _REFLECT, _SAMPLE, ORACLE_SQL, PX, SET, R, _bytes, _c_mask, _polygons, _tones, query

#: Maps of all four inks as the screens read them: black less the grey of the others, in its deep tones; angle, cap and the sampling of points q.
_MAPS = f"""{PX}, inks as (select * from (values ('c',15.0,7.0),('m',135.0,7.0),('y',0.0,7.0),('k',45.0,3.2)) t(channel, angle, cap)),
deep as (select image_id, x, y, greatest(k-0.8*least(c,m,ye),0) e from ink),
map as materialized (select * from den where channel <> 'k' union all select image_id, 'k', x, y, case when e < 0.75 then 0 else pow(least((e-0.75)/0.25,1),2) end from deep)"""
_VALUE = f"{_SAMPLE}, got as (select taps.image_id, taps.channel, taps.a, taps.b, sum(t*d) d from taps join map on map.image_id = taps.image_id and map.channel = taps.channel and map.x = tx and map.y = ty group by 1,2,3,4)"
_WIDTH = "case when d*8 < 0.5 then 0 else greatest(least(d*8, cap), 0) end"


def _lines(u: str) -> str:
    """Runs of cut segments (image, ink, line li, run g, segment i from v to v2, half width hw); u: displacement across at a distance along."""
    return f"""{_MAPS}, h as (select sqrt(64.0*64+64*64)/2+8 half), li as (select cast(range as int) - 7 li from range(15)), sg as (select cast(range as int) i from range(27)),
s0 as (select image_id, channel, angle, cap, li, i, -half+i*4.0 v, least(-half+i*4.0+4, half) v2 from imgs, inks, h, li, sg where -half+i*4.0 < half and abs(li) <= ceil(half/8)),
q as (select image_id, channel, li a, i b, 32 - ({u.format(v='((v+v2)/2)')})*sin(radians(angle)) + (v+v2)/2*cos(radians(angle)) px, 32 + ({u.format(v='((v+v2)/2)')})*cos(radians(angle)) + (v+v2)/2*sin(radians(angle)) py from s0),
{_VALUE}, hw as (select s0.*, {_WIDTH}/2 hw from got join s0 on s0.image_id = got.image_id and s0.channel = got.channel and li = a and i = b),
run as (select *, i - row_number() over (partition by image_id, channel, li order by i) g from hw where hw > 0)"""


ORACLE_SQL["ribbons_lines"] = _lines("li*8") + """, e as (select *, coalesce(lag(hw) over (partition by image_id, channel, li, g order by i), hw) hw0 from run)
select image_id, channel, (2*count(*)+2)::int n_points, round(sum((hw0+hw)*(v2-v)),5) area from e group by image_id, channel, li, g"""

_SHOELACE = """, o as (select *, lead(x) over w x2, lead(y) over w y2, first_value(x) over w x1, first_value(y) over w y1 from poly window w as (partition by image_id, channel, li, g order by pos))
select image_id, channel, count(*)::int n_points, round(0.5*sum(x*coalesce(y2,y1)-coalesce(x2,x1)*y),5) area from o group by image_id, channel, li, g"""

ORACLE_SQL["ribbons_wavy"] = _lines("li*8 + greatest(least(2.8,(8-cap)/2),0)*sin(2*pi()*{v}/32)") + """,
ends as (select image_id, channel, angle, cap, li, g, i, 1 late, v2 v, hw from run union all select image_id, channel, angle, cap, li, g, i, 0, v, hw from (select *, row_number() over (partition by image_id, channel, li, g order by i) n from run) where n = 1),
place as (select *, li*8 + greatest(least(2.8,(8-cap)/2),0)*sin(2*pi()*v/32) u, row_number() over (partition by image_id, channel, li, g order by i, late) n, count(*) over (partition by image_id, channel, li, g) total from ends),
knot as (select *, 32 - u*sin(radians(angle)) + v*cos(radians(angle)) kx, 32 + u*cos(radians(angle)) + v*sin(radians(angle)) ky from place),
step as (select *, coalesce(lead(kx) over w, kx) - coalesce(lag(kx) over w, kx) dx, coalesce(lead(ky) over w, ky) - coalesce(lag(ky) over w, ky) dy from knot window w as (partition by image_id, channel, li, g order by n)),
poly as (select image_id, channel, li, g, n pos, kx + hw*dy/greatest(sqrt(dx*dx+dy*dy),1e-6) x, ky - hw*dx/greatest(sqrt(dx*dx+dy*dy),1e-6) y from step union all
  select image_id, channel, li, g, 2*total+1-n, kx - hw*dy/greatest(sqrt(dx*dx+dy*dy),1e-6), ky + hw*dx/greatest(sqrt(dx*dx+dy*dy),1e-6) from step)""" + _SHOELACE

#: The ribbons' pixels by the even-odd rule, then distances to them, ridges and the lower twentieth, for every image and ink.
ORACLE_SQL["halftone_report"] = _lines("li*8") + """, ends as (select image_id, channel, angle, li, g, i, 1 late, v2 v, hw from run union all select image_id, channel, angle, li, g, i, 0, v, hw from (select *, row_number() over (partition by image_id, channel, li, g order by i) n from run) where n = 1),
knot as (select *, row_number() over w n, count(*) over (partition by image_id, channel, li, g) total from ends window w as (partition by image_id, channel, li, g order by i, late)),
flat as (select image_id, channel, angle, li, g, n pos, v, li*8-hw u from knot union all select image_id, channel, angle, li, g, 2*total+1-n, v, li*8+hw from knot),
poly as (select image_id, channel, li, g, pos, 32 - u*sin(radians(angle)) + v*cos(radians(angle)) x, 32 + u*cos(radians(angle)) + v*sin(radians(angle)) y from flat),
edge as (select image_id, channel, li, g, x ax, y ay, coalesce(lead(x) over w, first_value(x) over w) bx, coalesce(lead(y) over w, first_value(y) over w) byy from poly window w as (partition by image_id, channel, li, g order by pos)),
crossing as (select image_id, channel, li, g, r.range::int y, ax + (r.range+0.5-ay)/(byy-ay)*(bx-ax) x from edge, range(64) r where (ay <= r.range+0.5) <> (byy <= r.range+0.5)),
pair as (select *, row_number() over (partition by image_id, channel, li, g, y order by x) rn, lead(x) over (partition by image_id, channel, li, g, y order by x) x2 from crossing),
cut as materialized (select distinct image_id, channel, p.range::int x, y from pair, range(64) p where rn % 2 = 1 and p.range >= x and p.range <= x2),
mk as (select den.image_id, den.channel, den.x, den.y, cut.x is null keep from den left join cut on cut.image_id = den.image_id and cut.channel = den.channel and cut.x = den.x and cut.y = den.y),
dist as (select a.image_id, a.channel, a.x, a.y, a.keep, coalesce(min(3*greatest(abs(a.x-c.x),abs(a.y-c.y))+least(abs(a.x-c.x),abs(a.y-c.y))),65531)::int dist from mk a left join cut c on c.image_id = a.image_id and c.channel = a.channel group by 1,2,3,4,5),
r1 as (select *, max(dist) over (partition by image_id, channel, y order by x rows between 3 preceding and 3 following) m from dist),
ridge as (select *, max(m) over (partition by image_id, channel, x order by y rows between 3 preceding and 3 following) ridge from r1),
gr as (select image_id, channel, avg(case when keep then 0.0 else 1.0 end) removed, percentile_disc(0.05) within group (order by least(ridge,511)) filter (where keep) p from ridge group by 1, 2), nk as (select *, coalesce(2*greatest(p/3.0-0.5,0),0) neck from gr)
select image_id, channel, round(removed,4) removed, round(neck,3) neck_px, case when neck >= 2 then 'ok' when neck >= 1 then 'thin' else 'fragile' end band from nk"""

_CIRCLE = "greatest(least(ceil(2*pi()*r/1.5),48),8)"

ORACLE_SQL["ribbons_dots"] = f"""{_MAPS}, n as (select cast(range as int) - 13 v from range(27)),
q as (select image_id, channel, a.v a, o.v b, 32 - a.v*8*sin(radians(angle)) + o.v*8*cos(radians(angle)) px, 32 + a.v*8*cos(radians(angle)) + o.v*8*sin(radians(angle)) py from imgs, inks, n a, n o),
{_VALUE}, c as (select image_id, got.channel, {_WIDTH}/2 r from got join inks on inks.channel = got.channel)
select image_id, channel, {_CIRCLE}::int n_points, round(0.5*{_CIRCLE}*r*r*sin(2*pi()/{_CIRCLE}),5) area from c where r > 0"""

#: Errors of all 64 cells ride along as a list; a step visits the next cell of the serpentine and spreads its error.
_SPREAD = "case when x + ahead between 0 and 7 and j = y*8+x+ahead then e*7/16 when y < 7 and x - ahead between 0 and 7 and j = y*8+8+x-ahead then e*3/16 when y < 7 and j = y*8+8+x then e*5/16 when y < 7 and x + ahead between 0 and 7 and j = y*8+8+x+ahead then e/16 else 0 end"
ORACLE_SQL["ribbons_bluenoise"] = f"""with recursive {_MAPS.removeprefix('with ')}, q as (select image_id, channel, a.v a, o.v b, (a.v+0.5)*8 px, (o.v+0.5)*8 py from imgs, inks, axis a, axis o where a.v < 8 and o.v < 8), {_VALUE},
tones as (select image_id, channel, list(case when d < 0.5/8 then 0 else d end order by b, a) t from got group by 1, 2),
walk as (select image_id, channel, t, 0 step, list_transform(range(64), lambda j: 0.0::double) err, false dot from tones union all
  select image_id, channel, t, step + 1, list_transform(range(64), lambda j: err[j+1] + {_SPREAD}), e <> v from (select *, v - (case when v >= 0.5 then 1 else 0 end) e from
    (select *, t[y*8+x+1] + err[y*8+x+1] v from (select *, step // 8 y, case when (step // 8) % 2 = 0 then step % 8 else 7 - step % 8 end x, case when (step // 8) % 2 = 0 then 1 else -1 end ahead from walk where step < 64)))),
c as (select image_id, walk.channel, cap/2 r from walk join inks on inks.channel = walk.channel where dot)
select image_id, channel, {_CIRCLE}::int n_points, round(0.5*{_CIRCLE}*r*r*sin(2*pi()/{_CIRCLE}),5) area from c"""


def _blurred(name: str, source: str, value: str, sigma: float) -> str:
    ks = ", ".join(f"({o},{w!r}::double)" for o, w in filters.kernel(sigma))
    return f"""{name}_w as (select o, w from (values {ks}) t(o, w)), {name}_h as materialized (select a.image_id, a.x, a.y, sum(w*b.{value}) d from {source} a cross join {name}_w join {source} b on b.image_id = a.image_id and b.y = a.y and b.x = {_REFLECT('a.x+o')} group by 1,2,3),
{name} as materialized (select a.image_id, a.x, a.y, sum(w*b.d) d from {name}_h a cross join {name}_w join {name}_h b on b.image_id = a.image_id and b.x = a.x and b.y = {_REFLECT('a.y+o')} group by 1,2,3)"""


@query(f"""{PX}, pt as (select image_id, x, y, least(greatest(x,1),62) cx, least(greatest(y,1),62) cy from ink),
gr as materialized (select pt.image_id, pt.x, pt.y, (e.k-w.k)/2 gx, (s.k-n.k)/2 gy from pt join ink e on e.image_id=pt.image_id and e.x=cx+1 and e.y=cy join ink w on w.image_id=pt.image_id and w.x=cx-1 and w.y=cy join ink s on s.image_id=pt.image_id and s.x=cx and s.y=cy+1 join ink n on n.image_id=pt.image_id and n.x=cx and n.y=cy-1),
te as materialized (select image_id, x, y, gx*gx xx, gx*gy xy, gy*gy yy from gr), {_blurred('jx', 'te', 'xx', 2.0)}, {_blurred('jm', 'te', 'xy', 2.0)}, {_blurred('jy', 'te', 'yy', 2.0)},
th as (select jx.image_id, jx.x, jx.y, 0.5*atan2(2*jm.d, jx.d-jy.d) theta from jx join jm on jm.image_id=jx.image_id and jm.x=jx.x and jm.y=jx.y join jy on jy.image_id=jx.image_id and jy.x=jx.x and jy.y=jx.y)
select image_id, x, y, round(theta, 5) theta, least(floor((((theta/pi()) % 1) + 1) % 1 * 6), 5)::int bin from th""")
def orientation_bins(s, d):
    """Black's structure tensor; every pixel."""
    return filters.orientation(densities(raster_rgb(s, d), SET).where("channel = 'k'"), 2.0, 6).select("image_id", "x", "y", R("theta", 5).alias("theta"), "bin")


@query(PX + """, cut as (select image_id, channel, x, y from den where d > 0.9), n as (select range::int - 3 o from range(7))
select image_id, channel, (x + a.o)::int x, (y + b.o)::int y, round(min(sqrt(a.o*a.o+b.o*b.o)),6) near from cut, n a, n b where sqrt(a.o*a.o+b.o*b.o) <= 3.5 group by 1,2,3,4""")
def proximity(s, d):
    """Distances to the deep tones of all inks."""
    return screens.stamp_proximity(densities(raster_rgb(s, d), SET).where("d > 0.9"), 3.5).select("image_id", "channel", "x", "y", R("near", 6).alias("near"))


@query(PX + " select image_id, channel, x, y, not d > 0.40013 keep from den")
def ink_masks(s, d):
    px = materialise(raster_rgb(s, d), "raster")
    return fill.masks(densities(px, SET).where("d > 0.40013"), px.select("image_id", "x", "y"), [i.channel for i in SET])


@query(PX + ", t as (select image_id, x, y, floor(least(k,0.999)*4+0.0007)::int label from ink) select image_id, x, y, (case when label = 3 then 255 else label*40 end)::int r, (case when label = 3 then 255 else label*50 end)::int g, (case when label = 3 then 255 else 10 end)::int b from t")
def stencil_colours(s, d):
    """Layers 0 to 2 in their colours; what layer 3 would keep stays white."""
    tones = materialise(_tones(s, d), "tones")
    palette = tones.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("label"))
    palette = palette.select("image_id", "label", (F.col("label") * 40).alias("r"), (F.col("label") * 50).alias("g"), F.lit(10).alias("b"))
    return fill.stencil_preview(regions.stack_masks(tones, [0, 1, 2]), palette, tones.select("image_id", "x", "y"))


_ROUNDS = 20
_DISTANCE = "(l-cl)*(l-cl)+(a-ca)*(a-ca)+(bb-cb)*(bb-cb)"


def _kmeans(k: int) -> str:
    out = f"""{_BYTES}, cl as (select image_id, r, g, b, count(*) n, min(y*64+x) first from by8 group by 1,2,3,4), u as (select *, r/255.0 ur, g/255.0 ug, b/255.0 ub from cl), lin as (select *, {_LIN('ur')} lr, {_LIN('ug')} lg, {_LIN('ub')} lb from u),
xyz as (select *, (0.4124564*lr+0.3575761*lg+0.1804375*lb)/0.95047 xx, 0.2126729*lr+0.7151522*lg+0.0721750*lb yy, (0.0193339*lr+0.1191920*lg+0.9503041*lb)/1.08883 zz from lin), f as (select *, {_F('xx')} fx, {_F('yy')} fy, {_F('zz')} fz from xyz),
lab as materialized (select *, 116*fy-16 l, 500*(fx-fy) a, 200*(fy-fz) bb from f), rk as (select *, sum(n) over (partition by image_id order by l, first) upto, sum(n) over (partition by image_id) total from lab),
c0 as materialized (select image_id, j.range::int label, l cl, a ca, bb cb from rk, range({k}) j where floor(j.range*(total-1)/{k}) < upto and floor(j.range*(total-1)/{k}) >= upto - n)"""
    for i in range(_ROUNDS):
        out += f""", n{i} as materialized (select image_id, arg_min(label, ({_DISTANCE}, label)) label, r, g, b, any_value(l) l, any_value(a) a, any_value(bb) bb, any_value(n) n from lab join c{i} using (image_id) group by image_id, r, g, b),
c{i + 1} as materialized (select c{i}.image_id, c{i}.label, coalesce(ml, cl) cl, coalesce(ma, ca) ca, coalesce(mb, cb) cb from c{i} left join (select image_id, label, sum(l*n)/sum(n) ml, sum(a*n)/sum(n) ma, sum(bb*n)/sum(n) mb from n{i} group by 1, 2) m using (image_id, label))"""
    return out + f""", fin as (select image_id, arg_min(label, ({_DISTANCE}, label)) label, r, g, b, any_value(n) n from lab join c{_ROUNDS} using (image_id) group by image_id, r, g, b),
mean as (select image_id, label, floor(sum(r*n)/sum(n))::int r, floor(sum(g*n)/sum(n))::int g, floor(sum(b*n)/sum(n))::int b from fin group by 1, 2),
every as (select image_id, label, coalesce(r, 0) r, coalesce(g, 0) g, coalesce(b, 0) b from c{_ROUNDS} left join mean using (image_id, label))
select image_id, (row_number() over (partition by image_id order by 0.2126*r+0.7152*g+0.0722*b, label) - 1)::int label, r, g, b from every"""


ORACLE_SQL["quantized_palette"] = _kmeans(4)


def _connected(cells: str, same: str = "") -> str:
    """Component number (its smallest place) of every cell of a table (image_id, x, y and what same compares)."""
    return f"""cc(image_id, x, y, v, l) using key (image_id, x, y) as (select image_id, x, y, v, y*64+x from {cells} union
  select r.image_id, r.x, r.y, r.v, min(c.l) from (select image_id, x + dx nx, y + dy ny, v, l from cc, (values (1,0),(-1,0),(0,1),(0,-1)) o(dx, dy)) c join recurring.cc r on r.image_id = c.image_id and r.x = nx and r.y = ny and r.v = c.v where c.l < r.l group by 1,2,3,4)"""


_KEPT = f"with recursive {PX.removeprefix('with ')}, kept as (select image_id, x, y, 1 v from ink where c < 0.35), {_connected('kept')}"
ORACLE_SQL["components"] = _KEPT + """, t as (select image_id, l, max((x in (0,63) or y in (0,63))::int) border, count(*) n from cc group by 1, 2)
select image_id, count(*) n, sum(border*n)::bigint border_pixels from t group by 1"""
ORACLE_SQL["label_components"] = f"with recursive {PX.removeprefix('with ')}, cells as (select image_id, x, y, floor(least(k,0.999)*4+0.0007)::int v from ink), {_connected('cells')} select image_id, count(distinct l) n from cc group by 1"


@query(_KEPT + """, corner as (select image_id, vx.range::int vx, vy.range::int vy from imgs, range(65) vx, range(65) vy),
near as (select c.image_id, vx, vy, count(k.x) n, coalesce(sum(case when (k.x = vx) = (k.y = vy) then 1 else 0 end), 0) diagonal from corner c left join kept k on k.image_id = c.image_id and k.x in (vx-1, vx) and k.y in (vy-1, vy) group by 1,2,3),
e as (select image_id, sum(case when n in (1,3) then 1 when n = 2 and diagonal in (0,2) then 2 else 0 end) n_points, (sum(case n when 1 then 1 when 3 then -1 else 0 end) + 2*sum(case when n = 2 and diagonal in (0,2) then 1 else 0 end))/4 euler from near group by 1),
t as (select image_id, count(distinct l) outers from cc group by 1)
select e.image_id, outers, (outers - euler)::bigint holes, n_points::bigint n_points from e join t on t.image_id = e.image_id""")
def ring_counts(s, d):
    """Outer rings are the kept components; the Euler number of the corners' patterns gives the holes, and the bends their points."""
    kind = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"{k}s")
    return regions.rings(_c_mask(s, d), ["image_id"]).groupBy("image_id").agg(kind("outer"), kind("hole"), F.sum(F.size("pts")).alias("n_points"))


@query("""with p as (select p_partkey id, p_size/50.0 d, (p_partkey % 256)::int ch from part), t as (select id, ch, least(greatest((d-0.1)/0.7,0),1) t, 1-ch/255.0 i from p), l as (select id, pow(t, 1/1.4) lv, pow(least(greatest((i-0.2)/0.6,0),1), 1/0.8) bl from t)
select id, round(least(greatest((1/(1+exp(-5*(lv-0.5)))-1/(1+exp(2.5)))/(1/(1+exp(-2.5))-1/(1+exp(2.5))),0),1),7) tone, round(least(greatest(1-bl,0),1)*255)::int byte from l""")
def tone_curves(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    got = tone.tone(F.col("p_size") / 50.0, LineParams(white=0.1, black=0.8, gamma=1.4, scurve=5.0))
    return p.select(F.col("p_partkey").alias("id"), R(got, 7).alias("tone"), tone.byte_levels((F.col("p_partkey") % 256).cast("int"), 0.2, 0.8, 0.8).alias("byte"))


_PRE = f"""{_BYTES}, {', '.join(_blurred('b' + c, 'by8', c, 0.8) for c in 'rgb')}, lv as (select br.image_id, br.x, br.y, round(br.d) r, round(bg.d) g, round(bb.d) b from br join bg using (image_id, x, y) join bb using (image_id, x, y))"""


@query(_PRE + " select image_id, x, y, " + ", ".join(f"round(least(greatest(1-pow(least(greatest((1-{c}/255.0-0.1)/0.8,0),1),1/1.3),0),1)*255)::int {c}" for c in "rgb") + " from lv")
def prepared_pixels(s, d):
    """Blur, then levels, before colours are counted."""
    return pipelines.prepared(materialise(_bytes(s, d), "bytes"), StencilParams(blur_px=0.8, white=0.1, black=0.9, gamma=1.3))


_CURVE = _POLY + """, n as (select id, k, x, y, lag(x, 1) over w lx, lag(y, 1) over w ly, lead(x, 1) over w nx, lead(y, 1) over w ny, last_value(x) over w ex, last_value(y) over w ey, first_value(x) over w fx, first_value(y) over w fy from p window w as (partition by id order by k rows between unbounded preceding and unbounded following)),
m as (select id, k, x, y, coalesce(lx,ex) bx, coalesce(ly,ey) byy, coalesce(nx,fx) ax, coalesce(ny,fy) ay from n),
u as (select *, sqrt((x-bx)^2+(y-byy)^2) lb, sqrt((ax-x)^2+(ay-y)^2) la from m), d as (select *, least(greatest(((x-bx)*(ax-x)+(y-byy)*(ay-y))/(lb*la),-1),1) dot from u),
t as (select *, (case when acos(dot) > 1 then 0 else greatest(dot,0) end)*(ax-bx)/6 tx, (case when acos(dot) > 1 then 0 else greatest(dot,0) end)*(ay-byy)/6 ty from d),
s as (select t.id, t.k, t.x, t.y, o.x ox, o.y oy, least(greatest(t.x+t.tx,least(t.x,o.x)),greatest(t.x,o.x)) c1x, least(greatest(t.y+t.ty,least(t.y,o.y)),greatest(t.y,o.y)) c1y,
  least(greatest(o.x-o.tx,least(t.x,o.x)),greatest(t.x,o.x)) c2x, least(greatest(o.y-o.ty,least(t.y,o.y)),greatest(t.y,o.y)) c2y from t join t o on o.id = t.id and o.k = (t.k+1) % 9)"""


@query(_CURVE + " select id, count(*) n_segs, round(sum(c1x*(k+1)+c2x*(k+2)),6) xs, round(sum(c1y*(k+1)+c2y*(k+2)),6) ys, round(sum(ox*(k+1)+oy),6) ends, concat('M', any_value(printf('%.3f %.3f', x, y)) filter (where k = 0), string_agg(printf(' C%.3f %.3f %.3f %.3f %.3f %.3f', c1x, c1y, c2x, c2y, ox, oy), '' order by k), ' Z') path from s group by id")
def smooth_curves(s, d):
    got = _polygons(s, d).withColumn("curve", smooth.curve(F.col("pts"), 1e-9))
    total = lambda f: F.aggregate(F.transform("curve.segs", f), F.lit(0.0), lambda a, v: a + v)
    return got.select(F.col("ribbon_id").alias("id"), F.size("curve.segs").cast("long").alias("n_segs"), R(total(lambda q, k: q["c1"]["x"] * (k + 1) + q["c2"]["x"] * (k + 2)), 6).alias("xs"),
                      R(total(lambda q, k: q["c1"]["y"] * (k + 1) + q["c2"]["y"] * (k + 2)), 6).alias("ys"), R(total(lambda q, k: q["p"]["x"] * (k + 1) + q["p"]["y"]), 6).alias("ends"), svg.path_of_curve(F.col("curve")).alias("path"))


_WOBBLY = "with recursive p as (select p_partkey id, k, 30 + (8+3*sin(1.7*k*(p_partkey % 11 + 1)))*cos(2*pi()*k/24) x, 30 + (8+3*sin(1.7*k*(p_partkey % 11 + 1)))*sin(2*pi()*k/24) y from part, (select range::int k from range(24)) n)"


@query(_WOBBLY + """, w as (select id, k, x, y from p union all select id, 24, x, y from p where k = 0), far as (select p.id, arg_max(p.k, (sqrt((p.x-o.x)^2+(p.y-o.y)^2), p.k)) k from p join p o on o.id = p.id and o.k = 0 group by 1),
seg(id, a, b) as (select id, 0, k from far union all select id, k, 24 from far union all
  select id, unnest([a, m]), unnest([m, b]) from (select g.id, g.a, g.b, arg_max(w.k, (abs((q.x-o.x)*(w.y-o.y)-(q.y-o.y)*(w.x-o.x))/sqrt((q.x-o.x)^2+(q.y-o.y)^2), -w.k)) m, max(abs((q.x-o.x)*(w.y-o.y)-(q.y-o.y)*(w.x-o.x))/sqrt((q.x-o.x)^2+(q.y-o.y)^2)) e
    from seg g join w on w.id = g.id and w.k > g.a and w.k < g.b join w o on o.id = g.id and o.k = g.a join w q on q.id = g.id and q.k = g.b group by 1,2,3) where e > 1.3)
select id, count(distinct a) n_kept, sum(distinct a)::bigint places from seg group by 1""")
def simplified_rings(s, d):
    """Rings of 24 points that wobble, simplified to within 1.3; which places stay."""
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, kept = b.column(0).to_pylist(), []
            for i in ids:
                ring = [(30 + (8 + 3 * math.sin(1.7 * k * (i % 11 + 1))) * math.cos(2 * math.pi * k / 24), 30 + (8 + 3 * math.sin(1.7 * k * (i % 11 + 1))) * math.sin(2 * math.pi * k / 24)) for k in range(24)]
                kept.append([ring.index(p) for p in smooth.simplify_ring(ring, 1.3)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, kept)), pa.int64()), pa.array(list(map(sum, kept)), pa.int64())], names=["id", "n_kept", "places"])

    return part.mapInArrow(run, "id long, n_kept long, places long")


_PLUS = "'<path stroke=\"red\" fill=\"none\" d=\"M' || {0} || '\"/>'"
_POINT = lambda x, y: f"printf('%.3f %.3f', ({x})::double, ({y})::double)"
_CROSS = lambda x, y, m: _PLUS.format(f"{_POINT(f'{x}-{m}', y)} || ' L' || {_POINT(f'{x}+{m}', y)} || ' M' || {_POINT(x, f'{y}-{m}')} || ' L' || {_POINT(x, f'{y}+{m}')}")
_PATHS = _POLY + ", a as (select id, concat('M', string_agg(printf('%.3f %.3f', x, y), ' L' order by k), ' Z') path from p group by id), body as (select id // 5 sheet, string_agg(path, ' ' order by id) d from a group by 1)"


def _sheets(s, d):
    rib = _polygons(s, d).select(F.floor(F.col("ribbon_id") / 5).cast("long").alias("sheet"), "ribbon_id", "pts")
    return rib, rib.select("sheet", F.lit(60).alias("w"), F.lit(80).alias("h")).distinct()


@query(_PATHS + f""" select sheet, '<svg xmlns="http://www.w3.org/2000/svg" width="60px" height="80px" viewBox="0 0 60 80"><path fill="black" fill-rule="evenodd" d="' || d || '"/>' || {_CROSS('0', '0', '5')} || {_CROSS('60', '0', '5')} || {_CROSS('0', '80', '5')} || '</svg>' svg from body""")
def pixel_sheets(s, d):
    return svg.ribbons_svg(*_sheets(s, d), ["sheet"])


_HOLE = lambda x, y: f"{_CROSS(x, y, '3')} || printf('<circle cx=\"%.3f\" cy=\"%.3f\" r=\"3.000\" fill=\"none\" stroke=\"red\"/>', ({x})::double, ({y})::double)"


@query(_PATHS + f""", g as (select *, least(190.0/60, 277.0/80) sc from body), l as (select *, (210-60*sc)/2 ox, (297-80*sc)/2 oy, least(greatest(3+(210-least(60*sc,80*sc))/4, 5), 12) i from g)
select sheet, '<svg xmlns="http://www.w3.org/2000/svg" width="210.000mm" height="297.000mm" viewBox="0 0 210.000 297.000">' || printf('<g transform="translate(%.3f %.3f) scale(%.6f)">', ox, oy, sc) || '<path fill="black" fill-rule="evenodd" d="' || d || '"/></g>'
  || {_HOLE('i', 'i')} || {_HOLE('i', '297-i')} || {_HOLE('210-i', 'i')} || {_HOLE('210-i', '297-i')} || printf('<text x="%.3f" y="%.3f" font-size="4">%s</text>', i*2, 297-i, sheet::varchar) || '</svg>' svg from l""")
def paper_sheets(s, d):
    return svg.ribbons_svg(*_sheets(s, d), ["sheet"], "A4", 10.0, 3.0)



@query("""with q as (select range::int i from range(60)), c as (select i, j, (case when j in (1, 2) then 48.0 else 0 end) x, (case when j in (2, 3) then 40.0 else 0 end) y, (case when j in (1, 2) then 30 else 0 end) + (i % 7)*1.5 + (i*(j+1)) % 5 u, (case when j in (2, 3) then 40 else 0 end) + (i % 3)*2.5 + (i*(j+2)) % 4 v from q, (select range::int j from range(4)))
select i quad, j corner, round(u, 6) u, round(v, 6) v from c""")
def homography_corners(s, d):
    """Sixty quadrangles: the corners go where they should."""
    rows = []
    dst = [(0.0, 0.0), (48.0, 0.0), (48.0, 40.0), (0.0, 40.0)]
    for i in range(60):
        src = [((30 if j in (1, 2) else 0) + i % 7 * 1.5 + i * (j + 1) % 5, (40 if j in (2, 3) else 0) + i % 3 * 2.5 + i * (j + 2) % 4) for j in range(4)]
        rows += [(i, j, *map(float, warp.homography(dst, src)), x, y) for j, (x, y) in enumerate(dst)]
    df = s.createDataFrame(rows, "quad int, corner int, " + ", ".join(f"h{k} double" for k in range(9)) + ", x double, y double")
    u, v = warp.project([F.col(f"h{k}") for k in range(9)], F.col("x"), F.col("y"))
    return df.select("quad", "corner", R(u, 6).alias("u"), R(v, 6).alias("v"))


@query(f"""{PX}, q as (select image_id, a.v ox, b.v oy, 6.4832 + (a.v+0.5)*51.2512/51 - 0.5 px, 13.0368 + (b.v+0.5)*35.0848/35 - 0.5 py from imgs, axis a, axis b where a.v < 51 and b.v < 35), {_SAMPLE}
select taps.image_id, ox x, oy y, round(sum(t*r*254.7))::int r, round(sum(t*g*254.7))::int g, round(sum(t*b*254.7))::int b from taps join px p on p.image_id = taps.image_id and p.x = tx and p.y = ty group by 1,2,3""")
def cropped_pixels(s, d):
    px = materialise(raster_rgb(s, d).select("image_id", "x", "y", *((F.col(c) * 254.7).alias(c) for c in "rgb")), "raster")
    return warp.crop_and_warp(px, 64, 64, crop=(0.1013, 0.2037, 0.9021, 0.7519))


@query("""with c as (select range::int i, (range*37 % 140 - 20)/100.0 x0, (range*53 % 140 - 20)/100.0 x1 from range(400)), o as (select i, least(greatest(least(x0,x1),0),1) a, least(greatest(greatest(x0,x1),0),1) b from c),
f as (select i, a, case when b - a < 0.02 then least(a+0.02, 1) else b end b from o) select i crop, round(case when b - a < 0.02 then least(a, b-0.02) else a end, 9) a, round(b, 9) b from f""")
def crop_bounds(s, d):
    rows = [(i, *warp.normalize_crop((i * 37 % 140 - 20) / 100, 0.0, (i * 53 % 140 - 20) / 100, 1.0)) for i in range(400)]
    return s.createDataFrame([(i, round(a, 9), round(b, 9)) for i, a, _, b, _ in rows], "crop int, a double, b double")
