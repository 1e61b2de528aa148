"""Queries that read voxels and labels around points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g, scalars, tensors
from ..operators import bricks, gather, selection
from ..registry import query
from ..session import scratch_path
from ..sources import volumes

BLOCK = gather.BlockOptions(shape=(4, 4, 4))
KEYS = ["face_id", "px", "py"]

ON_SURFACE = """
bad as (select distinct z.face_id, z.px + dx.i - 1 as px, z.py + dy.i - 1 as py
        from raster z, range(3) dx(i), range(3) dy(i) where z.mask = 0),
on_surface as (select r.* from raster r left join bad using (face_id, px, py)
               where bad.px is null and r.px >= 1 and r.py >= 1)"""

# Expects a table ``pts`` with x, y, z, nx, ny, nz and a distance ``d``.
PLACED = """
len as (select *, sqrt(nx * nx + ny * ny + nz * nz) as size from pts),
unit as (select *, case when size > 0 then nx / size else 0e0 end as a, case when size > 0 then ny / size else 0e0 end as b,
                case when size > 0 then nz / size else 1e0 end as c from len),
turn as (select *, case when c >= 0 then 1e0 / (1e0 + c) when a * a + b * b > 0 then (1e0 - c) / (a * a + b * b) end as k from unit),
placed as (select *, x + a * d as cx, y + b * d as cy, z + c * d as cz,
                  case when k is null then 0e0 else 1e0 - a * a * k end as bxx, case when k is null then 1e0 else -(a * b * k) end as bxy, -a as bxz,
                  case when k is null then 1e0 else -(a * b * k) end as byx, case when k is null then 0e0 else 1e0 - b * b * k end as byy, -b as byz,
                  a as bzx, b as bzy, c as bzz from turn)"""


def cells_sql(nz, ny, nx, rz="1e0", ry="1e0", rx="1e0"):
    def off(i, n):
        return f"trunc({i}.i - {(n - 1) / 2}e0 + 0.5e0)"

    def at(a):
        return f"c{a} + ox * bx{a} * {rx} + oy * by{a} * {ry} + oz * bz{a} * {rz} as q{a}"

    return f"""
offsets as (select (z.i * {ny} + y.i) * {nx} + x.i as cell, {off('z', nz)} as oz, {off('y', ny)} as oy, {off('x', nx)} as ox
            from range({nz}) z(i), range({ny}) y(i), range({nx}) x(i)),
cells as (select p.*, o.cell, {at('x')}, {at('y')}, {at('z')} from placed p, offsets o)"""


NEAREST = """
keyed as (select *, cast(trunc(qx + 0.5e0) as bigint) as kx, cast(trunc(qy + 0.5e0) as bigint) as ky, cast(trunc(qz + 0.5e0) as bigint) as kz from cells),
gathered as (select k.*, coalesce(v.v, 0) as v from keyed k left join voxels v on v.x = k.kx and v.y = k.ky and v.z = k.kz)"""

TRILINEAR = """
split as (select *, cast(trunc(qx) as bigint) as ix, cast(trunc(qy) as bigint) as iy, cast(trunc(qz) as bigint) as iz,
                 qx - trunc(qx) as dx, qy - trunc(qy) as dy, qz - trunc(qz) as dz from cells),
corners as (select s.*, cx.i as ux, cy.i as uy, cz.i as uz,
                   1e0 * (case cx.i when 1 then dx else 1e0 - dx end) * (case cy.i when 1 then dy else 1e0 - dy end) * (case cz.i when 1 then dz else 1e0 - dz end) as w
            from split s, range(2) cx(i), range(2) cy(i), range(2) cz(i)),
summed as (select c.face_id, c.px, c.py, c.cell, sum(c.w * coalesce(v.v, 0)) as s
           from corners c left join voxels v on v.x = ix + ux and v.y = iy + {row} and v.z = iz + uz group by all),
gathered as (select face_id, px, py, cell, ((cast(floor(s + 1e-6) as bigint) % 65536) + 65536) % 65536 as v from summed)"""

SELECTED = f"""{ON_SURFACE},
chosen as (select * from on_surface where px % 2 = 0 and py % 2 = 0),
pts as (select s.*, c.ink, 0e0 as d from chosen c join surface s using (face_id, px, py))"""

PER_POINT = "select {keys}, count(*) as n, sum(v) as sum_v, max(v) as max_v{more} from gathered group by {keys}"


def chosen_points(t):
    width, height = t.surface_size
    picked = selection.select_points(t.raster, (0, 0, width, height), selection.PointOptions(grid_spacing=2), width, height)
    return picked.select(*KEYS, "ink").join(t.surface, KEYS)


def nearest_with_label(t):
    """Selected surface pixels, their rotated blocks, and the ink label.

    The label rides along as a key, so points are selected once.
    """
    label = F.when(F.col("ink") != 0, 1).otherwise(0)
    points = chosen_points(t).withColumn("label", label)
    keys = [*KEYS, "label"]
    return gather.summarize(gather.gather(points, t.voxels, keys, BLOCK, t.volume_shape), keys, BLOCK.cells)


GATHER_SQL = f"""
with {SELECTED}, {PLACED}, {cells_sql(4, 4, 4)}, {NEAREST}
{PER_POINT.format(keys="face_id, px, py", more=", max(case when ink <> 0 then 1 else 0 end) as label")}"""

query("gather_nearest", "face_id:l px:l py:l n:l sum_v:l max_v:l label:l", GATHER_SQL, "voxels surface raster")(nearest_with_label)


def with_point_id(points):
    return points.withColumn("point_id", F.col("py").cast("bigint") * 50 + F.col("px")).withColumn("volume_id", F.lit(0))


def stored_bricks(t, edge):
    """The volume packed, written in brick order and read back."""
    path = scratch_path(t.spark, "bricks")
    bricks.write_bricks(bricks.pack_bricks(t.voxels, edge=edge), path)
    return bricks.read_bricks(t.spark, path)


@query("gather_bricks", "point_id:l n:l sum_v:l max_v:l", f"""
with {SELECTED}, {PLACED}, {cells_sql(8, 8, 8)}, {NEAREST}
select py * 50 + px as point_id, count(*) as n, sum(v) as sum_v, max(v) as max_v from gathered group by py * 50 + px""",
       "voxels surface raster")
def _(t):
    options = gather.BlockOptions(shape=(8, 8, 8))
    packed = stored_bricks(t, 16)
    return bricks.gather_summary(with_point_id(chosen_points(t)), packed, options, t.volume_shape, edge=16)


@query("gather_default_shape_all", "point_id:l n:l sum_v:l max_v:l")
def _(t):
    """Blocks of the default shape at every surface point; too many cells for SQL, so without a twin."""
    options = gather.BlockOptions(shape=(48, 48, 48))
    return bricks.gather_summary(with_point_id(t.surface), stored_bricks(t, 64), options, t.volume_shape)


@query("slices_to_bricks", "point_id:l n:l sum_v:l max_v:l", f"""
with {SELECTED}, {PLACED}, {cells_sql(8, 8, 8)}, {NEAREST}
select py * 50 + px as point_id, count(*) as n, sum(v) as sum_v, max(v) as max_v from gathered group by py * 50 + px""",
       "voxels surface raster")
def _(t):
    """From raw slice files to bricks without a row per voxel, stored, and read only where points lie."""
    raw, packed = scratch_path(t.spark, "slices"), scratch_path(t.spark, "bricks")
    volumes.write_slices(t.voxels, raw, t.volume_shape, {})
    bricks.write_bricks(volumes.pack_slices(t.spark, raw, edge=16), packed)
    options = gather.BlockOptions(shape=(8, 8, 8))
    return bricks.gather_summary(with_point_id(chosen_points(t)), bricks.read_bricks(t.spark, packed), options, t.volume_shape, edge=16)


@query("bricks_roundtrip", "volume_id:l z:l y:l x:l v:l", "select * from voxels where v <> 0", "voxels")
def _(t):
    return bricks.unpack_bricks(stored_bricks(t, 32), edge=32)


@query("gather_trilinear", "face_id:l px:l py:l n:l sum_v:l max_v:l", f"""
with pts as (select *, 0e0 as d from surface), {PLACED}, {cells_sql(4, 4, 4)}, {TRILINEAR.format(row="uy")}
{PER_POINT.format(keys="face_id, px, py", more="")}""", "voxels surface")
def _(t):
    options = gather.BlockOptions(shape=(4, 4, 4), method="interpolated")
    hits = gather.gather(t.surface, t.voxels, KEYS, options, t.volume_shape)
    return gather.summarize(hits, KEYS, options.cells)


@query("gather_trilinear_bricks", "point_id:l n:l sum_v:l max_v:l", f"""
with pts as (select *, 0e0 as d from surface), {PLACED}, {cells_sql(4, 4, 4)}, {TRILINEAR.format(row="uy")}
select py * 50 + px as point_id, count(*) as n, sum(v) as sum_v, max(v) as max_v from gathered group by all""", "voxels surface")
def _(t):
    options = gather.BlockOptions(shape=(4, 4, 4), method="interpolated")
    packed = stored_bricks(t, 16)
    return bricks.gather_summary(with_point_id(t.surface), packed, options, t.volume_shape, edge=16)


@query("gather_trilinear_compat", "face_id:l px:l py:l n:l sum_v:l max_v:l", f"""
with pts as (select *, 0e0 as d from surface), {PLACED}, {cells_sql(2, 2, 2)}, {TRILINEAR.format(row="case when ux = 1 and uz = 0 then 0 else uy end")}
{PER_POINT.format(keys="face_id, px, py", more="")}""", "voxels surface")
def _(t):
    options = gather.BlockOptions(shape=(2, 2, 2), method="interpolated", compat_corner=True)
    hits = gather.gather(t.surface, t.voxels, KEYS, options, t.volume_shape)
    return gather.summarize(hits, KEYS, options.cells)


@query("gather_moved_inverted", "face_id:l px:l py:l n:l sum_v:l max_v:l", f"""
with pts as (select face_id, px, py, x, y, z, case when px % 3 = 0 then -nx else nx end as nx, case when px % 3 = 0 then -ny else ny end as ny,
                    case when px % 3 = 0 then -nz else nz end as nz, 1.5e0 as d from surface), {PLACED}, {cells_sql(4, 4, 2)}, {NEAREST}
{PER_POINT.format(keys="face_id, px, py", more="")}""", "voxels surface")
def _(t):
    """Inverted normals (by source, here by column) and centres moved along them."""
    options = gather.BlockOptions(shape=(4, 4, 2), move_along_normal=1.5)
    points = gather.surface_points(t.surface, F.col("px") % 3 == 0)
    hits = gather.gather(points, t.voxels, KEYS, options, t.volume_shape)
    return gather.summarize(hits, KEYS, options.cells)


@query("gather_microns", "face_id:l px:l py:l n:l sum_v:l max_v:l", f"""
with pts as (select *, 0e0 as d from surface), {PLACED}, {cells_sql(2, 4, 4, "(30e0 / 2 / 10e0)", "(60e0 / 4 / 10e0)", "(60e0 / 4 / 10e0)")}, {NEAREST}
{PER_POINT.format(keys="face_id, px, py", more="")}""", "voxels surface")
def _(t):
    options = gather.BlockOptions(shape=(2, 4, 4), shape_microns=(30.0, 60.0, 60.0), voxel_microns=10.0)
    hits = gather.gather(t.surface, t.voxels, KEYS, options, t.volume_shape)
    return gather.summarize(hits, KEYS, options.cells)


@query("gather_jittered", "face_id:l px:l py:l n:l sum_v:l max_v:l", f"""
with pts as (select *, cast(((py * 50 + px) * 1103515245 + 67) % 2147483648 % 5 - 2 as double) as d from surface), {PLACED}, {cells_sql(2, 2, 2)}, {NEAREST}
{PER_POINT.format(keys="face_id, px, py", more="")}""", "voxels surface")
def _(t):
    options = gather.BlockOptions(shape=(2, 2, 2), jitter_max=2)
    points = with_point_id(t.surface)
    keys = ["point_id"]
    placed = gather.place_centers(points, options, keys, portable=True)
    hits = gather.nearest_hits(placed, t.voxels, keys, options, t.volume_shape)
    out = gather.summarize(hits, keys, options.cells)
    return out.select(F.lit(0).alias("face_id"), (F.col("point_id") % 50).alias("px"),
                      F.floor(F.col("point_id") / 50).alias("py"), "n", "sum_v", "max_v")


@query("sample_blocks", "face_id:l px:l py:l block:s", f"""
with {SELECTED}, {PLACED}, {cells_sql(2, 2, 2)}, {NEAREST}
select face_id, px, py, string_agg(cast(v as varchar), ',' order by cell) as block from gathered group by face_id, px, py""",
       "voxels surface raster")
def _(t):
    points = chosen_points(t)
    options = gather.BlockOptions(shape=(2, 2, 2))
    hits = gather.gather(points, t.voxels, KEYS, options, t.volume_shape)
    blocks = gather.as_blocks(hits, KEYS, options.cells)
    return blocks.withColumn("block", F.array_join(F.col("block").cast("array<string>"), ","))


@query("brick_blocks", "point_id:l bytes:l first_v:l", f"""
with {SELECTED}, {PLACED}, {cells_sql(4, 4, 4)}, {NEAREST}
select py * 50 + px as point_id, 128 as bytes, max(case when cell = 0 then v else 0 end) as first_v from gathered group by all""",
       "voxels surface raster")
def _(t):
    packed = stored_bricks(t, 16)
    out = bricks.gather_blocks(with_point_id(chosen_points(t)), packed, BLOCK, t.volume_shape, edge=16)
    low, high = (F.conv(F.hex(F.substring("block", i, 1)), 16, 10).cast("int") for i in (1, 2))
    return out.select("point_id", F.octet_length("block").alias("bytes"), (high * 256 + low).alias("first_v"))


@query("model_inputs", "face_id:l px:l py:l mean_v:d top_v:d", f"""
with {SELECTED}, {PLACED}, {cells_sql(2, 2, 2)}, {NEAREST}
select face_id, px, py, round(avg((v / 65535e0 - 0.5e0) / 0.5e0), 6) as mean_v, round(max((v / 65535e0 - 0.5e0) / 0.5e0), 6) as top_v
from gathered group by face_id, px, py""", "voxels surface raster")
def _(t):
    points = chosen_points(t)
    options = gather.BlockOptions(shape=(2, 2, 2))
    hits = gather.gather(points, t.voxels, KEYS, options, t.volume_shape)
    blocks = gather.as_blocks(hits, KEYS, options.cells)
    ready = blocks.withColumn("block", gather.finish_block(F.col("block"), options, ["px", "py"]))
    return ready.select(*KEYS, F.round(tensors.mean(F.col("block")), 6).alias("mean_v"),
                        F.round(F.array_max("block"), 6).alias("top_v"))


AXIS_ALIGNED = """
with p as (select px, py, case when abs(nx) >= abs(ny) and abs(nx) >= abs(nz) then 0 when abs(ny) >= abs(nz) then 1 else 2 end as axis, nx, ny, nz,
                  cast(round_even(x, 0) as bigint) as cx, cast(round_even(y, 0) as bigint) as cy, cast(round_even(z, 0) as bigint) as cz from surface),
q as (select *, case axis when 0 then nx < 0 when 1 then ny < 0 else nz < 0 end as turned from p),
cells as (select q.*, case when turned then 3 - a.i else a.i end as a, case when turned then 3 - b.i else b.i end as b, c.i as c
          from q, range(4) a(i), range(4) b(i), range(4) c(i)),
spot as (select px, py, cx, cy, cz,
       case axis when 0 then cx - 2 + a when 1 then cx - 2 + c else cx - 2 + c end as x,
       case axis when 0 then cy - 2 + b when 1 then cy - 2 + a else cy - 2 + b end as y,
       case axis when 0 then cz + 2 - 1 - c when 1 then cz + 2 - 1 - b else cz - 2 + a end as z from cells)
select px, py, count(*) as n, coalesce(sum(v.v), 0) as sum_v, coalesce(max(v.v), 0) as max_v
from spot cross join volume_shape s left join voxels v on v.x = spot.x and v.y = spot.y and v.z = spot.z
  and cx >= 2 and cy >= 2 and cz >= 2 and cx + 2 <= s.width and cy + 2 <= s.height and cz + 2 <= s.depth
group by px, py"""


@query("axis_aligned_blocks", "px:l py:l n:l sum_v:l max_v:l", AXIS_ALIGNED, "voxels surface volume_shape")
def _(t):
    hits = gather.axis_aligned(t.surface, t.voxels, ["px", "py"], (4, 4, 4), t.volume_shape)
    return gather.summarize(hits, ["px", "py"], BLOCK.cells)


@query("axis_aligned_bricks", "px:l py:l n:l sum_v:l max_v:l", AXIS_ALIGNED, "voxels surface volume_shape")
def _(t):
    """The same boxes from bricks, without a row per cell."""
    placed = bricks.place_axis_aligned(with_point_id(t.surface), (4, 4, 4), t.volume_shape)
    out = bricks.read_summary(placed, stored_bricks(t, 16), bricks.AXIS_ALIGNED, t.volume_shape, edge=16)
    return out.select((F.col("point_id") % 50).alias("px"), F.floor(F.col("point_id") / 50).alias("py"), "n", "sum_v", "max_v")


ANGLES = """
asked as (select request_id, cx as x, cy as y, cz as z, (request_id % 7) * 0.1e0 as ax, (request_id % 5) * 0.15e0 as ay, (request_id % 11) * 0.2e0 as az from requests),
trig as (select *, sin(ax) as sa, cos(ax) as ca, sin(ay) as sb, cos(ay) as cb, sin(az) as sc, cos(az) as cc from asked)"""


def angled(t):
    k = F.col("request_id")
    return t.requests.select(
        "request_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"),
        ((k % 7) * F.lit(0.1)).alias("ax"), ((k % 5) * F.lit(0.15)).alias("ay"), ((k % 11) * F.lit(0.2)).alias("az"),
    )


OBLIQUE = f"""
with {ANGLES},
spot as (select t.*, i.i as i, j.i as j, (i.i - 6) * 1e0 as u, (j.i - 6) * 1e0 as w from trig t, range(13) i(i), range(13) j(i)),
pos as (select *, cast(trunc((cb * cc * u + (sa * sb * cc - ca * sc) * w) / 2e0 + x) as bigint) as vx,
                  cast(trunc((cb * sc * u + (sa * sb * sc + ca * cc) * w) / 2e0 + y) as bigint) as vy,
                  cast(trunc((-sb * u + sa * cb * w) / 2e0 + z) as bigint) as vz from spot)
select p.request_id, j as row, i as col, coalesce(v.v, 0) as v
from pos p cross join volume_shape s left join voxels v
  on v.x = least(greatest(vx, 0), s.width - 1) and v.y = least(greatest(vy, 0), s.height - 1) and v.z = least(greatest(vz, 0), s.depth - 1)"""


@query("oblique_slice", "request_id:l row:l col:l v:l", OBLIQUE, "voxels requests volume_shape")
def _(t):
    radius = gather.slice_radius(30.0, 10.0, 2.0)
    return gather.oblique_slice(angled(t), t.voxels, ["request_id"], radius, 2.0, t.volume_shape)


@query("oblique_bricks", "request_id:l row:l col:l v:l", OBLIQUE, "voxels requests volume_shape")
def _(t):
    """The same planes from bricks; cells are rows only in the result."""
    radius = gather.slice_radius(30.0, 10.0, 2.0)
    planes = bricks.oblique_blocks(angled(t), stored_bricks(t, 16), "request_id", radius, 2.0, t.volume_shape, edge=16)
    side = 2 * radius + 1
    cells = bricks.unpack_blocks(planes)
    return cells.select(F.col("point_id").alias("request_id"), scalars.int_div(F.col("cell"), side).alias("row"), (F.col("cell") % side).alias("col"), "v")


@query("oblique_crossings", "request_id:l edge:l u:d w:d", f"""
with {ANGLES},
corner(n, u, w) as (values (0, -6e0, -6e0), (1, -6e0, 6e0), (2, 6e0, 6e0), (3, 6e0, -6e0)),
pos as (select request_id, n, x, y, z, trunc((cb * cc * u + (sa * sb * cc - ca * sc) * w) / 2e0 + x) as vx,
               trunc((cb * sc * u + (sa * sb * sc + ca * cc) * w) / 2e0 + y) as vy, trunc((-sb * u + sa * cb * w) / 2e0 + z) as vz from trig, corner)
select p.request_id, p.n as edge,
       round(case when sign(p.vz - p.z) <> sign(q.vz - q.z) then p.vx + (p.z - p.vz) / (q.vz - p.vz) * (q.vx - p.vx) else p.vx end, 6) as u,
       round(case when sign(p.vz - p.z) <> sign(q.vz - q.z) then p.vy + (p.z - p.vz) / (q.vz - p.vz) * (q.vy - p.vy) else p.vy end, 6) as w
from pos p join pos q on p.request_id = q.request_id and q.n = (p.n + 1) % 4
where sign(p.vz - p.z) <> sign(q.vz - q.z) or (p.vz = p.z and q.vz = q.z)""", "requests")
def _(t):
    corners = gather.oblique_corners(angled(t), ["request_id"], 6, 2.0)
    out = gather.plane_crossings(corners, ["request_id"], "z")
    return out.select("request_id", "edge", F.round("u", 6).alias("u"), F.round("w", 6).alias("w"))


@query("next_seeds", "request_id:l step:l next_x:l next_y:l next_z:l", f"""
with {ANGLES}, step(n, u, w) as (values (0, 1e0, 0e0), (1, 0e0, -1e0), (2, -1e0, 0e0), (3, 0e0, 1e0)),
spot as (select request_id, n as step,
       cast(trunc((cb * cc * u + (sa * sb * cc - ca * sc) * w) * 45e0 / 10e0 + x) as bigint) as next_x,
       cast(trunc((cb * sc * u + (sa * sb * sc + ca * cc) * w) * 45e0 / 10e0 + y) as bigint) as next_y,
       cast(trunc((-sb * u + sa * cb * w) * 45e0 / 10e0 + z) as bigint) as next_z from trig, step)
select spot.* from spot, volume_shape s where next_x between 0 and s.width - 1 and next_y between 0 and s.height - 1 and next_z between 0 and s.depth - 1""",
       "requests volume_shape")
def _(t):
    return gather.next_seeds(angled(t), ["request_id"], 45.0, 10.0, t.volume_shape)


@query("request_blocks", "request_id:l n:l sum_v:l max_v:l", """
with cells as (select r.request_id, cast(trunc(cx + ox.i - 2 + 0.5e0) as bigint) as x, cast(trunc(cy + oy.i - 2 + 0.5e0) as bigint) as y, cast(trunc(cz + oz.i - 1 + 0.5e0) as bigint) as z
               from requests r, range(5) ox(i), range(5) oy(i), range(3) oz(i))
select c.request_id, count(*) as n, coalesce(sum(v.v), 0) as sum_v, coalesce(max(v.v), 0) as max_v
from cells c left join voxels v on v.x = c.x and v.y = c.y and v.z = c.z group by c.request_id""", "voxels requests")
def _(t):
    hits = gather.request_blocks(t.requests, t.voxels, t.volume_shape)
    return gather.summarize(hits, ["request_id"], 75)


RADII = "1 + request_id % 40 as rx, 1 + request_id * 7 % 40 as ry, request_id % 4 as rz"


@query("request_bricks", "request_id:l nz:l ny:l nx:l bytes:l sum_v:l max_v:l", f"""
with r as (select request_id, cx, cy, cz, {RADII} from requests),
xs as (select request_id, cast(trunc(cx + o.i - rx + 0.5e0) as bigint) as x, count(*) as n from r, range(81) o(i) where o.i <= 2 * rx group by all),
ys as (select request_id, cast(trunc(cy + o.i - ry + 0.5e0) as bigint) as y, count(*) as n from r, range(81) o(i) where o.i <= 2 * ry group by all),
zs as (select request_id, cast(trunc(cz + o.i - rz + 0.5e0) as bigint) as z, count(*) as n from r, range(81) o(i) where o.i <= 2 * rz group by all),
s as (select request_id, sum(v * xs.n * ys.n * zs.n) as sum_v, max(v) as max_v
      from xs join ys using (request_id) join zs using (request_id) join voxels v on v.x = xs.x and v.y = ys.y and v.z = zs.z group by request_id)
select r.request_id, 2 * rz + 1 as nz, 2 * ry + 1 as ny, 2 * rx + 1 as nx, (2 * rz + 1) * (2 * ry + 1) * (2 * rx + 1) * 2 as bytes, coalesce(sum_v, 0) as sum_v, coalesce(max_v, 0) as max_v
from r left join s using (request_id)""", "voxels requests")
def _(t):
    """Packed blocks with radii from 1 to 40 that differ from request to request."""
    k = F.col("request_id")
    asked = t.requests.withColumns({"rx": 1 + k % 40, "ry": 1 + k * 7 % 40, "rz": k % 4})
    blocks = bricks.request_blocks(asked, stored_bricks(t, 16), t.volume_shape, edge=16)
    return bricks.block_sums(blocks).select(F.col("point_id").alias("request_id"), "nz", "ny", "nx", (F.col("n") * 2).alias("bytes"), "sum_v", "max_v")


# --- labels -----------------------------------------------------------------------


def label_patches(t, value, name):
    hits = gather.label_hits(t.surface, t.raster, KEYS, value, (3, 4))
    return gather.as_blocks(hits, KEYS, 12).select(
        *KEYS, F.array_join(F.col("block").cast("array<string>"), ",").alias(name)
    )


def patch_sql(value, name):
    return f"""
with cells as (select s.face_id, s.px, s.py, h.i * 4 + w.i as cell, s.px - 2 + w.i as x, s.py - 1 + h.i as y from surface s, range(3) h(i), range(4) w(i))
select c.face_id, c.px, c.py, string_agg(cast(coalesce({value}, 0) as varchar), ',' order by c.cell) as {name}
from cells c left join raster r on r.face_id = c.face_id and r.px = c.x and r.py = c.y group by c.face_id, c.px, c.py"""


@query("label_patch_ink", "face_id:l px:l py:l ink:s", patch_sql("case when r.ink <> 0 then 1 else 0 end", "ink"), "surface raster")
def _(t):
    return label_patches(t, F.when(F.col("ink") != 0, 1).otherwise(0), "ink")


@query("plane_labels", "face_id:l px:l py:l cells:l ink:l", f"""
with {ON_SURFACE}, chosen as (select * from on_surface where px % 4 = 0 and py % 4 = 0),
cells as (select s.face_id, s.px, s.py, s.px - 2 + w.i as x, s.py - 2 + h.i as y from chosen s, range(4) h(i), range(4) w(i))
select c.face_id, c.px, c.py, 16 as cells, coalesce(sum(case when r.ink <> 0 then 1 else 0 end), 0) as ink
from cells c left join raster r on r.face_id = c.face_id and r.px = c.x and r.py = c.y group by c.face_id, c.px, c.py""", "raster")
def _(t):
    """Labels for models that predict a plane: patch and grid spacing follow from the block's face."""
    block, patch, spacing = selection.two_dimensional(gather.BlockOptions(shape=(4, 4, 4), augment=True))
    points = selection.select_points(t.raster, (0, 0, *t.surface_size), selection.PointOptions(grid_spacing=spacing), *t.surface_size)
    hits = gather.label_hits(points.select(*KEYS), t.raster, KEYS, F.when(F.col("ink") != 0, 1).otherwise(0), patch)
    cells = F.lit(patch[0] * patch[1] if not block.augment else None)
    return gather.as_blocks(hits, KEYS, patch[0] * patch[1]).select(*KEYS, cells.alias("cells"), F.aggregate("block", F.lit(0), lambda a, v: a + v).alias("ink"))


@query("label_patch_texture", "face_id:l px:l py:l texture:s", patch_sql("r.texture", "texture"), "surface raster")
def _(t):
    return label_patches(t, F.col("texture"), "texture")


@query("label_patch_rgb", "face_id:l px:l py:l channel:l rgb:s", """
with channels as (select face_id, px, py, 0 as channel, r as v from raster union all select face_id, px, py, 1, g from raster union all select face_id, px, py, 2, b from raster),
cells as (select s.face_id, s.px, s.py, k.i as channel, h.i * 2 + w.i as cell, s.px - 1 + w.i as x, s.py - 1 + h.i as y from surface s, range(3) k(i), range(2) h(i), range(2) w(i))
select c.face_id, c.px, c.py, c.channel, string_agg(cast(coalesce(r.v, 0) as varchar), ',' order by c.cell) as rgb
from cells c left join channels r on r.face_id = c.face_id and r.px = c.x and r.py = c.y and r.channel = c.channel group by c.face_id, c.px, c.py, c.channel""",
       "surface raster")
def _(t):
    packed = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    hits = gather.label_hits(t.surface, t.raster, KEYS, packed, (2, 2))
    blocks = gather.as_blocks(hits, KEYS, 4)
    rows = blocks.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    shift = 16 - F.col("channel") * 8
    pixel = F.transform("block", lambda v: F.call_function("shiftright", v, shift) % 256)
    return rows.select(*KEYS, "channel", F.array_join(pixel.cast("array<string>"), ",").alias("rgb"))


@query("sample_metadata", "path:s surface_x:l surface_y:l x:d y:d z:d n_x:d n_y:d n_z:d", """
select src.path, s.px as surface_x, s.py as surface_y, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z,
       round(case when invert_normals then -nx else nx end, 6) as n_x, round(case when invert_normals then -ny else ny end, 6) as n_y,
       round(case when invert_normals then -nz else nz end, 6) as n_z
from surface s join sources src on src.type = 'region' and s.px >= src.x0 and s.px < src.x1 and s.py >= src.y0 and s.py < src.y1""",
       "surface sources")
def _(t):
    """Surface lookup with normals turned by the source's flag."""
    from ..operators.regions import in_boxes

    regions = t.sources.filter("type = 'region'").select("path", "invert_normals", "x0", "y0", "x1", "y1")
    inside = in_boxes(t.surface, regions, closed=False)
    turned = gather.surface_points(inside, F.col("invert_normals"))
    return turned.select(
        "path", F.col("px").alias("surface_x"), F.col("py").alias("surface_y"), *[F.round(a, 6).alias(a) for a in "xyz"],
        *[F.round(f"n{a}", 6).alias(f"n_{a}") for a in "xyz"],
    )


@query("basis_vectors", "px:l py:l xx:d xy:d xz:d yy:d yz:d zz:d", f"""
with pts as (select px, py, x, y, z, case when px % 2 = 0 then -nx else nx end as nx, case when px % 2 = 0 then -ny else ny end as ny,
                    case when px % 2 = 0 then -nz else nz end as nz, 0e0 as d from surface), {PLACED}
select px, py, round(bxx, 6) as xx, round(bxy, 6) as xy, round(bxz, 6) as xz, round(byy, 6) as yy, round(byz, 6) as yz, round(bzz, 6) as zz from placed""",
       "surface")
def _(t):
    n = g.sampling_normal(g.vec("nx", "ny", "nz"))
    b = g.basis_from_unit_normal(n)
    turned = gather.surface_points(t.surface, F.col("px") % 2 == 0)
    return turned.select("px", "py", *[F.round(c, 6).alias(name) for name, c in (
        ("xx", b.x.x), ("xy", b.x.y), ("xz", b.x.z), ("yy", b.y.y), ("yz", b.y.z), ("zz", b.z.z))])


@query("basis_quaternion", "px:l py:l xx:d xy:d xz:d yy:d yz:d zz:d", f"""
with pts as (select px, py, x, y, z, nx, ny, nz, 0e0 as d from surface), {PLACED}
select px, py, round(bxx, 6) as xx, round(bxy, 6) as xy, round(bxz, 6) as xz, round(byy, 6) as yy, round(byz, 6) as yz, round(bzz, 6) as zz from placed""",
       "surface")
def _(t):
    """The same axes through quaternions."""
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = g.with_quaternion_between(t.surface, g.Vec(zero, zero, one), g.vec("nx", "ny", "nz"), "q")
    x, y, z = g.quaternion_matrix([F.col(f"q{a}") for a in "wxyz"])
    clean = lambda c: F.round(c, 6) + 0.0
    return turned.select("px", "py", *[clean(c).alias(name) for name, c in (
        ("xx", x.x), ("xy", x.y), ("xz", x.z), ("yy", y.y), ("yz", y.z), ("zz", z.z))])


@query("vector_helpers", "px:l py:l axis:l angle:d px_dot:d cross_len:d", """
select px, py, case when abs(nx) > abs(ny) then case when abs(nx) > abs(nz) then 0 else 2 end else case when abs(ny) > abs(nz) then 1 else 2 end end as axis,
       round(acos(least(1e0, nz)), 6) as angle, 0e0 as px_dot, round(sqrt(nx * nx + ny * ny), 6) as cross_len from surface""", "surface")
def _(t):
    zero, one = F.lit(0.0), F.lit(1.0)
    n, up = g.vec("nx", "ny", "nz"), g.Vec(zero, zero, one)
    return t.surface.select(
        "px", "py", g.dominant_axis(n).alias("axis"), F.round(g.angle_between(n, up), 6).alias("angle"),
        F.abs(F.round(g.dot(n, g.orthogonal(n)), 6)).alias("px_dot"), F.round(g.length(g.cross(n, up)), 6).alias("cross_len"),
    )


@query("intensity_scalars", "px:l py:l unit:d signed:d high:l luma:l ink_px:l texture_px:l r_px:l", """
select px, py, round(texture / 65535e0, 6) as unit, round((texture / 65535e0 - 0.5e0) / 0.5e0, 6) as signed, texture // 256 as high,
       (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 as luma, cast(trunc(r / 255e0 * 65535) as bigint) as ink_px,
       cast(trunc(least(greatest(texture / 60000e0 * 65535, 0), 65535)) as bigint) as texture_px, cast(trunc(least(greatest(r / 200e0 * 255, 0), 255)) as bigint) as r_px
from raster""", "raster")
def _(t):
    unit = scalars.unit_from_uint16(F.col("texture"))
    return t.raster.select(
        "px", "py", F.round(unit, 6).alias("unit"), F.round(scalars.centered(unit), 6).alias("signed"),
        scalars.high_byte(F.col("texture")).alias("high"), scalars.grey(F.col("r"), F.col("g"), F.col("b")).alias("luma"),
        scalars.ink_pixel(F.col("r") / 255.0).alias("ink_px"), scalars.texture_pixel(F.col("texture") / 60000.0).alias("texture_px"),
        scalars.rgb_pixel(F.col("r") / 200.0).alias("r_px"),
    )
