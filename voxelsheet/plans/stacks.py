"""Queries over volumes and slabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import datasets, sketches, stacks, stencils
from ..registry import query
from ..session import materialize, scratch_path
from ..sources import stacks as stack_files
from ..tables import N_SLABS, SLAB_DEPTH


@query("voxels_from_lineitem", "volume_id:l z:l y:l x:l v:l", "select * from voxels", "voxels")
def _(t):
    return t.voxels


@query("volume_crop", "z:l y:l x:l v:l",
       "select z - 1 as z, y - 5 as y, x - 10 as x, v from voxels where x >= 10 and x < 90 and y >= 5 and y < 75 and z >= 1 and z < 6", "voxels")
def _(t):
    return stacks.crop(t.voxels, (10, 5, 1, 90, 75, 6))


@query("volume_trim", "z:l y:l x:l v:l", "select z - 2 as z, y, x, v from voxels where z between 2 and 5", "voxels")
def _(t):
    return stacks.trim(t.voxels, 2, 5)


@query("axis_slice", "axis:s idx:l row:l col:l v:l", """
with z as (select 'z' as axis, 2 as idx, r.i as row, c.i as col, coalesce(v.v, 0) as v from volume_shape s, lateral (select unnest(range(s.height)) as i) r, lateral (select unnest(range(s.width)) as i) c
           left join voxels v on v.z = 2 and v.y = r.i and v.x = c.i),
y as (select 'y' as axis, 5 as idx, r.i as row, c.i as col, coalesce(v.v, 0) as v from volume_shape s, lateral (select unnest(range(s.depth)) as i) r, lateral (select unnest(range(s.width)) as i) c
           left join voxels v on v.y = 5 and v.z = r.i and v.x = c.i),
x as (select 'x' as axis, 17 as idx, r.i as row, c.i as col, coalesce(v.v, 0) as v from volume_shape s, lateral (select unnest(range(s.depth)) as i) r, lateral (select unnest(range(s.height)) as i) c
           left join voxels v on v.x = 17 and v.z = r.i and v.y = c.i),
o as (select 'z' as axis, 99 as idx, r.i as row, c.i as col, 0 as v from volume_shape s, lateral (select unnest(range(s.height)) as i) r, lateral (select unnest(range(s.width)) as i) c)
select * from z union all select * from y union all select * from x union all select * from o""", "voxels volume_shape")
def _(t):
    planes = [("z", 2), ("y", 5), ("x", 17), ("z", 99)]
    out = None
    for axis, index in planes:
        plane = stacks.axis_slice(t.voxels, axis, index, t.volume_shape).withColumns({"axis": F.lit(axis), "idx": F.lit(index)})
        out = plane if out is None else out.unionByName(plane)
    return out


@query("volume_8bit", "z:l y:l x:l v:l", "select z, y, x, v // 256 as v from voxels", "voxels")
def _(t):
    return stacks.eight_bit(t.voxels)


@query("downsample_volume", "z:l y:l x:l v:l", """
select z // 2 as z, y // 2 as y, x // 2 as x, sum(v) // 4 as v from voxels, volume_shape s
where z % 2 = 0 and y < s.height // 2 * 2 and x < s.width // 2 * 2 group by z // 2, y // 2, x // 2""", "voxels volume_shape")
def _(t):
    return stacks.downsample(t.voxels, 2, t.volume_shape)


@query("downsample_metadata", "slices:l height:l width:l voxelsize:d name:s power_of_two:b", """
select 4 as slices, height // 2 as height, width // 2 as width, 20e0 as voxelsize, 'scan, downscaled 2x' as name, bit_count(width) = 1 as power_of_two from volume_shape""",
       "volume_shape")
def _(t):
    sizes = t.raw("supplier").agg((F.max("s_suppkey") + 1).alias("height"))
    meta = sizes.withColumns({"slices": F.lit(7), "width": F.lit(128), "voxelsize": F.lit(10.0), "name": F.lit("scan"), "uuid": F.lit("0")})
    checked = meta.withColumn("power_of_two", scalars.is_power_of_two(F.col("width")))
    return stacks.downsampled_metadata(checked, 2, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("slice_extract", "slab:l z:l y:l x:l v:l number:l combined_name:s own_name:s", """
with d as (select slab, max(z) + 1 as depth from slabs group by slab),
b as (select *, coalesce(sum(depth) over (order by slab rows between unbounded preceding and 1 preceding), 0) as before, sum(depth) over () as total from d)
select s.slab, s.z, s.y, s.x, cast(trunc(least(greatest((raw - 100000e0) / (9000000e0 - 100000e0) * (65535e0 - 0e0) + 0e0, 0e0), 65535e0)) as bigint) as v,
       before + z as number, concat(lpad(cast(before + z as varchar), cast(length(cast(total as varchar)) as int), '0'), '.tif') as combined_name,
       concat(lpad(cast(z as varchar), cast(length(cast(depth as varchar)) as int), '0'), '.tif') as own_name
from slabs s join b using (slab) where z % 3 = 0 and x >= 2 and x < 7 and y >= 4""", "slabs")
def _(t):
    """Crop with open ends, stride, re-window and names in one pass over the pixels."""
    kept = stacks.crop_slices(t.slabs, min_x=2, width=5, min_y=4)
    named = stacks.slice_numbers(t.slabs.select("slab", "z").distinct(), "slab", 3)
    windowed = stacks.rewindow(kept.withColumnRenamed("raw", "v"), "v", (100000.0, 9000000.0))
    return windowed.join(named, ["slab", "z"])


STACK_SIZES = """
size as (select k as slab, 40 - 3 * k as depth, coalesce(sum(40 - 3 * k) over (order by k rows between unbounded preceding and 1 preceding), 0) as before,
                sum(40 - 3 * k) over () as total from range(6) r(k)),
cells as (select size.slab, depth, before, total, z.z as z, y.y as y, x.x as x, coalesce(s.raw, 0) as raw
          from size cross join range(40) z(z) cross join range(16) y(y) cross join range(8) x(x) left join slabs s on s.slab = size.slab and s.z = z.z and s.y = y.y and s.x = x.x where z.z < depth)"""


def stored_stacks(t):
    """The slabs as stacks of falling depth, one file each."""
    path = scratch_path(t.spark, "stacks")
    cells = t.slabs.filter(F.col("z") < SLAB_DEPTH - 3 * F.col("slab")).select(
        F.concat(F.lit("slab"), "slab").alias("stack"), "z", "y", "x", F.col("raw").alias("v"))
    stack_files.write_stacks(cells, path, [(f"slab{k}", SLAB_DEPTH - 3 * k, 16, 8) for k in range(N_SLABS)])
    return path


@query("stack_scan", "stack:s z:l y:l x:l v:l number:l combined_name:s own_name:s", f"""
with {STACK_SIZES}
select concat('slab', cast(slab as varchar)) as stack, z, y, x, cast(trunc(least(greatest((raw - 100000e0) / (9000000e0 - 100000e0) * 65535e0, 0e0), 65535e0)) as bigint) as v,
       before + z as number, concat(lpad(cast(before + z as varchar), cast(length(cast(total as varchar)) as int), '0'), '.tif') as combined_name,
       concat(lpad(cast(z as varchar), cast(length(cast(depth as varchar)) as int), '0'), '.tif') as own_name
from cells where z % 3 = 0 and x >= 2 and x < 7 and y >= 4 and before + z >= 10""", "slabs")
def _(t):
    """Stacks written and read back: crop, stride and range decide which bytes are read; then windowed and named."""
    path = stored_stacks(t)
    kept = stacks.crop_slices(stack_files.read_stacks(t.spark, path, stride=3), min_x=2, width=5, min_y=4).filter("number >= 10")
    windowed = stacks.rewindow(kept.withColumn("v", F.col("v").cast("double")), "v", (100000.0, 9000000.0))
    return stacks.name_slices(windowed, stack_files.sizes(t.spark, path))


@query("stack_roundtrip", "stack:s ordinal:l z:l number:l y:l x:l v:l", f"""
with {STACK_SIZES} select concat('slab', cast(slab as varchar)) as stack, slab as ordinal, z, before + z as number, y, x, raw as v from cells""", "slabs")
def _(t):
    return stack_files.read_stacks(t.spark, stored_stacks(t))


@query("slice_renumber", "slab:l z:l number:l combined_name:s own_name:s", """
with s as (select distinct slab, z from slabs), d as (select slab, max(z) + 1 as depth from s group by slab),
b as (select *, coalesce(sum(depth) over (order by slab rows between unbounded preceding and 1 preceding), 0) as before, sum(depth) over () as total from d)
select slab, z, before + z as number, concat(lpad(cast(before + z as varchar), cast(length(cast(total as varchar)) as int), '0'), '.tif') as combined_name,
       concat(lpad(cast(z as varchar), cast(length(cast(depth as varchar)) as int), '0'), '.tif') as own_name from s join b using (slab) where z % 4 = 0""", "slabs")
def _(t):
    return stacks.slice_numbers(t.slabs.select("slab", "z").distinct(), "slab", 4)


def percentile_sql(percents: dict[str, int], tables: str = "slabs") -> str:
    """Twin of the percentiles: per slice, whole hundredths by rank."""
    at = lambda p, more: f"max(case when i = ((n - 1) * {p} + {more}) // 100 then raw end)"
    parts = ", ".join(f"{at(p, 0)} * 100 + ({at(p, 99)} - {at(p, 0)}) * max((n - 1) * {p} % 100) as {name}" for name, p in percents.items())
    return f"""ranked as (select slab, z, raw, row_number() over (partition by slab, z order by raw) - 1 as i, count(*) over (partition by slab, z) as n from {tables}),
p as (select slab, z, {parts} from ranked group by slab, z)"""


def mean_sql(name: str, digits: int) -> str:
    return f"cast((sum({name}) * {2 * 10 ** (digits - 2)} + count({name})) // (2 * count({name})) as double) / {10 ** digits}e0"


@query("window_rescale", "slab:l z:l y:l x:l v:l", f"""
with {percentile_sql(dict(low=5, high=95))},
w as (select {mean_sql('low', 3)} as a, {mean_sql('high', 3)} as b from p)
select slab, z, y, x, cast(trunc(least(greatest((raw - a) / (b - a) * (65535e0 - 0e0) + 0e0, 0e0), 65535e0)) as bigint) as v from slabs, w""", "slabs")
def _(t):
    """Percentile window from the data, both bounds from one scalar subquery."""
    window = stacks.auto_window(t.slabs, ["slab", "z"], "raw", 5, 95, 65536, digits=3)
    bounds = window.select(F.struct("window_min", "window_max")).scalar()
    return stacks.rewindow(t.slabs.withColumnRenamed("raw", "v"), "v", (bounds["window_min"], bounds["window_max"]))


@query("auto_window", "window_min:d window_max:d", f"""
with {percentile_sql(dict(low=1, high=99))}
select {mean_sql('low', 4)} as window_min, {mean_sql('high', 4)} as window_max from p""", "slabs")
def _(t):
    return stacks.auto_window(t.slabs, ["slab", "z"], "raw", 1, 99, 65536)


DRAWN = "draws as (select event_id as step, user_id % 6 as slab, event_id % 40 as z from events)"


def drawn(t):
    return t.raw("events").select(
        F.col("event_id").alias("step"), (F.col("user_id") % N_SLABS).cast("int").alias("slab"), (F.col("event_id") % SLAB_DEPTH).cast("int").alias("z")
    )


@query("drawn_window", "window_min:d window_max:d", f"""
with {percentile_sql(dict(low=1, high=99))}, {DRAWN}
select {mean_sql('low', 4)} as window_min, {mean_sql('high', 4)} as window_max from draws join p using (slab, z)""", "slabs")
def _(t):
    """Slices drawn with replacement."""
    return stacks.auto_window(t.slabs, ["slab", "z"], "raw", 1, 99, 65536, drawn(t))


SKETCHED = """
ordered as (select slab, z, list_sort(list(raw)) as v from slabs group by slab, z),
bounds as (select slab, z, v[greatest(1, cast(ceil(0.02e0 * len(v)) as bigint))] as low, v[greatest(1, cast(ceil(0.98e0 * len(v)) as bigint))] as high from ordered)"""


@query("sketched_window", "window_min:d window_max:d", f"""
with {SKETCHED}, {DRAWN} select round(avg(low), 3) as window_min, round(avg(high), 3) as window_max from draws join bounds using (slab, z)""", "slabs")
def _(t):
    """The window of a drawn sample from stored sketches; slices are scanned once, for the sketches."""
    stored = materialize(sketches.slice_sketches(t.slabs, ["slab", "z"], "raw"), "sketches")
    found = sketches.window(stored, 0.02, 0.98, drawn(t), ["slab", "z"])
    return found.select(*[F.round(c, 3).alias(c) for c in found.columns])


@query("sketched_quantiles", "slab:l z:l n:l low:l middle:l high:l", """
select slab, z, len(v) as n, v[greatest(1, cast(ceil(0.02e0 * len(v)) as bigint))] as low, v[greatest(1, cast(ceil(0.5e0 * len(v)) as bigint))] as middle,
       v[greatest(1, cast(ceil(0.98e0 * len(v)) as bigint))] as high from (select slab, z, list_sort(list(raw)) as v from slabs group by slab, z) q""", "slabs")
def _(t):
    return sketches.quantiles(sketches.slice_sketches(t.slabs, ["slab", "z"], "raw"), {"low": 0.02, "middle": 0.5, "high": 0.98})


BLUR = f"""
kernel(o, w) as (values {', '.join(f'({k - 12}, {w!r}e0)' if 'e' not in repr(w) else f'({k - 12}, {w!r})' for k, w in enumerate(stencils.gaussian_weights(3.0)))}),
dense as (select z.i as z, y.i as y, x.i as x, coalesce(v.v, 0) as v from volume_shape s, range(7) z(i), lateral (select unnest(range(s.height)) as i) y, range(128) x(i)
          left join voxels v on v.z = z.i and v.y = y.i and v.x = x.i),
down_at as (select z, y, x, w, ((y + o) % (2 * s.height) + 2 * s.height) % (2 * s.height) as m, s.height as n from dense, kernel, volume_shape s),
down as (select a.z, a.y, a.x, cast(floor(sum(w * d.v) + 1e-6) as bigint) as v from down_at a join dense d on d.z = a.z and d.x = a.x and d.y = case when m < n then m else 2 * n - 1 - m end group by all),
over_at as (select z, y, x, w, ((x + o) % 256 + 256) % 256 as m from down, kernel),
blurred as (select a.z, a.y, a.x, cast(floor(sum(w * d.v) + 1e-6) as bigint) as v from over_at a join down d on d.z = a.z and d.y = a.y and d.x = case when m < 128 then m else 255 - m end group by all)"""


@query("gaussian_blur", "z:l y:l x:l v:l", f"with {BLUR} select * from blurred", "voxels volume_shape")
def _(t):
    _, height, width = t.volume_shape
    return stencils.gaussian_blur(t.voxels, ["z"], "v", width, height, 3.0, px="x", py="y")


@query("slice_stats", "z:l min:l max:l mean:d blurred_min:l blurred_max:l blurred_mean:d", f"""
with {BLUR}, a as (select z, min(v) as min, max(v) as max, round(avg(v), 6) as mean from dense group by z),
b as (select z, min(v) as blurred_min, max(v) as blurred_max, round(avg(v), 6) as blurred_mean from blurred group by z) select * from a join b using (z)""",
       "voxels volume_shape")
def _(t):
    return volume_stats(t).withColumns({"mean": F.round("mean", 6), "blurred_mean": F.round("blurred_mean", 6)})


def volume_stats(t):
    _, height, width = t.volume_shape
    return stacks.raw_and_blurred_stats(t.voxels, ["z"], "v", width, height, 3.0, px="x", py="y")


@query("global_stats", "min:l max:l mean:d blurred_min:l blurred_max:l blurred_mean:d", f"""
with {BLUR}, a as (select z, min(v) as a, max(v) as b, avg(v) as c from dense group by z),
b as (select z, min(v) as d, max(v) as e, avg(v) as f from blurred group by z)
select min(a) as min, max(b) as max, round(avg(c), 6) as mean, min(d) as blurred_min, max(e) as blurred_max, round(avg(f), 6) as blurred_mean from a join b using (z)""",
       "voxels volume_shape")
def _(t):
    return stacks.global_stats(volume_stats(t)).withColumns({"mean": F.round("mean", 6), "blurred_mean": F.round("blurred_mean", 6)})


@query("slice_draws", "step:l slab:l z:l window_min:d", f"""
with {percentile_sql(dict(low=1))}, d as (select i as step, (i * 1103515245 + 12345 * 4 + 67) % 2147483648 / 2147483648e0 as u, (i * 1103515245 + 12345 * 5 + 67) % 2147483648 / 2147483648e0 as w
  from (select unnest(range((select count(*) // 10 from events))) as i) q),
f as (select slab, max(z) + 1 as depth, row_number() over (order by slab) as rn, count(*) over () as n from slabs group by slab),
drawn_at as (select step, slab, cast(floor(w * depth) as bigint) as z from d join f on f.rn = cast(floor(u * n) as bigint) + 1)
select step, a.slab, a.z, low / 100e0 as window_min from drawn_at a left join p on p.slab = a.slab and p.z = a.z""", "slabs")
def _(t):
    """A file, then one of its slices, drawn with replacement; with the slice's low percentile."""
    drawn_at = datasets.draw_slices(stacks.depths(t.slabs, "slab").select("slab", "depth"), t.raw("events").count() // 10, 4, portable=True)
    tails = stacks.exact_percentiles(t.slabs, ["slab", "z"], "raw", {"low": 1}, 65536)
    return drawn_at.join(tails, ["slab", "z"], "left").withColumn("window_min", F.col("low") / 100.0)


SLAB_BLUR = f"""
taps(o, w) as (values {', '.join(f'({k - 12}, {w!r}e0)' if 'e' not in repr(w) else f'({k - 12}, {w!r})' for k, w in enumerate(stencils.gaussian_weights(3.0)))}),
full_slabs as (select s.i as slab, z.i as z, y.i as y, x.i as x, coalesce(v.raw, 0) as v from (select distinct slab, z from slabs) k join range(6) s(i) on s.i = k.slab join range(40) z(i) on z.i = k.z,
               range(16) y(i), range(7) x(i) left join slabs v on v.slab = s.i and v.z = z.i and v.y = y.i and v.x = x.i + 1),
slab_down as (select a.slab, a.z, a.y, a.x, cast(floor(sum(w * d.v) + 1e-6) as bigint) as v from (select *, ((y + o) % 32 + 32) % 32 as m from full_slabs, taps) a
              join full_slabs d on d.slab = a.slab and d.z = a.z and d.x = a.x and d.y = case when m < 16 then m else 31 - m end group by all),
slab_blur as (select a.slab, a.z, a.y, a.x, cast(floor(sum(w * d.v) + 1e-6) as bigint) as v from (select *, ((x + o) % 14 + 14) % 14 as m from slab_down, taps) a
              join slab_down d on d.slab = a.slab and d.z = a.z and d.y = a.y and d.x = case when m < 7 then m else 13 - m end group by all),
six as (select slab, z, min(f.v) as low, max(f.v) as high, any_value(c1) / 100e0 as p1, any_value(c99) / 100e0 as p99, any_value(b.low) as b_low, any_value(b.high) as b_high
        from full_slabs f join q using (slab, z) join (select slab, z, min(v) as low, max(v) as high from slab_blur group by slab, z) b using (slab, z) group by slab, z)"""
SIX_SQL = f"{percentile_sql(dict(c1=1, c99=99)).replace('p as (', 'q as (')},{SLAB_BLUR}"


def slab_image(t):
    return t.slabs.select("slab", "z", F.col("y").alias("py"), (F.col("x") - 1).alias("px"), F.col("raw").alias("v"))


def six_extremes(t):
    """Per slice: extremes (absent pixels are 0), 1 % and 99 % percentile of the pixels there are, extremes of the blur."""
    tails = stacks.exact_percentiles(t.slabs, ["slab", "z"], "raw", {"p1": 1, "p99": 99}, 65536)
    stats = stencils.raw_and_blurred(slab_image(t), ["slab", "z"], "v", 7, 16)
    return stats.join(tails, ["slab", "z"]).select(
        "slab", "z", F.col("min").alias("low"), F.col("max").alias("high"), (F.col("p1") / 100.0).alias("p1"), (F.col("p99") / 100.0).alias("p99"),
        F.col("blurred_min").alias("b_low"), F.col("blurred_max").alias("b_high"))


@query("running_extremes", "step:l min_low:l max_high:l min_p1:d max_p99:d min_b_low:l max_b_high:l", f"""
with {SIX_SQL}, {DRAWN},
r as (select step, min(low) over w as min_low, max(high) over w as max_high, min(p1) over w as min_p1, max(p99) over w as max_p99, min(b_low) over w as min_b_low, max(b_high) over w as max_b_high
      from draws join six using (slab, z) window w as (order by step rows between unbounded preceding and current row)),
c as (select *, row(min_low, max_high, min_p1, max_p99, min_b_low, max_b_high) as now, lag(row(min_low, max_high, min_p1, max_p99, min_b_low, max_b_high)) over (order by step) as before from r)
select step, min_low, max_high, min_p1, max_p99, min_b_low, max_b_high from c where before is null or now <> before""", "slabs")
def _(t):
    rows = drawn(t).join(six_extremes(t), ["slab", "z"])
    return stacks.running_extremes(rows, "step", ["low", "p1", "b_low"], ["high", "p99", "b_high"], bucket_width=4096)


# --- overlap and merge ------------------------------------------------------------

# Pairs: slab m moves against slab m - 1; references are its first slices.
DENSE_SLABS = """
dense as (select s.i as slab, z.i as z, y.i as py, x.i as px, coalesce(v.raw, 0) as v from range(6) s(i), range(40) z(i), range(16) y(i), range(7) x(i)
          left join slabs v on v.slab = s.i and v.z = z.i and v.y = y.i and v.x = x.i + 1)"""
WINDOWS = """
moving as (select slab as pair, z - j.i as start, py, px + 7 * j.i as px, v from dense, range({n}) j(i) where slab >= 1 and z - j.i between 0 and 40 - {n}),
fixed as (select slab + 1 as pair, py, px + 7 * z as px, v as w from dense where slab <= 4 and z < {n})"""


def dense_slabs(t):
    return stencils.dense(slab_image(t), ["slab", "z"], "v", 7, 16)


def overlap(t, n, function):
    image = dense_slabs(t).withColumn("v", F.col("v").cast("bigint"))
    moving = stacks.slice_windows(image.filter("slab >= 1").withColumnRenamed("slab", "pair"), ["pair"], SLAB_DEPTH, n, 7)
    fixed = stacks.slice_windows(image.filter("slab <= 4").withColumn("pair", F.col("slab") + 1).drop("slab"), ["pair"], n, n, 7)
    return stacks.overlap_scores(moving, fixed.filter("start = 0").drop("start"), ["pair"], function, 7 * n, 16)


@query("mutual_information", "pair:l start:l score:d", f"""
with {DENSE_SLABS}, {WINDOWS.format(n=2)}, both_ as (select m.*, f.w from moving m join fixed f using (pair, px, py)),
span as (select pair, start, min(v) as a0, max(v) as a1, min(w) as b0, max(w) as b1 from both_ group by pair, start),
bins as (select pair, start, least(case when a1 > a0 then (v - a0) * 20 // (a1 - a0) else 10 end, 19) as x, least(case when b1 > b0 then (w - b0) * 20 // (b1 - b0) else 10 end, 19) as y
         from both_ join span using (pair, start)),
joint as (select pair, start, x, y, count(*) as n from bins group by all),
p as (select *, n / sum(n) over (partition by pair, start) as p, sum(n) over (partition by pair, start, x) / sum(n) over (partition by pair, start) as px,
      sum(n) over (partition by pair, start, y) / sum(n) over (partition by pair, start) as py from joint)
select pair, start, round(sum(p * ln(p / (px * py))), 6) as score from p group by pair, start""", "slabs")
def _(t):
    return overlap(t, 2, "mutual_information").withColumn("score", F.round("score", 6))


MEDIAN = """
med as (select a.slab, a.z, a.py, a.px, list_sort(list(b.v))[5] as v from (select d.*, o.i - 1 as dy, q.i - 1 as dx from dense d, range(3) o(i), range(3) q(i)) a
        join dense b on b.slab = a.slab and b.z = a.z and b.py = least(greatest(a.py + dy, 0), 15) and b.px = least(greatest(a.px + dx, 0), 6) group by all)"""


@query("median3", "slab:l z:l py:l px:l v:l", f"with {DENSE_SLABS}, {MEDIAN} select * from med", "slabs")
def _(t):
    return stencils.median3(slab_image(t), ["slab", "z"], "v", 7, 16)


@query("pearson_top_k", "pair:l start:l score:d rank:l", f"""
with {DENSE_SLABS}, {MEDIAN}, c as (select m.slab as pair, m.z as start, round(covar_pop(cast(m.v as double), cast(f.v as double)) / nullif(stddev_pop(cast(m.v as double)) * stddev_pop(cast(f.v as double)), 0), 6) as score
  from med m join med f on f.slab = m.slab - 1 and f.z = 0 and f.px = m.px and f.py = m.py group by m.slab, m.z)
select * from (select *, row_number() over (partition by pair order by score desc nulls last, start) as rank from c) where rank <= 5""", "slabs")
def _(t):
    scores = overlap(t, 1, "pearson").withColumn("score", F.round("score", 6))
    return stacks.best_candidates(scores, ["pair"], 5)


@query("slab_merge", "slab:l z:l z_merged:l y:l x:l raw:l", """
with o(slab, taken, start) as (values (5, 31, 0), (4, 29, 31), (3, 32, 60), (2, 28, 92), (1, 30, 120), (0, 40, 150))
select s.slab, z, z + start as z_merged, y, x, raw from slabs s join o using (slab) where z < taken""", "slabs")
def _(t):
    return stacks.merge_slabs(t.slabs, [30, 28, 32, 29, 31], SLAB_DEPTH, reverse=True)


@query("slab_depths", "total:l uniform:b", """
with d as (select slab, max(z) + 1 as depth from slabs group by slab) select sum(depth) as total, count(distinct depth) = 1 as uniform from d""", "slabs")
def _(t):
    per_file = stacks.depths(t.slabs, "slab")
    return per_file.agg(F.sum("depth").alias("total"), (F.countDistinct("depth") == 1).alias("uniform"))
