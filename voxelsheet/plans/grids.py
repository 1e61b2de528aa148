"""Queries over surfaces, image patches and sample tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering, scalars, tensors
from ..operators import augment, patches, regions, stacks, surfaces
from ..registry import query

POINT = "px:l py:l x:d y:d z:d"
CUBE = (4, 4, 4)


def rounded_points(df):
    return df.withColumns({a: F.round(a, 6) for a in "xyz"})


@query("surface_decimate", POINT, "select px // 3 as px, py // 3 as py, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from surface, surface_size where px % 3 = 0 and py % 3 = 0 and px // 3 < w // 3 and py // 3 < h // 3", "surface surface_size")
def _(t):
    return rounded_points(surfaces.decimate(t.surface, 3, *t.surface_size))


@query("surface_translate", POINT, """
select px, py, round(case when keep then x + 5 else 0 end, 6) as x, round(case when keep then y - 3 else 0 end, 6) as y, round(case when keep then z + 2 else 0 end, 6) as z
from (select *, px % 6 <> 0 as keep from surface)""", "surface")
def _(t):
    """Every sixth column is emptied first, to show that empty pixels stay empty."""
    emptied = t.surface.withColumns({c: F.when(F.col("px") % 6 == 0, 0.0).otherwise(F.col(c)) for c in surfaces.VALUES})
    return rounded_points(surfaces.translate(emptied, 5, -3, 2))


def volume_sizes(t):
    """Sizes of the volume from its table."""
    return t.voxels.groupBy("volume_id").agg((F.max("z") + 1).alias("slices"), (F.max("y") + 1).alias("height")).withColumn("width", F.lit(128))


@query("flat_surface", POINT + " nz:d", "select x.i as px, y.i as py, x.i as x, y.i as y, (depth - 1) / 2e0 as z, 1 as nz from volume_shape, lateral (select unnest(range(height)) as i) y, range(128) x(i)", "volume_shape")
def _(t):
    return surfaces.flat(volume_sizes(t).withColumn("face_id", F.lit(0)))


@query("surface_from_image", POINT + " mask:l ink:l r:l g:l b:l", """
select px, py, px as x, py as y, 4 as z, case when g = 0 then 0 else 255 end as mask, case when g = 255 then 255 else 0 end as ink,
  case when g = 0 then 0 when g < 255 then 210 else 0 end as r, case when g = 0 then 51 when g < 255 then 180 else 0 end as gg, case when g = 0 then 160 when g < 255 then 140 else 0 end as b from raster""".replace("as gg", "as g"), "raster")
def _(t):
    return surfaces.from_grey_image(t.raster, "g", 4.0)


@query("surface_extent", "xmin:l ymin:l zmin:l xmax:l ymax:l zmax:l crop:s", """
with e as (select cast(trunc(min(x)) as bigint) - 7 as xmin, cast(trunc(min(y)) as bigint) - 7 as ymin, cast(trunc(min(z)) as bigint) - 7 as zmin,
  cast(trunc(max(x)) as bigint) + 7 as xmax, cast(trunc(max(y)) as bigint) + 7 as ymax, cast(trunc(max(z)) as bigint) + 7 as zmax from surface join raster using (face_id, px, py) where mask <> 0)
select *, concat(xmax - xmin, 'x', ymax - ymin, 'x', zmax - zmin, '+', xmin, '+', ymin, '+', zmin) as crop from e""", "surface raster")
def _(t):
    return surfaces.extent(t.surface, t.raster, 7)


@query("region_painting", "px:l py:l color:l mask:l", """
select px, py, source_ord % 10 as color, mask from (select r.px, r.py, r.mask, s.source_ord, row_number() over (partition by r.px, r.py order by s.source_ord desc) as rn
  from raster r join sources s on r.px >= s.x0 and r.px < s.x1 + 5 and r.py >= s.y0 and r.py < s.y1 + 4) where rn = 1""", "raster sources")
def _(t):
    """Boxes widened so that they overlap and the later one shows."""
    boxes = t.sources.select("source_ord", "x0", "y0", (F.col("x1") + 5).alias("x1"), (F.col("y1") + 4).alias("y1"))
    return regions.paint(t.raster, boxes, "source_ord", 10)


# --- patches ---------------------------------------------------------------------

PATCHED = """
channels as (select 0 as channel, px, py, r as v from raster union all select 1, px, py, g from raster union all select 2, px, py, b from raster),
tops as (select y.i * 4 as patch_y, x.i * 4 as patch_x from surface_size s, lateral (select unnest(range((h + 3) // 4)) as i) y, lateral (select unnest(range((w + 3) // 4)) as i) x),
cells as (select channel, patch_y, patch_x, (py - patch_y) * 8 + px - patch_x as cell, px, py, v from channels join tops on py >= patch_y and py < patch_y + 8 and px >= patch_x and px < patch_x + 8)"""


def stack_pixels(t):
    channel = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("v")) for n, c in enumerate("rgb")]))
    return t.raster.select("px", "py", channel.alias("c")).select("px", "py", "c.*")


@query("patch_extract", "channel:l patch_y:l patch_x:l size:l total:l weighted:l", f"""
with {PATCHED} select channel, patch_y, patch_x, 64 as size, sum(v) as total, sum(v * (cell + 1)) as weighted from cells group by all""", "raster surface_size")
def _(t):
    blocks = patches.patch_arrays(patches.patch_cells(stack_pixels(t), 8, 4), ["channel"], "v", 8)
    fold = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda a, v: a + v)
    weighted = F.transform("block", lambda v, i: v.cast("bigint") * (i + 1))
    return blocks.select("channel", "patch_y", "patch_x", F.size("block").alias("size"),
                         fold(F.transform("block", lambda v: v.cast("bigint"))).alias("total"), fold(weighted).alias("weighted"))


@query("patch_stitch", "px:l py:l score:l", f"""
with {PATCHED} select px, py, score from (select px, py, (v + patch_y + patch_x) % 256 as score, row_number() over (partition by px, py order by patch_y desc, patch_x desc) as rn
  from cells, surface_size where channel = 0 and patch_y + 8 <= h and patch_x + 8 <= w) where rn = 1""", "raster surface_size")
def _(t):
    cells = patches.patch_cells(stack_pixels(t).filter("channel = 0").drop("channel"), 8, 4)
    scored = cells.withColumn("score", (F.col("v") + F.col("patch_y") + F.col("patch_x")) % 256)
    return patches.stitch(scored.drop("px", "py"), [], "score", ["patch_y", "patch_x"], 8, *t.surface_size)


@query("rescale_to_byte", "px:l py:l texture:l", """
select px, py, cast(trunc((texture - low) / (high - low) * 255) as bigint) as texture from raster, (select min(texture) as low, max(texture) as high from raster)""", "raster")
def _(t):
    return patches.rescale_to_byte(t.raster, "texture")


STACKED = """
pictures as (select epoch as image, region as channel, px, py, p255 * 257 as v from (
  select *, row_number() over (partition by region, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as rn from predictions) where rn = 1),
images as (select distinct image from pictures),
tops as (select y.i * 6 as patch_y, x.i * 6 as patch_x from surface_size s, lateral (select unnest(range((h + 5) // 6)) as i) y, lateral (select unnest(range((w + 5) // 6)) as i) x),
feature as (select image, patch_y, patch_x, sum(v / 65535e0) as total, sum(v / 65535e0 * (channel * 64 + (py - patch_y) * 8 + px - patch_x + 1)) as weighted
  from pictures join tops on py >= patch_y and py < patch_y + 8 and px >= patch_x and px < patch_x + 8 group by all),
painted as (select px, py, 0 as channel, r as v from raster union all select px, py, 1, g from raster union all select px, py, 2, b from raster),
label as (select patch_y, patch_x, sum(v) as total, sum(v * (channel * 64 + (py - patch_y) * 8 + px - patch_x + 1)) as weighted
  from painted join tops on py >= patch_y and py < patch_y + 8 and px >= patch_x and px < patch_x + 8 group by all)"""


@query("labelled_patches", "image:l patch_y:l patch_x:l cells:l total:d weighted:d label_cells:l label_total:l label_weighted:l", f"""
with {STACKED} select i.image, l.patch_y, l.patch_x, 256 as cells, round(coalesce(f.total, 0e0), 4) as total, round(coalesce(f.weighted, 0e0), 4) as weighted, 192 as label_cells,
  l.total as label_total, l.weighted as label_weighted from label l cross join images i left join feature f on f.image = i.image and f.patch_y = l.patch_y and f.patch_x = l.patch_x""",
       "predictions raster surface_size")
def _(t):
    """Stacks of four channels (one per region) with a colour label, cut into patches together."""
    from ..operators import stamps

    latest = stamps.last_write(t.predictions, ["region", "epoch", "px", "py"], "p255", ["seq", "tie1", "tie2"])
    stack = latest.select(F.col("epoch").alias("image"), F.col("region").alias("channel"), "px", "py", (F.col("p255") * 257).alias("v"))
    pictures = t.raster.withColumn("image", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))))
    blocks = patches.labelled_patches(patches.channel_first(stack, "stack"), patches.channel_first(pictures, "rgb"), 8, 6, 4, 3)
    fold = lambda f: F.aggregate(f, F.lit(0.0), lambda a, v: a + v)
    sums = lambda c: (fold(F.transform(c, lambda v: v.cast("double"))), fold(F.transform(c, lambda v, i: v * (i + 1.0))))
    (total, weighted), (label_total, label_weighted) = sums("feature"), sums("label")
    return blocks.select("image", "patch_y", "patch_x", F.size("feature").alias("cells"), F.round(total, 4).alias("total"), F.round(weighted, 4).alias("weighted"),
                         F.size("label").alias("label_cells"), label_total.alias("label_total"), label_weighted.alias("label_weighted"))


@query("stack_faults", "image:l fault:s", """
with f as (select region as image, max(py) + 1 as h, max(px) + 1 as w, max(batch) + 1 as d from predictions group by region),
l as (select image, h.h, h.w from (select unnest([0, 1, 3]) as image) i cross join (select max(py) + 1 as h, max(px) + 1 as w from surface) h)
select f.image, case when l.image is null then 'label' when f.h <> l.h or f.w <> l.w then 'size' else 'channels' end as fault
from f left join l on l.image = f.image where l.image is null or f.h <> l.h or f.w <> l.w""", "predictions surface")
def _(t):
    """Stacks by region (a channel per batch) against labels from another table, which lacks one of them."""
    stack = t.predictions.select(F.col("region").alias("image"), F.col("batch").alias("channel"), "px", "py", F.col("p255").alias("v"))
    labels = t.surface.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("image"), "px", "py", F.lit(1).alias("v"))
    return patches.stack_faults(stack, patches.channel_first(labels, "grey")).filter("fault <> 'depth'")


@query("stack_shapes", "same_size:b one_depth:b", "select true as same_size, count(distinct d) = 1 as one_depth from (select count(distinct slab) as d from slabs group by z)", "slabs")
def _(t):
    features = stack_pixels(t).withColumn("image", F.lit(0))
    by_slab = t.slabs.select(F.col("z").alias("image"), F.col("slab").alias("channel"), "x", "y")
    checked = patches.shape_check(features, t.raster)
    depth = by_slab.groupBy("image").agg(F.countDistinct("channel").alias("d")).agg((F.countDistinct("d") == 1).alias("one_depth"))
    return checked.select("same_size", (F.col("one_depth") & depth.scalar()).alias("one_depth"))


# --- sample tensors ------------------------------------------------------------------

ELEMENTS = "elements as (select vec_id, i.i as i, embedding[i.i + 1] as v from feat, range(64) i(i))"


def exploded(df, *keys, block="embedding"):
    return df.select(*keys, F.posexplode(block).alias("i", "v"))


@query("rot90_flip", "vec_id:l turns:l mirrored:b i:l v:d", """
with c as (select vec_id, embedding, k.i as turns, m.i = 1 as mirrored, z.i as z, y.i as y, x.i as x from feat, range(4) k(i), range(2) m(i), range(4) z(i), range(4) y(i), range(4) x(i)),
s as (select *, case when mirrored then 3 - x else x end as mx from c),
p as (select *, case turns when 0 then y when 1 then mx when 2 then 3 - y else 3 - mx end as sy, case turns when 0 then mx when 1 then 3 - y when 2 then 3 - mx else y end as sx from s)
select vec_id, turns, mirrored, z * 16 + y * 4 + x as i, round(cast(embedding[z * 16 + sy * 4 + sx + 1] as double), 6) as v from p""", "feat")
def _(t):
    rows = augment.variant_rows(t.feat.select("vec_id", "embedding"), "embedding", CUBE)
    cells = exploded(rows, "vec_id", "variant")
    return cells.select("vec_id", scalars.int_div(F.col("variant"), 2).alias("turns"), (F.col("variant") % 2 == 1).alias("mirrored"), "i",
                        F.round(F.col("v").cast("double"), 6).alias("v"))


@query("tta_average", "vec_id:l i:l v:d", """
with variant as (select k.i as turns, m.i as mirrored from range(4) k(i), range(2) m(i)),
c as (select vec_id, embedding, turns, mirrored, y.i as y, x.i as x from feat, variant, range(4) y(i), range(4) x(i)),
s as (select *, case when mirrored = 1 then 3 - x else x end as mx from c),
p as (select *, case turns when 0 then y when 1 then mx when 2 then 3 - y else 3 - mx end as sy, case turns when 0 then mx when 1 then 3 - y when 2 then 3 - mx else y end as sx from s)
select vec_id, sy * 4 + sx as i, round(avg((cast(embedding[sy * 4 + sx + 1] as double) + 2 * cast(embedding[16 + sy * 4 + sx + 1] as double)) * (y * 4 + x + 1)), 6) as v from p group by vec_id, sy * 4 + sx""", "feat")
def _(t):
    """A score that depends on the place in the plane, so that averaging matters."""

    def score(block):
        return F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda i: (F.element_at(block, i + 1).cast("double") + F.element_at(block, i + 17).cast("double") * 2) * (i + 1),
        )

    averaged = t.feat.select("vec_id", augment.average_over_variants(F.col("embedding"), CUBE, score).alias("plane"))
    return exploded(averaged, "vec_id", block="plane").withColumn("v", F.round("v", 6))


@query("random_flips", "vec_id:l i:l v:d", """
with b as (select vec_id, embedding, (vec_id * 1103515245 + 5 * 12345 + 67) % 2147483648 as h from feat),
c as (select *, h // 1024 % 2 = 1 as fx, h // 2048 % 2 = 1 as fy, z.i as z, y.i as y, x.i as x from b, range(4) z(i), range(4) y(i), range(4) x(i))
select vec_id, z * 16 + y * 4 + x as i, round(cast(embedding[z * 16 + (case when fy then 3 - y else y end) * 4 + (case when fx then 3 - x else x end) + 1] as double), 6) as v from c""", "feat")
def _(t):
    flipped = t.feat.select("vec_id", augment.random_flips(F.col("embedding"), CUBE, 5, F.col("vec_id"), portable=True).alias("embedding"))
    return exploded(flipped, "vec_id").withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("standardize", "vec_id:l i:l v:d", f"""
with {ELEMENTS}, s as (select vec_id, avg(cast(v as double)) as m, stddev_samp(cast(v as double)) as d from elements group by vec_id)
select vec_id, i, round((v - m) / case when d = 0 then 1 else d end, 5) as v from elements join s using (vec_id)""", "feat")
def _(t):
    ready = t.feat.select("vec_id", tensors.standardize(F.col("embedding")).alias("embedding"))
    return exploded(ready, "vec_id").withColumn("v", F.round("v", 5))


@query("minmax_scale", "vec_id:l i:l v:d", f"""
with {ELEMENTS}, s as (select vec_id, cast(min(v) as double) as a, cast(max(v) as double) as b from elements group by vec_id)
select vec_id, i, round((cast(v as double) - a) / nullif(b - a, 0), 5) as v from elements join s using (vec_id)""", "feat")
def _(t):
    ready = t.feat.select("vec_id", tensors.min_max(F.col("embedding")).alias("embedding"))
    return exploded(ready, "vec_id").withColumn("v", F.round("v", 5))


@query("central_slices", "vec_id:l axis:s i:l v:d low:d high:d", f"""
with {ELEMENTS}, p as (select vec_id, 'z' as axis, i % 16 as i, v from elements where i // 16 = 2 union all
  select vec_id, 'y', i // 16 * 4 + i % 4, v from elements where i // 4 % 4 = 2 union all select vec_id, 'x', i // 16 * 4 + i // 4 % 4, v from elements where i % 4 = 2)
select vec_id, axis, i, round(cast(v as double), 6) as v, round(cast(min(v) over (partition by vec_id) as double), 6) as low, round(cast(max(v) over (partition by vec_id) as double), 6) as high from p""", "feat")
def _(t):
    planes = tensors.central_slices(F.col("embedding"), CUBE)
    low, high = tensors.shared_range(planes)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), p.alias("plane")) for a, p in zip("zyx", planes)]))
    rows = t.feat.select("vec_id", low.alias("low"), high.alias("high"), each.alias("p"))
    cells = rows.select("vec_id", "low", "high", "p.axis", F.posexplode("p.plane").alias("i", "v"))
    return cells.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("v", "low", "high")})


@query("sample_mosaic", "z:l y:l x:l v:d", """
with r as (select row_number() over (order by (vec_id * 1103515245 + 9 * 12345 + 67) % 2147483648, vec_id) - 1 as r, embedding from feat),
n as (select cast(ceil(sqrt(count(*))) as bigint) as side from feat)
select i.i // 16 + 20 as z, r % side * 44 + 20 + i.i // 4 % 4 as y, r // side * 44 + 20 + i.i % 4 as x, round(cast(embedding[i.i + 1] as double), 6) as v from r, n, range(64) i(i)""", "feat")
def _(t):
    from ..functions import chance

    numbered = ordering.number_by_draw(t.feat, chance.draw(9, "vec_id", portable=True), ["vec_id"], "rn")
    placed = augment.mosaic(numbered.withColumn("rn", F.col("rn") - 1), "rn", "embedding", CUBE, t.feat.count())
    return placed.withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("volume_float_sink", "z:l y:l x:l v:l", """
with e as (select vec_id, i.i as i, embedding[i.i + 1] as v from feat, range(64) i(i)), s as (select vec_id, cast(min(v) as double) as a, cast(max(v) as double) as b from e group by vec_id)
select i // 16 as z, vec_id * 4 + i // 4 % 4 as y, i % 4 as x, cast(trunc(round((cast(v as double) - a) / (b - a), 6) * 65535) as bigint) as v from e join s using (vec_id)""", "feat")
def _(t):
    """Samples in [0, 1] written as uint16 slices, one folder per z, and read back."""
    from ..sources import volumes

    unit = t.feat.select("vec_id", tensors.min_max(F.col("embedding")).alias("block"))
    cells = exploded(unit, "vec_id", block="block")
    z, y, x = scalars.unflatten(F.col("i"), 4, 4)
    floats = cells.select(F.lit(0).alias("volume_id"), z.alias("z"), (F.col("vec_id") * 4 + y).cast("int").alias("y"), x.alias("x"), F.round("v", 6).alias("v"))
    return volumes.write_and_read(volumes.from_unit_floats(floats), "samples")


@query("index_arithmetic", "i:l z:l y:l x:l back:l conv:l shade:l", """
select p_partkey as i, p_partkey // 35 as z, p_partkey // 7 % 5 as y, p_partkey % 7 as x, p_partkey as back,
  cast(floor((p_size + 2 * 1 - 2 * (3 - 1) - 1) / 2e0 + 1) as bigint) as conv, cast(trunc(p_size / 50e0 * 255) as bigint) as shade from part""")
def _(t):
    i = F.col("p_partkey")
    z, y, x = scalars.unflatten(i, 5, 7)
    conv = scalars.conv_output_size(F.col("p_size"), F.lit(3), F.lit(2), F.lit(1), F.lit(2))
    return t.raw("part").select(i.alias("i"), z.alias("z"), y.alias("y"), x.alias("x"), scalars.flat_index(z, y, x, 5, 7).alias("back"),
                                conv.alias("conv"), scalars.ramp(F.col("p_size"), 50).alias("shade"))
