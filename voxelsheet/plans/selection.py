"""Queries that choose points, balance classes and split data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chance
from ..operators import datasets, patches, regions, selection, stencils
from ..registry import query
from .samples import KEYS, ON_SURFACE, with_point_id

PIXEL = "face_id:l px:l py:l"


@query("surface_grid", PIXEL, "select face_id, px, py from raster where px >= 1 and px < 47 and py >= 2 and (px - 1) % 4 = 0 and (py - 2) % 4 = 0", "raster")
def _(t):
    width, height = t.surface_size
    return t.raster.filter(selection.grid_filter((1, 2, 47, height), 4))


@query("on_surface", PIXEL, f"with {ON_SURFACE} select face_id, px, py from on_surface", "raster")
def _(t):
    return selection.on_surface(t.raster)


@query("ink_points", PIXEL, f"with {ON_SURFACE} select face_id, px, py from on_surface where ink <> 0", "raster")
def _(t):
    return selection.keep_inkness(selection.on_surface(t.raster), True)


@query("no_ink_points", PIXEL, f"with {ON_SURFACE} select face_id, px, py from on_surface where ink = 0", "raster")
def _(t):
    return selection.keep_inkness(selection.on_surface(t.raster), False)


EDGES = """
near as (select a.face_id, a.px, a.py, a.ink, sum(b.ink) as total from raster a join raster b on abs(a.px - b.px) <= 1 and abs(a.py - b.py) <= 1 group by all),
edges as (select n.face_id, n.px, n.py, n.ink, case when px in (0, s.w - 1) or py in (0, s.h - 1) then ink else least(greatest(9 * ink - total, 0), 255) end as edge from near n, surface_size s)"""
DILATED = EDGES + """,
dilated as (select a.face_id, a.px, a.py, a.ink, max(b.edge) as edge from edges a join edges b on abs(a.px - b.px) <= 1 and abs(a.py - b.py) <= 1 group by all)"""


def edges(t):
    width, height = t.surface_size
    return stencils.find_edges(t.raster, "ink", width, height)


@query("edge_detect", f"{PIXEL} ink:l edge:l", f"with {EDGES} select * from edges", "raster surface_size")
def _(t):
    return edges(t)


@query("dilate", f"{PIXEL} ink:l edge:l", f"with {DILATED} select * from dilated", "raster surface_size")
def _(t):
    return stencils.dilate(edges(t), "edge", 1)


@query("ambiguous_filter", PIXEL, f"with {DILATED} select face_id, px, py from raster join dilated d using (face_id, px, py) where d.edge = 0", "raster surface_size")
def _(t):
    width, height = t.surface_size
    return selection.drop_ambiguous(t.raster, t.raster, 1.0, width, height)


@query("ambiguity_overlay", f"{PIXEL} r:l g:l b:l", f"""
with {DILATED} select face_id, px, py, case when edge = 255 then cast(floor((255 * 128 + ink * 127) / 255e0 + 0.5e0) as bigint) else ink end as r,
  case when edge = 255 then cast(floor(ink * 127 / 255e0 + 0.5e0) as bigint) else ink end as g,
  case when edge = 255 then cast(floor(ink * 127 / 255e0 + 0.5e0) as bigint) else ink end as b from dilated""", "raster surface_size")
def _(t):
    return stencils.ambiguity_overlay(stencils.dilate(edges(t), "edge", 1))


@query("default_bounds", "path:s x0:l y0:l x1:l y1:l valid:b", """
select path, case when type = 'volume' then 0 else x0 end as x0, case when type = 'volume' then 0 else y0 end as y0,
       case when type = 'volume' then w else x1 end as x1, case when type = 'volume' then h else y1 end as y1,
       case when type = 'volume' then false else x0 between 0 and w - 2 and x1 > x0 and x1 <= w - 1 and y0 between 0 and h - 2 and y1 > y0 and y1 <= h - 1 end as valid
from sources, surface_size""", "sources surface_size")
def _(t):
    """Absent boxes become the full surface, which the editor's rule refuses."""
    width, height = t.surface_size
    box = F.when(F.col("type") == "region", F.array("x0", "y0", "x1", "y1"))
    full = selection.default_box(box, width, height)
    rows = t.sources.select("path", *[full[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return rows.withColumn("valid", selection.box_is_valid("x0", "y0", "x1", "y1", width, height))


@query("undersample", f"{PIXEL} draw:l", f"""
with {ON_SURFACE}, c as (select face_id, px, py, py * 50 + px as id, ink <> 0 as pos, (((py * 50 + px) * 1103515245 + 67) % 2147483648) as h from on_surface),
n as (select *, row_number() over (partition by pos order by h, id) as rn from c),
k as (select count(*) filter (pos) as p, count(*) filter (not pos) as m from c),
d as (select unnest(range(cast(floor(p * (1e0 - 0.4e0) / 0.4e0) as bigint))) as draw, m from k),
w as (select draw, cast(floor(((draw * 1103515245 + 12345 + 67) % 2147483648) / 2147483648e0 * m) as bigint) + 1 as rn from d)
select face_id, px, py, null as draw from n where pos union all select face_id, px, py, draw from w join n using (rn) where not pos""", "raster")
def _(t):
    points = with_point_id(selection.on_surface(t.raster))
    return selection.undersample(points, 0.4, "point_id", seed=0, portable=True)


@query("oversample", f"{PIXEL} rep:l", f"""
with {ON_SURFACE}, k as (select greatest(cast(floor(floor(count(*) filter (ink = 0) * 0.9e0 / (1e0 - 0.9e0)) / count(*) filter (ink <> 0)) as bigint), 1) as reps from on_surface)
select face_id, px, py, r.i as rep from on_surface, k, lateral (select unnest(range(reps)) as i) r where ink <> 0
union all select face_id, px, py, 0 from on_surface where ink = 0""", "raster")
def _(t):
    return selection.oversample(selection.on_surface(t.raster), 0.9)


@query("class_counts", "positive:l negative:l under:l over:l", f"""
with {ON_SURFACE}, k as (select count(*) filter (ink <> 0) as p, count(*) filter (ink = 0) as n from on_surface)
select p as positive, n as negative, p + cast(floor(p * (1e0 - 0.25e0) / 0.25e0) as bigint) as under,
       p * greatest(cast(floor(floor(n * 0.75e0 / (1e0 - 0.75e0)) / p) as bigint), 1) + n as over from k""", "raster")
def _(t):
    counts = selection.on_surface(t.raster).agg(F.count_if(selection.is_ink()).alias("positive"), F.count_if(~selection.is_ink()).alias("negative"))
    p, n = F.col("positive"), F.col("negative")
    reps = F.greatest(F.floor(F.try_divide(F.floor(n * 0.75 / (1.0 - 0.75)), p)), F.lit(1))
    return counts.select(p, n, (p + F.floor(p * (1.0 - 0.25) / 0.25)).alias("under"), (p * reps + n).alias("over"))


@query("volume_points", "sample_id:l x:d y:d z:d n_x:d n_y:d n_z:d", """
with u as (select o_orderkey as id, ((o_orderkey * 1103515245 + 7 * 12345 + 67) % 2147483648) / 2147483648e0 as a, ((o_orderkey * 1103515245 + 8 * 12345 + 67) % 2147483648) / 2147483648e0 as b,
  ((o_orderkey * 1103515245 + 9 * 12345 + 67) % 2147483648) / 2147483648e0 as c, ((o_orderkey * 1103515245 + 10 * 12345 + 67) % 2147483648) / 2147483648e0 * 2 * pi() as th,
  ((o_orderkey * 1103515245 + 11 * 12345 + 67) % 2147483648) / 2147483648e0 * 2 - 1 as zed from orders)
select id as sample_id, round(a * width, 6) as x, round(b * height, 6) as y, round(c * depth, 6) as z, round(sqrt(1 - zed * zed) * cos(th), 6) as n_x,
  round(sqrt(1 - zed * zed) * sin(th), 6) as n_y, round(zed, 6) as n_z from u, volume_shape""", "volume_shape")
def _(t):
    ids = t.raw("orders").select(F.col("o_orderkey").alias("sample_id"))
    out = selection.volume_points(ids, t.volume_shape, 7, portable=True)
    return out.select("sample_id", *[F.round(a, 6).alias(a) for a in "xyz"], *[F.round(f"n{a}", 6).alias(f"n_{a}") for a in "xyz"])


HASHED = "select *, (o_orderkey * 1103515245 + {seed} * 12345 + 67) % 2147483648 as h from orders"


@query("random_subset", "o_orderkey:l rn:l", f"""
select o_orderkey, rn from (select *, row_number() over (order by h, o_orderkey) as rn from ({HASHED.format(seed=3)})) where rn <= 1000""")
def _(t):
    return selection.random_subset(t.raw("orders"), "o_orderkey", 1000, 3, portable=True)


@query("shuffled_batches", "o_orderkey:l batch:l position:l", f"""
select o_orderkey, (rn - 1) // 32 as batch, (rn - 1) % 32 as position from (select *, row_number() over (order by h, o_orderkey) as rn from ({HASHED.format(seed=44)}))""")
def _(t):
    seed = chance.epoch_seed(42, 2)
    return selection.shuffled_batches(t.raw("orders"), "o_orderkey", 32, seed, portable=True)


# --- data sets ---------------------------------------------------------------------

BOXED = """
points as (select s.path, r.px, r.py from raster r join sources s on s.type = 'region' and r.mask <> 0 and r.px >= s.x0 and r.px < s.x1 and r.py >= s.y0 and r.py < s.y1),
counts as (select path, count(*) as n from points group by path),
lengths as (select s.source_ord, s.path, case when s.type = 'volume' then 100000 else coalesce(c.n, 0) end as n from sources s left join counts c using (path)),
firsts as (select *, coalesce(sum(n) over (order by source_ord rows between unbounded preceding and 1 preceding), 0) as first from lengths)"""


def lengths(t):
    boxes = t.sources.filter("type = 'region'").select("path", "x0", "y0", "x1", "y1")
    points = regions.in_boxes(t.raster.filter("mask != 0"), boxes, closed=False)
    return datasets.source_lengths(t.sources.select("source_ord", "path", "type"), points)


@query("source_lengths", "path:s n:l first:l", f"with {BOXED} select path, n, first from firsts", "raster sources")
def _(t):
    return datasets.offsets(lengths(t))


@query("global_index", "sample:l path:s local_index:l", f"""
with {BOXED}, asked as (select o_orderkey, o_orderkey * 37 as sample from orders)
select a.sample, f.path, a.sample - f.first as local_index from asked a left join firsts f on a.sample >= f.first and a.sample < f.first + f.n""", "raster sources")
def _(t):
    asked = t.raw("orders").select((F.col("o_orderkey") * 37).alias("sample"))
    return datasets.locate(asked, lengths(t), "sample")


@query("nth_region", "path:s", "select path from (select *, row_number() over (order by source_ord) as rn from sources where type = 'region') where rn = 8", "sources")
def _(t):
    return datasets.nth_region(t.sources, 7)


@query("kfold", "path:s fold:l set_type:s", """
with pool as (select path, source_ord, type, case when type = 'region' then row_number() over (partition by type order by source_ord) else 0 end as rn from sources where training),
f as (select *, i.i as fold from pool, range(5) i(i))
select path, fold, 'training' as set_type from f where rn <> fold + 1
union select path, fold, s.s from f, (values ('validation'), ('prediction')) s(s) where rn = fold + 1
union select path, i.i, 'validation' from sources, range(5) i(i) where validation
union select path, i.i, 'prediction' from sources, range(5) i(i) where prediction""", "sources")
def _(t):
    return datasets.folds(t.sources, 5)


@query("kfold_top_level", "path:s fold:l set_type:s", """
with pool as (select path, row_number() over (order by source_ord) as rn from sources where training), f as (select *, i.i as fold from pool, range(3) i(i))
select path, fold, 'training' as set_type from f where rn <> fold + 1
union select path, fold, s.s from f, (values ('validation'), ('prediction')) s(s) where rn = fold + 1
union select path, i.i, 'validation' from sources, range(3) i(i) where validation
union select path, i.i, 'prediction' from sources, range(3) i(i) where prediction""", "sources")
def _(t):
    return datasets.folds(t.sources, 3, regions_only=False)


@query("union_of_sets", "path:s", "select path from sources where training or prediction or validation", "sources")
def _(t):
    return datasets.union_of_sets(t.sources)


@query("grid_split", "path:s row:l col:l x0:l y0:l x1:l y1:l name:s", """
select path, r.i as row, c.i as col, x0 + c.i * ((x1 - x0) // 3) as x0, y0 + r.i * ((y1 - y0) // 2) as y0, x0 + (c.i + 1) * ((x1 - x0) // 3) as x1,
  y0 + (r.i + 1) * ((y1 - y0) // 2) as y1, concat(replace(path, '.json', ''), '_grid2x3_row', cast(r.i as varchar), '_col', cast(c.i as varchar), '.json') as name
from sources, range(2) r(i), range(3) c(i) where type = 'region'""", "sources")
def _(t):
    from ..functions import scalars

    boxes = t.sources.filter("type = 'region'").select("path", "x0", "y0", "x1", "y1")
    out = regions.split_grid(boxes, 2, 3)
    return out.withColumn("name", regions.grid_names(scalars.stem(F.col("path")), 2, 3))


@query("half_split", "part:s px:l py:l ink:l", """
select 'training' as part, px, py, ink from raster, surface_size where py < h // 2 union all select 'validation', px, py - h // 2, ink from raster, surface_size where py >= h // 2""",
       "raster surface_size")
def _(t):
    train, check = patches.halves(t.raster, t.surface_size[1])
    return train.withColumn("part", F.lit("training")).unionByName(check.withColumn("part", F.lit("validation")))


@query("regions_and_volumes", "path:s kind:s", "select path, type as kind from sources where type in ('region', 'volume') and training", "sources")
def _(t):
    """Semi join of the sources to those a run chose."""
    chosen = t.sources.filter("training").select("path")
    return t.sources.join(chosen, "path", "left_semi").withColumn("kind", F.col("type"))
