"""Queries over manifests, descriptors and run outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import catalog, manifests
from ..operators.summary import EPOCH_STEP, iteration_number
from ..registry import query

ROOT = "root as (select 'all.txt' as path, cast(0 as bigint) as ord)"


def root(t):
    return t.manifest_edges.filter("parent = 'all.txt'").select(F.col("parent").alias("path"), F.lit(0).alias("ord")).distinct()


@query("manifest_expand", "path:s position:l", """
with recursive walk(path, place) as (select 'all.txt', [cast(0 as bigint)] union all select e.child, list_append(w.place, e.ord) from walk w join edges e on e.parent = w.path),
edges as (select * from manifest_edges)
select path, row_number() over (order by place) - 1 as position from (select path, min(place) as place from walk where path like '%.json' group by path)""".replace(
    "edges e on", "manifest_edges e on").replace(",\nedges as (select * from manifest_edges)", ""), "manifest_edges")
def _(t):
    return manifests.flatten(t.manifest_edges, root(t))


@query("manifest_loops", "parent:s child:s loop:b", """
with recursive all_edges as (select * from manifest_edges union all select concat('r', cast(r_regionkey as varchar), '.txt'), 'all.txt', 50 from region where r_regionkey = 3
   union all select concat('r', cast(r_regionkey as varchar), '.txt'), 'r1.txt', 51 from region where r_regionkey = 4),
walk(path, parent, place, line, again) as (select 'all.txt', cast(null as varchar), [cast(0 as bigint)], ['all.txt'], false
   union all select e.child, w.path, list_append(w.place, e.ord), list_append(w.line, e.child), list_contains(w.line, e.child) from walk w join all_edges e on e.parent = w.path where not w.again),
lists as (select * from walk where path like '%.txt'), firsts as (select path, min(place) as f from lists group by path)
select parent, path as child, max(again) as loop from lists join firsts using (path) where again or place > f group by parent, path""", "manifest_edges")
def _(t):
    extra = t.raw("region").filter("r_regionkey in (3, 4)").select(
        F.concat(F.lit("r"), F.col("r_regionkey"), F.lit(".txt")).alias("parent"),
        F.when(F.col("r_regionkey") == 3, "all.txt").otherwise("r1.txt").alias("child"), (F.col("r_regionkey") + 47).cast("bigint").alias("ord"),
    )
    return manifests.repeated_lists(t.manifest_edges.unionByName(extra), root(t))


# --- descriptors ------------------------------------------------------------------


def descriptor_rows(t):
    """Full descriptor columns of every source."""
    up = lambda name: F.concat(F.lit("../vol/"), F.col("ppm"), F.lit(name))
    return t.sources.select(
        "source_ord", F.concat(F.lit("/data/sets/"), "path").alias("path"), "type", F.lit("../volumes/1").alias("volume"), up(".ppm").alias("ppm"),
        "invert_normals", up("_mask.png").alias("mask"), F.when(F.col("source_ord") % 2 == 0, up("_ink.png")).otherwise("").alias("ink_label"),
        F.lit(None).cast("string").alias("rgb_label"), F.lit("/abs/texture.png").alias("volcart_texture_label"),
        F.array("x0", "y0", "x1", "y1").alias("bounding_box"),
    )


@query("descriptor_scan", "path:s kind:s n_errors:l volume:s ppm:s ink_label:s texture:s n_box:l", """
select concat('/data/sets/', path) as path, case source_ord % 9 when 1 then 'invalid' when 2 then 'invalid' when 3 then 'invalid' when 4 then 'legacy' when 5 then 'invalid' else type end as kind,
  case when source_ord % 9 = 1 then case when type = 'region' then 1 else 1 end when source_ord % 9 in (2, 3, 4, 5) then 1 else 0 end as n_errors,
  case when source_ord % 9 in (4, 5) then null else '/data/volumes/1' end as volume,
  case when source_ord % 9 in (4, 5) or type = 'volume' then null else concat('/data/vol/', ppm, '.ppm') end as ppm,
  case when source_ord % 9 in (4, 5) or type = 'volume' or source_ord % 2 = 1 then null else concat('/data/vol/', ppm, '_ink.png') end as ink_label,
  case when source_ord % 9 in (4, 5) or type = 'volume' then null else '/abs/texture.png' end as texture,
  case when source_ord % 9 in (4, 5) or type = 'volume' then 0 else 4 end as n_box from sources""", "sources")
def _(t):
    """Well-formed descriptors and five kinds of faulty ones, by key."""
    fault = F.col("source_ord") % 9
    text = manifests.descriptor_text(descriptor_rows(t))
    broken = (
        F.when(fault == 1, F.when(F.col("type") == "region", F.replace(text, F.lit('"mask"'), F.lit('"musk"'))).otherwise(F.replace(text, F.lit('"volume":'), F.lit('"column":'))))
        .when(fault == 2, F.replace(text, F.lit('"0.1"'), F.lit('"0"'))).when(fault == 3, F.replace(F.replace(text, F.lit('"type":"region"'), F.lit('"type":"area"')), F.lit('"type":"volume"'), F.lit('"type":"area"')))
        .when(fault == 4, F.lit('{"ppms": {}, "regions": {}}')).when(fault == 5, F.concat(F.lit("{"), text)).otherwise(text)
    )
    out = manifests.parse_descriptors(descriptor_rows(t).select("path", broken.alias("text")))
    return out.select("path", "kind", F.size("errors").alias("n_errors"), "volume", "ppm", "ink_label", F.col("volcart_texture_label").alias("texture"),
                      F.coalesce(F.size("bounding_box"), F.lit(0)).alias("n_box"))


@query("legacy_convert", "name:s manifest:s ppm:s volume:s invert_normals:b box:s", """
with e as (select n_regionkey as r, n_nationkey as k, row_number() over (partition by n_regionkey, n_nationkey % 2 order by n_nationkey) - 1 as pos from nation)
select concat('old', r, '_', case when k % 2 = 0 then 'training' else 'validation' end, '_', pos, '.json') as name, concat('old', r, '_', case when k % 2 = 0 then 'training' else 'validation' end, '.txt') as manifest,
  concat('p', k % 3, '.ppm') as ppm, '../v' as volume, k % 3 = 1 as invert_normals, concat(k, ',0,', k + 9, ',8') as box from e""")
def _(t):
    """Old region sets, one per region key, built as text with comments."""
    n = t.raw("nation")
    region = F.concat(F.lit('{"ppm": "p'), F.col("n_nationkey") % 3, F.lit('", "bounds": ['), "n_nationkey", F.lit(", 0, "), F.col("n_nationkey") + 9, F.lit(", 8]}"))
    listed = lambda odd: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == odd, F.struct("n_nationkey", region.alias("r"))))), lambda s: s.r), ",")
    sets = n.groupBy("n_regionkey").agg(listed(0).alias("a"), listed(1).alias("b"))
    ppms = '"ppms": {"p0": {"path": "p0.ppm", "volume": "../v"}, "p1": {"path": "p1.ppm", "volume": "../v", "invert-normal": true}, "p2": {"path": "p2.ppm", "volume": "../v"}}'
    text = F.concat(F.lit("{ // old layout\n" + ppms + ', /* sets */ "regions": {"training": ['), "a", F.lit('], "validation": ['), "b", F.lit("]}}"))
    out = manifests.convert_legacy(sets.select(F.concat(F.lit("old"), "n_regionkey", F.lit(".json")).alias("path"), text.alias("text")))
    return out.withColumn("box", F.array_join(F.col("bounding_box").cast("array<string>"), ","))


@query("path_resolve", "path:s volume:s label:s moved:s", """
select path, concat('/data/v', source_ord % 3) as volume, case when source_ord % 2 = 0 then 'https://host/l.png' else concat('/abs/', path) end as label,
  case when source_ord % 4 = 0 then concat('/home/u/data/', path) end as moved from sources""", "sources")
def _(t):
    base = F.lit("/data/sets/inner")
    label = F.when(F.col("source_ord") % 2 == 0, "https://host/l.png").otherwise(F.concat(F.lit("/abs/"), "path"))
    far = F.when(F.col("source_ord") % 4 == 0, F.concat(F.lit("/scratch/lab/"), "path")).otherwise(F.col("path"))
    return t.sources.select(
        "path", scalars.resolve_path(F.concat(F.lit("./../../v"), F.col("source_ord") % 3), base).alias("volume"),
        scalars.resolve_path(label, base).alias("label"), scalars.relocate_path(far, "/scratch/lab/", "/home/u/data").alias("moved"),
    )


@query("same_face_siblings", "path:s", "select path from sources where ppm = (select ppm from sources where path = 'n6.json') and path <> 'n6.json'", "sources")
def _(t):
    return manifests.siblings(t.sources, "n6.json")


@query("sibling_counts", "path:s ppm:s siblings:l", "select path, ppm, count(*) over (partition by ppm) - 1 as siblings from sources", "sources")
def _(t):
    return manifests.sibling_counts(t.sources)


@query("regions_by_mask", "ppm:s position:l path:s", "select ppm, row_number() over (partition by ppm order by source_ord) as position, path from sources", "sources")
def _(t):
    return manifests.regions_by(t.sources, "ppm", "source_ord")


AUDIT_ITEMS = [f"extras/{s}" for s in manifests.EXTRAS] + list(manifests.ROOT_FILES) + ["meta.json"]


@query("deliverable_audit", "name:s item:s fault:s", f"""
with items(i, suffix) as (values {', '.join(f"({i}, '{s}')" for i, s in enumerate(AUDIT_ITEMS))}), modes(suffix, mode) as (values {', '.join(f"('{s}', '{m}')" for s, m in manifests.IMAGE_MODES.items())}),
c as (select c_custkey as k, concat('frag', cast(c_custkey as varchar)) as name from customer)
select name, suffix as item, 'missing' as fault from c, items where (k + i) % 17 = 0
union all select name, suffix, 'mode' from c, items join modes using (suffix) where (k + i) % 17 <> 0 and (k + i) % 13 = 0
union all select name, 'slice', 'slices' from c where k % 7 = 0""")
def _(t):
    """A listing with known gaps, wrong modes and short stacks."""
    k = F.col("c_custkey")
    named = t.raw("customer").select(k, F.concat(F.lit("frag"), k).alias("name"))
    modes = manifests.IMAGE_MODES
    item = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("suffix"), F.lit(modes.get(s)).alias("right")) for i, s in enumerate(AUDIT_ITEMS)]))
    files = named.select("name", k, item.alias("f")).select("name", k, "f.*").filter((k + F.col("i")) % 17 != 0)
    files = files.select("name", "suffix", F.when((k + F.col("i")) % 13 == 0, "X").otherwise(F.col("right")).alias("mode"))
    count = F.when(k % 7 == 0, 64).otherwise(65)
    slices = named.select("name", F.explode(F.sequence(F.lit(1), count)).alias("n")).select("name", F.lit("slice").alias("suffix"), F.lit(None).cast("string").alias("mode"))
    return manifests.audit(named.select("name"), files.unionByName(slices))


# --- run outputs --------------------------------------------------------------------

PARSED = r"""
every_file as (select event_id, path, split_part(path, '/', 2) as job_dir, cast(regexp_extract(split_part(path, '/', 2), '_(\d+)$', 1) as bigint) as n_from_k_fold,
  nullif(regexp_extract(path, '([^/]*)_prediction_', 1), '') as region_name, nullif(regexp_extract(path, '_prediction_(final|\d+_\d+)_', 1), '') as iteration_str,
  case when contains(path, '_prediction_') then 'ink_classes' end as prediction_type, case when not contains(path, '_prediction_') then 'name' end as error from job_files),
parsed as (select * exclude (error) from every_file where error is null),
keyed as (select *, case when iteration_str = 'final' then 9223372036854775807 else cast(split_part(iteration_str, '_', 1) as bigint) * 10000000000 + cast(split_part(iteration_str, '_', 2) as bigint) end as k from parsed),
named as (select *, replace(path, '.json', '') as region_name from sources),
cataloged as (select p.*, s.ppm, s.invert_normals, s.training, s.prediction, s.validation, s.source_ord from keyed p join named s using (region_name))"""


def outputs(t):
    return catalog.usable(catalog.parse_outputs(t.job_files))


def cataloged(t):
    return catalog.usable(catalog.with_set_flags(catalog.parse_outputs(t.job_files), t.sources))


@query("job_name_parse", "event_id:l job_dir:s n_from_k_fold:l region_name:s iteration_str:s prediction_type:s error:s", f"with {PARSED} select * from every_file", "job_files sources")
def _(t):
    """Names that do not fit show as errors."""
    return catalog.parse_outputs(t.job_files)


@query("job_order", "job_dir:s place:l", f"""
with {PARSED} select job_dir, row_number() over (order by n_from_k_fold, job_dir) as place from (select distinct job_dir, n_from_k_fold from parsed)""", "job_files sources")
def _(t):
    from ..functions import ordering

    jobs = outputs(t).select("job_dir", "n_from_k_fold").distinct()
    # jobs of one day are a bucket: those outside folds have the fold number in common, and may be most of all
    day = F.struct("n_from_k_fold", F.substring("job_dir", 1, 10).alias("day"))
    return ordering.number_rows(jobs, day, ["n_from_k_fold", "job_dir"], "place")


@query("prediction_catalog", "event_id:l region_name:s ppm:s invert_normals:b training:b prediction:b validation:b error:s", f"""
with {PARSED} select p.event_id, p.region_name, s.ppm, s.invert_normals, s.training, s.prediction, s.validation,
       coalesce(p.error, case when s.ppm is null then 'region' end) as error
from every_file p left join named s on s.region_name = p.region_name""", "job_files sources")
def _(t):
    """Outputs without a source show as errors."""
    return catalog.with_set_flags(catalog.parse_outputs(t.job_files), t.sources)


@query("names_in_paths", "event_id:l region_name:s", """
with n as (select replace(path, '.json', '') as region_name from sources) select event_id, region_name from job_files join n on contains(job_files.path, n.region_name)""", "job_files sources")
def _(t):
    names = t.sources.select(scalars.stem(F.col("path")).alias("region_name"))
    return catalog.names_in_paths(names, t.job_files, "region_name", "path")


@query("included_sets", "event_id:l region_name:s", f"with {PARSED} select event_id, region_name from cataloged where prediction or validation", "job_files sources")
def _(t):
    return catalog.only_sets(cataloged(t), ["prediction", "validation"])


@query("face_outputs", "event_id:l job_dir:s", f"""
with {PARSED} select event_id, job_dir from cataloged where ppm = 'face1' and not invert_normals and prediction_type = 'ink_classes' and iteration_str = '1_5'""", "job_files sources")
def _(t):
    """One face and label type over all jobs, at exactly one iteration."""
    return catalog.face_filter(cataloged(t), "face1", False, "ink_classes").filter("iteration_str = '1_5'")


@query("latest_as_of", "region_name:s job_dir:s iteration_str:s path:s", f"""
with {PARSED} select region_name, job_dir, iteration_str, path from (select *, row_number() over (partition by region_name, job_dir order by k desc, path desc) as rn from keyed where k <= 10000000100) where rn = 1""", "job_files sources")
def _(t):
    latest = catalog.latest_as_of(outputs(t).drop("event_id"), F.lit("1_100"), ["region_name", "job_dir"])
    return latest


@query("asof_prediction", "event_id:l job:l region:l matched_epoch:l matched_batch:l", """
with asked as (select event_id, user_id % 3 as job, user_id % 4 as region, cast(floor(event_id / 1000.0) as bigint) * 10000000000 + event_id % 1000 as k from events),
seen as (select distinct job, region, epoch * 10000000000 + batch as k from predictions),
m as (select a.event_id, a.job, a.region, max(s.k) as k from asked a left join seen s on s.job = a.job and s.region = a.region and s.k <= a.k group by all)
select event_id, job, region, k // 10000000000 as matched_epoch, k % 10000000000 as matched_batch from m""", "predictions")
def _(t):
    e = t.raw("events")
    asked = e.select("event_id", (F.col("user_id") % 3).cast("int").alias("job"), (F.col("user_id") % 4).cast("int").alias("region"),
                     (F.floor(F.col("event_id") / 1000.0) * EPOCH_STEP + F.col("event_id") % 1000).alias("k"))
    seen = t.predictions.select("job", "region", "epoch", "batch", iteration_number().alias("k")).distinct()
    hit = catalog.asof_join(asked, seen, ["job", "region"], "k", ["epoch", "batch"], EPOCH_STEP)
    return hit.withColumnsRenamed({"epoch": "matched_epoch", "batch": "matched_batch"})


@query("iteration_order", "prediction_type:s iteration_str:s place:l", f"""
with {PARSED} select prediction_type, iteration_str, row_number() over (partition by prediction_type order by k) as place from (select distinct prediction_type, iteration_str, k from keyed)""", "job_files sources")
def _(t):
    from ..functions import ordering

    listed = catalog.iteration_list(outputs(t))
    bucket = F.floor(F.col("iteration_key") / EPOCH_STEP)
    return ordering.number_rows(listed, bucket, ["iteration_key"], "place", by=["prediction_type"])


@query("last_iteration", "prediction_type:s iteration_str:s", f"with {PARSED} select prediction_type, max_by(iteration_str, k) as iteration_str from keyed group by prediction_type", "job_files sources")
def _(t):
    return catalog.last_iteration(outputs(t))


@query("faces", "ppm:s invert_normals:b width:l height:l offset_y:l", f"""
with {PARSED}, f as (select distinct ppm, invert_normals from cataloged), w as (select max(x1) as w from sources),
h as (select ppm, invert_normals, min_by(y1, source_ord) as height from sources group by ppm, invert_normals),
r as (select f.*, w.w as width, h.height, row_number() over (order by ppm, invert_normals) - 1 as n, coalesce(sum(height) over (order by ppm, invert_normals rows between unbounded preceding and 1 preceding), 0) as above
  from f join h using (ppm, invert_normals), w) select ppm, invert_normals, width, height, above + (n + 2) * (width // 10) as offset_y from r""", "job_files sources")
def _(t):
    """Faces with the height of their first region, and where each lies in a frame."""
    first = catalog.first_region(t.sources.select("ppm", "invert_normals", "source_ord", F.col("y1").alias("height")), ["ppm", "invert_normals"], "source_ord")
    heights = catalog.faces(cataloged(t)).join(first.drop("source_ord"), ["ppm", "invert_normals"], "left")
    width = t.sources.agg(F.max("x1")).scalar()
    out = catalog.layout(heights, width, ["ppm", "invert_normals"])
    return out.select("ppm", "invert_normals", width.alias("width"), "height", F.col("offset").alias("offset_y"))


@query("first_label_path", "ppm:s invert_normals:b ink_label:s mask:s", """
with m as (select *, case when source_ord % 4 <> 1 then concat('ink', source_ord) end as ink_label, case when source_ord % 5 > 1 then concat('mask', source_ord) end as mask from sources)
select ppm, invert_normals, min_by(ink_label, source_ord) filter (ink_label is not null) as ink_label, min_by(mask, source_ord) filter (mask is not null) as mask from m group by ppm, invert_normals""", "sources")
def _(t):
    k = F.col("source_ord")
    rows = t.sources.withColumns({"ink_label": F.when(k % 4 != 1, F.concat(F.lit("ink"), k)), "mask": F.when(k % 5 > 1, F.concat(F.lit("mask"), k))})
    return catalog.first_known(rows, ["ppm", "invert_normals"], ["source_ord"], ["ink_label", "mask"])


@query("face_by_name", "event_id:l path:s", f"""
with {PARSED} select c.event_id, s.path from cataloged c join sources s on s.ppm = c.ppm and s.invert_normals = c.invert_normals where s.validation""", "job_files sources")
def _(t):
    """Validation regions meet predictions by surface file name, whatever its folder."""
    here = cataloged(t).withColumn("face", scalars.file_name(F.concat(F.lit("/run/a/"), "ppm"))).select("event_id", "face", "invert_normals")
    there = t.sources.filter("validation").withColumn("face", scalars.file_name(F.concat(F.lit("/local/"), "ppm"))).select("path", "face", "invert_normals")
    return here.join(there, ["face", "invert_normals"])


@query("label_types", "event_id:l label_key:s produced:s", """
select event_id, case event_id % 3 when 0 then 'ink_label' when 1 then 'rgb_label' else 'volcart_texture_label' end as label_key,
  case event_id % 4 when 0 then 'ink_classes' when 1 then 'ink_classes,volcart_texture' when 2 then 'rgb_values' else '' end as produced from events""")
def _(t):
    """Label keys of three prediction types, and what four kinds of model produce."""
    kinds = F.array(*[F.lit(x) for x in scalars.LABEL_TYPES])
    heads = F.array(*[F.array(*[F.lit(x) for x in h]) for h in (
        ("autoencoded", "ink_classes"), ("volcart_texture", "ink_classes"), ("rgb_values",), ("autoencoded",))])
    chosen = scalars.label_column(F.get(kinds, (F.col("event_id") % 3).cast("int")))
    produced = scalars.label_types(F.get(heads, (F.col("event_id") % 4).cast("int")))
    return t.raw("events").select("event_id", chosen.alias("label_key"), F.array_join(produced, ",").alias("produced"))


@query("missing_folds", "fold:l", f"with {PARSED} select r_regionkey * 2 as fold from region where r_regionkey * 2 not in (select n_from_k_fold from parsed)", "job_files sources")
def _(t):
    wanted = t.raw("region").select((F.col("r_regionkey") * 2).alias("fold"))
    return catalog.missing_folds(wanted, outputs(t).withColumnRenamed("n_from_k_fold", "fold"), "fold")


@query("route_predictions", "path:s n:l top:l", """
select s.path, count(*) as n, max(p255) as top from predictions p join sources s on s.source_ord = p.tie2 % 25 where s.type = 'region' group by s.path""", "predictions sources")
def _(t):
    """Predictions name their source; totals are formed before the join."""
    routed = t.predictions.select(F.concat(F.lit("n"), F.col("tie2") % 25, F.lit(".json")).alias("path"), "p255")
    totals = routed.groupBy("path").agg(F.count("*").alias("n"), F.max("p255").alias("top"))
    return totals.join(t.sources.filter("type = 'region'").select("path"), "path")
