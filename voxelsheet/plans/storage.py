"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import stacks, stamps
from ..registry import query
from ..session import scratch_path
from ..sources import surface_maps, tables, volumes
from .catalogs import descriptor_rows
from .evaluation import METRICS, PAIRED, WRITE_ORDER, per_batch


@query("surface_map_roundtrip", "px:l py:l x:d y:d z:d nx:d ny:d nz:d",
       "select px, py, x, y, z, round(nx, 9) as nx, round(ny, 9) as ny, round(nz, 9) as nz from surface", "surface")
def _(t):
    path = scratch_path(t.spark, "surface") + ".ppm"
    surface_maps.write_surface_map(t.surface, path, *t.surface_size)
    back = surface_maps.read_surface_map(t.spark, path, rows_per_task=8)
    return back.withColumns({c: F.round(c, 9) for c in ("nx", "ny", "nz")})


@query("volume_scan", "z:l y:l x:l v:l", "select z - 1 as z, y - 3 as y, x - 20 as x, v from voxels where z >= 1 and z < 6 and y >= 3 and y < 60 and x >= 20 and x < 100", "voxels")
def _(t):
    """Partitioned volume: the crop prunes slices and filters inside them."""
    return stacks.crop(volumes.write_and_read(t.voxels, "volume"), (20, 3, 1, 100, 60, 6))


@query("slice_files", "z:l y:l x:l v:l", "select z - 2 as z, y - 1 as y, x - 8 as x, v from voxels where v > 0 and z >= 2 and z < 7 and y >= 1 and y < 50 and x >= 8 and x < 128", "voxels")
def _(t):
    """Raw uint16 slices with metadata, read by row ranges with a crop."""
    path = scratch_path(t.spark, "slices")
    volumes.write_slices(t.voxels, path, t.volume_shape, {"voxelsize": 10.0, "name": "scan", "type": "vol", "uuid": "0", "min": 0.0, "max": 65535.0})
    return volumes.read_slices(t.spark, path, bounding_box="8,1,2,128,50,7", rows_per_task=16).filter("v > 0")


@query("volume_metadata", "name:s slices:l height:l width:l voxelsize:d", "select 'scan' as name, depth as slices, height, width, 10 as voxelsize from volume_shape", "volume_shape")
def _(t):
    path = scratch_path(t.spark, "slices")
    volumes.write_slices(t.voxels, path, t.volume_shape, {"voxelsize": 10.0, "name": "scan", "type": "vol", "uuid": "0", "min": 0.0, "max": 65535.0})
    return volumes.read_metadata(t.spark, path)


@query("descriptor_roundtrip", "name:s kind:s n_errors:l has_box:b", "select path as name, type as kind, 0 as n_errors, type = 'region' as has_box from sources", "sources")
def _(t):
    """One file per descriptor, found again by the reader."""
    path = scratch_path(t.spark, "descriptors")
    tables.write_descriptors(descriptor_rows(t), path, scalars.stem(F.col("path")))
    out = tables.read_descriptors(t.spark, path)
    return out.select(scalars.file_name(F.col("path")).alias("name"), "kind", F.size("errors").alias("n_errors"), F.col("bounding_box").isNotNull().alias("has_box"))


@query("manifest_roundtrip", "list:s child:s ord:l", """
select s as list, path as child, row_number() over (partition by s order by source_ord) - 1 as ord
from (select *, unnest(['training', 'prediction', 'validation']) as s from sources) q where case s when 'training' then training when 'prediction' then prediction else validation end""", "sources")
def _(t):
    """Three lists written as files and read back with their order."""
    path = scratch_path(t.spark, "manifest")
    listed = _set_members(t)
    tables.write_manifests(listed, path, ["source_ord"])
    edges = tables.read_manifest_edges(t.spark, path)
    return edges.select(scalars.stem(F.col("parent")).alias("list"), scalars.file_name(F.col("child")).alias("child"), "ord")


@query("manifest_files_expanded", "place:l path:s", """
with members as (select *, row_number() over (partition by path order by s, source_ord) as seen, row_number() over (order by s, source_ord) as place
  from (select *, unnest([1, 2, 3]) as s from sources) q where case s when 1 then training when 2 then prediction else validation end)
select row_number() over (order by place) - 1 as place, path from members where seen = 1""", "sources")
def _(t):
    """A list of three lists, written as files, read and flattened."""
    from ..operators import manifests

    path = scratch_path(t.spark, "manifest")
    tables.write_manifests(_set_members(t), path, ["source_ord"])
    heads = t.spark.createDataFrame([("all", k, f"{s}.txt") for k, s in enumerate(tables.SET_TYPES)], "list string, source_ord int, path string")
    tables.write_manifests(heads, path, ["source_ord"])
    edges = tables.read_manifest_edges(t.spark, path)
    names = edges.withColumns({c: scalars.file_name(F.col(c)) for c in ("parent", "child")})
    flat = manifests.flatten(names, t.spark.createDataFrame([("all.txt", 0)], "path string, ord bigint"))
    return flat.select(F.col("position").alias("place"), "path")


def _set_members(t):
    listed = F.array(*[F.when(F.col(s), s) for s in tables.SET_TYPES])
    return t.sources.select("source_ord", "path", F.explode(F.array_compact(listed)).alias("list"))


@query("run_metadata", "job_dir:s region_name:s ppm:s invert_normals:b x0:l training:b prediction:b validation:b error:s", """
with jobs as (select r_regionkey as fold, concat('2024-01-02_03.04.05_', cast(r_regionkey as varchar)) as job_dir from region)
select job_dir, replace(path, '.json', '') as region_name, ppm, invert_normals, x0, training and source_ord % 5 <> fold as training, prediction, validation, cast(null as varchar) as error
from jobs, sources where fold < 4 and (training and source_ord % 5 <> fold or prediction or validation)
union all select job_dir, null, null, null, null, false, false, false, 'metadata' from jobs where fold = 4""", "sources")
def _(t):
    """metadata.json of five job folders, the last of them broken."""
    path = scratch_path(t.spark, "runs")
    jobs = t.raw("region").select(F.col("r_regionkey").alias("fold"), F.concat(F.lit("2024-01-02_03.04.05_"), "r_regionkey").alias("job_dir"))
    info = F.to_json(F.struct("ppm", "invert_normals", F.array("x0", "y0", "x1", "y1").alias("bounding_box")))
    entry = F.concat(F.lit('"'), "path", F.lit('":'), info)
    listed = t.sources.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3))))
    own = jobs.filter("fold < 4").join(listed, "fold")
    sets = [F.array_join(F.collect_list(F.when(F.col(s) & ((F.lit(s) != "training") | (F.col("source_ord") % 5 != F.col("fold"))), entry)), ",") for s in tables.SET_TYPES]
    text = F.concat(F.lit('{"Date": "2024-01-02", "Data": {'), *[p for k, (s, e) in enumerate(zip(tables.SET_TYPES, sets)) for p in (F.lit(f'{"," if k else ""}"{s}": {{'), e, F.lit("}"))], F.lit("}}"))
    texts = own.groupBy("job_dir").agg(text.alias("text")).unionByName(jobs.filter("fold = 4").select("job_dir", F.lit("{broken").alias("text")))
    tables.write_named_texts(texts.select(F.concat("job_dir", F.lit("/metadata.json")).alias("name"), "text"), path)
    out = tables.read_run_metadata(t.spark, path)
    return out.withColumn("x0", F.get("bounding_box", 0))


@query("byte_scan", "name:s folder:s bytes:l sha256:s", """
select concat(replace(path, '.json', ''), '.txt') as name, case when training then 'train' else 'rest' end as folder, length(ppm) + 2 * source_ord + 1 as bytes,
       sha256(concat(ppm, ':', repeat('ab', cast(source_ord as bigint)))) as sha256 from sources""", "sources")
def _(t):
    """Files of any content, read whole with the folder that relative paths are taken from."""
    path = scratch_path(t.spark, "bytes")
    folder = F.when(F.col("training"), "train").otherwise("rest")
    texts = t.sources.select(F.concat(folder, F.lit("/"), F.replace("path", F.lit(".json"), F.lit(".txt"))).alias("name"),
                             F.concat("ppm", F.lit(":"), F.repeat(F.lit("ab"), F.col("source_ord").cast("int"))).alias("text"))
    tables.write_named_texts(texts, path)
    files = tables.read_bytes(t.spark, f"{path}/*")
    return files.select(scalars.file_name(F.col("path")).alias("name"), scalars.file_name(F.col("folder")).alias("folder"),
                        F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("raster_scan", "px:l py:l r:d g:d b:d texture:d luma:l", """
select px, py, round(r / 255e0, 6) as r, round(g / 255e0, 6) as g, round(b / 255e0, 6) as b, round(texture / 65535e0, 6) as texture, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 as luma from raster""", "raster")
def _(t):
    grey = t.raster.withColumn("luma", scalars.grey(F.col("r"), F.col("g"), F.col("b")))
    return tables.normalize_raster(grey).withColumns({c: F.round(c, 6) for c in ("r", "g", "b", "texture")})


@query("raster_checks", "rgb_is_8_bit:b texture_is_16_bit:b", "select max(greatest(r, g, b)) <= 255 as rgb_is_8_bit, max(texture) between 255 and 65535 as texture_is_16_bit from raster", "raster")
def _(t):
    return tables.raster_faults(t.raster)


@query("prediction_sink", "region:l iteration:s label_type:s px:l py:l value:l", """
select region, concat(epoch, '_0') as iteration, 'ink_classes' as label_type, px, py, cast(trunc(p255 / 255e0 * 65535) as bigint) as value from (
  select *, row_number() over (partition by region, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as rn from predictions) where rn = 1""", "predictions")
def _(t):
    """Predictions as 16-bit pixels, one folder per region, iteration and label type."""
    path = scratch_path(t.spark, "predictions")
    latest = stamps.last_write(t.predictions, ["region", "epoch", "px", "py"], "p255", WRITE_ORDER)
    named = latest.select(
        "region", F.concat_ws("_", "epoch", F.lit(0)).alias("iteration"), F.lit("ink_classes").alias("label_type"), "px", "py",
        scalars.ink_pixel(F.col("p255") / 255.0).alias("value"))
    tables.write_predictions(named, path)
    return t.spark.read.schema(named.schema).parquet(path)


@query("metrics_csv", "job:l epoch:l batch:l precision:d recall:d", f"""
with {PAIRED} select job, epoch, batch, round(precision, 6) as precision, round(recall, 6) as recall from ({METRICS})""", "predictions raster")
def _(t):
    path = scratch_path(t.spark, "metrics")
    rounded = per_batch(t).select("job", "epoch", "batch", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
    tables.write_metrics(rounded, path)
    return tables.read_metrics(t.spark, path, "job int, epoch int, batch int, precision double, recall double")


@query("run_record", "started:s training:l validation:l best_f1:d", f"""
select '2024-01-02_03.04.05' as started, (select count(*) from sources where training) as training, (select count(*) from sources where validation) as validation, 0.5 as best_f1""", "sources")
def _(t):
    path = scratch_path(t.spark, "record")
    sets = t.sources.agg(F.count_if("training").alias("training"), F.count_if("validation").alias("validation"))
    stamp = F.date_format(F.lit("2024-01-02 03:04:05").cast("timestamp"), "yyyy-MM-dd_HH.mm.ss").alias("started")
    tables.write_run_record(sets.withColumn("best_f1", F.lit(None).cast("double")).select("*", stamp), path)
    tables.write_run_record(sets.withColumn("best_f1", F.lit(0.5)).select("*", stamp), path)
    return t.spark.read.schema("started string, training bigint, validation bigint, best_f1 double").json(path)


@query("sample_sink", "sample_id:l n:l total:d", "select vec_id as sample_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda v: cast(v as double))), 5) as total from feat", "feat")
def _(t):
    from ..functions import tensors

    path = scratch_path(t.spark, "samples")
    tables.write_samples(t.feat.select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("block")), path)
    back = t.spark.read.parquet(path)
    return back.select("sample_id", F.size("block").alias("n"), F.round(tensors.total(F.col("block")), 5).alias("total"))


@query("run_listing", "name:s fits:b", "select concat(path, '_prediction_final_ink_classes.png') as name, true as fits from sources where training", "sources")
def _(t):
    """Files of a run folder, listed without reading them."""
    path = scratch_path(t.spark, "run") + "/2024-01-02_03.04.05_1/predictions"
    t.sources.filter("training").select(F.concat("path", F.lit("_prediction_final_ink_classes.png")).alias("name"), F.lit("x").alias("value")).write.partitionBy("name").text(path)
    files = tables.list_files(t.spark, path, "*.txt")
    name = F.regexp_extract("path", "name=([^/]*)/", 1)
    return files.select(name.alias("name"), scalars.prediction_file_part(name, 2).eqNullSafe("final").alias("fits"))


@query("metric_series_all", "file:s pair:l date:s total:d", """
select concat('m', cast(event_id // 10000 as varchar)) as file, row_number() over (partition by event_id // 10000 order by event_id) - 1 as pair,
       strftime(ts, '%Y-%m-%d') as date, cast(event_id % 7 + event_id % 5 as double) as total from events""")
def _(t):
    """All events, in files of up to 10,000 events each, so files spread over tasks and none grows with the table."""
    path = scratch_path(t.spark, "series")
    values = F.concat_ws(",", F.lit("a,b,c,d,e"), F.col("event_id") % 7, F.col("event_id") % 5)
    lines = t.raw("events").select(F.concat(F.lit("m"), scalars.int_div(F.col("event_id"), 10_000)).alias("file"), "event_id",
                                   F.concat_ws("\n", F.date_format("ts", "yyyy-MM-dd"), values).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    texts = lines.groupBy("file").agg(F.array_join(ordered, "\n").alias("text"))
    tables.write_named_texts(texts.select(F.concat("file", F.lit(".csv")).alias("name"), "text"), path)
    rows = tables.read_metric_series(tables.read_lines(t.spark, path))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rows.select(scalars.stem(F.col("file")).alias("file"), "pair", F.date_format("date", "yyyy-MM-dd").alias("date"), total.alias("total"))
