"""Domain tables derived from the driver's parquet tables.

Each table exists twice: as a DataFrame plan on :class:`Tables` and as SQL text
in ``CTES`` for the checker. Both describe the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

SURFACE_WIDTH = 50
VOLUME_WIDTH = 128
N_SLABS = 6
SLAB_DEPTH = 40
VOXEL_MICRONS = 10.0


def _int(column):
    return column.cast("int")


def cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


class Tables:
    """Lazy access to the driver tables and the domain tables built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def voxels(self) -> DataFrame:
        li = self.raw("lineitem")
        return (
            li.groupBy(
                _int(F.col("l_linenumber") - 1).alias("z"),
                _int(F.col("l_suppkey")).alias("y"),
                _int(F.col("l_partkey") % VOLUME_WIDTH).alias("x"),
            )
            .agg(_int(F.max(cents("l_extendedprice") % 65536)).alias("v"))
            .select(F.lit(0).alias("volume_id"), "z", "y", "x", "v")
        )

    @cached_property
    def volume_shape(self) -> tuple[int, int, int]:
        """Declared (z, y, x) size, as a metadata file would state it."""
        top = self.raw("supplier").agg(F.max("s_suppkey")).first()[0]
        return 7, int(top) + 1, VOLUME_WIDTH

    @cached_property
    def surface(self) -> DataFrame:
        p = self.raw("part")
        a = F.col("p_size") - 25
        b = F.col("p_partkey") % 7 - 3
        length = F.sqrt(a * a + b * b + F.lit(100.0))
        return p.select(
            F.lit(0).alias("face_id"),
            _int(F.col("p_partkey") % SURFACE_WIDTH).alias("px"),
            _int(F.floor(F.col("p_partkey") / SURFACE_WIDTH)).alias("py"),
            ((F.col("p_partkey") % 50) * F.lit(2.5)).alias("x"),
            ((F.col("p_partkey") % 97) * F.lit(1.0)).alias("y"),
            (F.lit(3.0) + (F.col("p_size") % 3) * F.lit(0.5)).alias("z"),
            (a / length).alias("nx"),
            (b / length).alias("ny"),
            (F.lit(10) / length).alias("nz"),
        )

    @cached_property
    def surface_size(self) -> tuple[int, int]:
        """Declared (width, height), as the surface map's header would state it."""
        top = self.raw("part").agg(F.max("p_partkey")).first()[0]
        return SURFACE_WIDTH, int(top) // SURFACE_WIDTH + 1

    @cached_property
    def raster(self) -> DataFrame:
        p = self.raw("part")
        key = F.col("p_partkey")
        return p.select(
            F.lit(0).alias("face_id"),
            _int(key % SURFACE_WIDTH).alias("px"),
            _int(F.floor(key / SURFACE_WIDTH)).alias("py"),
            F.when(key % 41 == 0, 0).otherwise(255).alias("mask"),
            F.when(F.col("p_type").startswith("S") | (F.col("p_size") > 40), 255).otherwise(0).alias("ink"),
            _int(F.col("p_size") * 5).alias("r"),
            _int(key % 256).alias("g"),
            _int((key * 7) % 256).alias("b"),
            _int(cents("p_retailprice") % 65536).alias("texture"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            _int(F.col("l_linenumber") % 3).alias("job"),
            _int(F.col("l_linenumber")).alias("epoch"),
            _int(F.col("l_suppkey") % 10).alias("batch"),
            _int(F.col("l_partkey") % 4).alias("region"),
            _int(F.col("l_partkey") % SURFACE_WIDTH).alias("px"),
            _int(F.floor(F.col("l_partkey") / SURFACE_WIDTH)).alias("py"),
            _int(F.round(F.col("l_discount") * 10)).alias("p10"),
            _int(F.round(F.col("l_discount") * 2550)).alias("p255"),
            F.col("l_orderkey").alias("seq"),
            cents("l_extendedprice").alias("tie1"),
            F.col("l_suppkey").alias("tie2"),
        )

    @cached_property
    def slabs(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy(
            _int(F.col("l_suppkey") % N_SLABS).alias("slab"),
            _int(F.col("l_partkey") % SLAB_DEPTH).alias("z"),
            _int(F.col("l_orderkey") % 16).alias("y"),
            _int(F.col("l_linenumber")).alias("x"),
        ).agg(F.max(cents("l_extendedprice")).alias("raw"))

    @cached_property
    def metrics(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            _int(F.col("user_id") % 3).alias("job"),
            F.floor(F.col("event_id") / 1000.0).cast("bigint").alias("epoch"),
            _int(F.col("event_id") % 1000).alias("batch"),
            F.col("event_id").alias("step"),
            F.col("event_type").alias("metric"),
            cents("value").alias("value100"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def manifest_edges(self) -> DataFrame:
        regions = self.raw("region").select(
            F.lit("all.txt").alias("parent"),
            F.concat(F.lit("r"), F.col("r_regionkey"), F.lit(".txt")).alias("child"),
            F.col("r_regionkey").cast("bigint").alias("ord"),
        )
        nations = self.raw("nation").select(
            F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".txt")).alias("parent"),
            F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".json")).alias("child"),
            F.col("n_nationkey").cast("bigint").alias("ord"),
        )
        again = self.raw("nation").filter("n_nationkey = 0").select(
            F.lit("all.txt").alias("parent"), F.lit("n0.json").alias("child"), F.lit(99).cast("bigint").alias("ord")
        )
        return regions.unionByName(nations).unionByName(again)

    @cached_property
    def sources(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        row = _int(F.floor(k / 5.0))
        return n.select(
            k.alias("source_ord"),
            F.concat(F.lit("n"), k, F.lit(".json")).alias("path"),
            F.when(k % 8 == 7, "volume").otherwise("region").alias("type"),
            F.concat(F.lit("face"), F.col("n_regionkey") % 2).alias("ppm"),
            (k % 3 == 0).alias("invert_normals"),
            ((k % 5) * 10).alias("x0"),
            (row * 8).alias("y0"),
            ((k % 5) * 10 + 10).alias("x1"),
            (row * 8 + 8).alias("y1"),
            (k % 2 == 0).alias("training"),
            (k % 3 == 0).alias("prediction"),
            (k % 5 == 0).alias("validation"),
        )

    @cached_property
    def job_files(self) -> DataFrame:
        e = self.raw("events")
        day = F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0")
        iteration = F.when(F.col("event_id") % 11 == 0, "final").otherwise(
            F.concat_ws("_", F.col("event_id") % 4, F.col("event_id") % 200)
        )
        return e.select(
            "event_id",
            F.concat(
                F.lit("out/2024-01-"), day, F.lit("_10.00.00_"), F.col("user_id") % 5,
                F.lit("/predictions/"),
                F.when(F.col("event_id") % 97 == 0, "notes.txt").otherwise(F.concat(
                    F.lit("n"), F.when(F.col("event_id") % 89 == 0, 99).otherwise(F.col("user_id") % 25), F.lit("_prediction_"), iteration,
                    F.lit("_ink_classes.png"))),
            ).alias("path"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("request_id"),
            F.lit(0).alias("volume_id"),
            ((k % 100) * F.lit(1.0)).alias("cx"),
            ((k % 90) * F.lit(1.0)).alias("cy"),
            F.lit(3.0).alias("cz"),
            F.lit(2).alias("rx"), F.lit(2).alias("ry"), F.lit(1).alias("rz"),
        )

    @cached_property
    def feat(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", "embedding", "label", (F.col("label") % 2).alias("ink")
        )


CTES = {
    "voxels": """
        select 0 as volume_id, l_linenumber - 1 as z, l_suppkey as y, l_partkey % 128 as x,
               max(cast(round(l_extendedprice * 100) as bigint) % 65536) as v
        from lineitem group by l_linenumber - 1, l_suppkey, l_partkey % 128""",
    "volume_shape": "select 7 as depth, cast(max(s_suppkey) as bigint) + 1 as height, 128 as width from supplier",
    "surface": """
        select 0 as face_id, p_partkey % 50 as px, cast(floor(p_partkey / 50.0) as bigint) as py,
               (p_partkey % 50) * 2.5e0 as x, (p_partkey % 97) * 1.0e0 as y, 3.0e0 + (p_size % 3) * 0.5e0 as z,
               (p_size - 25) / sqrt((p_size - 25) * (p_size - 25) + (p_partkey % 7 - 3) * (p_partkey % 7 - 3) + 100.0e0) as nx,
               (p_partkey % 7 - 3) / sqrt((p_size - 25) * (p_size - 25) + (p_partkey % 7 - 3) * (p_partkey % 7 - 3) + 100.0e0) as ny,
               10 / sqrt((p_size - 25) * (p_size - 25) + (p_partkey % 7 - 3) * (p_partkey % 7 - 3) + 100.0e0) as nz
        from part""",
    "surface_size": "select 50 as w, cast(floor(max(p_partkey) / 50.0) as bigint) + 1 as h from part",
    "raster": """
        select 0 as face_id, p_partkey % 50 as px, cast(floor(p_partkey / 50.0) as bigint) as py,
               case when p_partkey % 41 = 0 then 0 else 255 end as mask,
               case when p_type like 'S%' or p_size > 40 then 255 else 0 end as ink,
               p_size * 5 as r, p_partkey % 256 as g, (p_partkey * 7) % 256 as b,
               cast(round(p_retailprice * 100) as bigint) % 65536 as texture
        from part""",
    "predictions": """
        select l_linenumber % 3 as job, cast(l_linenumber as bigint) as epoch, l_suppkey % 10 as batch,
               l_partkey % 4 as region, l_partkey % 50 as px, cast(floor(l_partkey / 50.0) as bigint) as py,
               cast(round(l_discount * 10) as int) as p10, cast(round(l_discount * 2550) as int) as p255,
               l_orderkey as seq, cast(round(l_extendedprice * 100) as bigint) as tie1, l_suppkey as tie2
        from lineitem""",
    "slabs": """
        select l_suppkey % 6 as slab, l_partkey % 40 as z, l_orderkey % 16 as y, l_linenumber as x,
               max(cast(round(l_extendedprice * 100) as bigint)) as raw
        from lineitem group by l_suppkey % 6, l_partkey % 40, l_orderkey % 16, l_linenumber""",
    "metrics": """
        select user_id % 3 as job, cast(floor(event_id / 1000.0) as bigint) as epoch, event_id % 1000 as batch,
               event_id as step, event_type as metric, cast(round(value * 100) as bigint) as value100, ts
        from events""",
    "manifest_edges": """
        select 'all.txt' as parent, concat('r', cast(r_regionkey as varchar), '.txt') as child, cast(r_regionkey as bigint) as ord from region
        union all
        select concat('r', cast(n_regionkey as varchar), '.txt'), concat('n', cast(n_nationkey as varchar), '.json'), cast(n_nationkey as bigint) from nation
        union all
        select 'all.txt', 'n0.json', cast(99 as bigint)""",
    "sources": """
        select n_nationkey as source_ord, concat('n', cast(n_nationkey as varchar), '.json') as path,
               case when n_nationkey % 8 = 7 then 'volume' else 'region' end as type,
               concat('face', cast(n_regionkey % 2 as varchar)) as ppm, n_nationkey % 3 = 0 as invert_normals,
               (n_nationkey % 5) * 10 as x0, cast(floor(n_nationkey / 5.0) as bigint) * 8 as y0,
               (n_nationkey % 5) * 10 + 10 as x1, cast(floor(n_nationkey / 5.0) as bigint) * 8 + 8 as y1,
               n_nationkey % 2 = 0 as training, n_nationkey % 3 = 0 as prediction, n_nationkey % 5 = 0 as validation
        from nation""",
    "job_files": """
        select event_id, concat('out/2024-01-', case when user_id % 28 < 9 then '0' else '' end, cast(user_id % 28 + 1 as varchar),
               '_10.00.00_', cast(user_id % 5 as varchar), '/predictions/',
               case when event_id % 97 = 0 then 'notes.txt' else concat('n', cast(case when event_id % 89 = 0 then 99 else user_id % 25 end as varchar), '_prediction_',
               case when event_id % 11 = 0 then 'final' else concat(cast(event_id % 4 as varchar), '_', cast(event_id % 200 as varchar)) end,
               '_ink_classes.png') end) as path
        from events""",
    "requests": """
        select s_suppkey as request_id, 0 as volume_id, (s_suppkey % 100) * 1.0e0 as cx, (s_suppkey % 90) * 1.0e0 as cy, 3.0e0 as cz,
               2 as rx, 2 as ry, 1 as rz
        from supplier""",
    "feat": "select vec_id, embedding, label, label % 2 as ink from embeddings",
}
