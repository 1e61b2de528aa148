"""Nested lists of sources, and the rules of source descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordering, scalars
from ..session import shared_dir

PATH_KEYS = ("volume", "ppm", "mask", "ink_label", "rgb_label", "volcart_texture_label")
REGION_KEYS = ("ppm", "mask", "invert_normals", "bounding_box", "ink_label", "rgb_label", "volcart_texture_label")
SCHEMA_VERSION = "0.1"


def expand(edges: DataFrame, roots: DataFrame, once: bool = False) -> DataFrame:
    """Every entry reached from the roots, level by level.

    ``edges``: parent, child, ord; ``roots``: path, ord. One join per nesting
    level, until a level holds no list; the levels are short tables and are
    checkpointed, so that the plan does not grow with depth. An entry that is
    its own ancestor is marked ``loop`` and not followed. With ``once`` a list
    named several times on a level is followed from its first place only, so
    lists that share lists do not multiply.

    Columns: path, parent, place (ordinals from the root), loop.
    """
    shared_dir(edges.sparkSession)
    none = F.lit(None).cast("string")
    level = roots.select("path", none.alias("parent"), F.array(F.col("ord").cast("bigint")).alias("place"),
                         F.array("path").alias("line"), F.lit(False).alias("loop")).checkpoint()
    found = level
    while True:
        lists = level.filter(F.col("path").endswith(".txt") & ~F.col("loop"))
        if lists.isEmpty():
            break
        if once:
            first = lists.groupBy("path").agg(F.min(F.struct("place", "line")).alias("first"))
            lists = first.select("path", "first.*")
        step = lists.select("place", "line", F.col("path").alias("parent")).join(edges, "parent")
        level = step.select(
            F.col("child").alias("path"), "parent", F.concat("place", F.array("ord")).alias("place"),
            F.concat("line", F.array("child")).alias("line"), F.array_contains("line", F.col("child")).alias("loop"),
        ).checkpoint()
        found = found.unionByName(level)
    return found.select("path", "parent", "place", "loop")


def flatten(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Descriptor paths in list order, each at its first position.

    ``error`` is set for entries that are neither list nor descriptor.
    """
    leaves = expand(edges, roots, once=True).filter(~F.col("path").endswith(".txt"))
    first = leaves.groupBy("path").agg(F.min("place").alias("place"))
    bucket = F.struct(F.col("place")[0], F.get("place", F.lit(1)))
    numbered = ordering.number_rows(first, bucket, ["place"], "position")
    error = F.when(~F.col("path").endswith(".json"), F.lit("not a permitted file type (.txt or .json)"))
    return numbered.select("path", (F.col("position") - 1).alias("position"), error.alias("error"))


def repeated_lists(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges that lead to a list met earlier in list order, or to an ancestor."""
    lists = expand(edges, roots).filter(F.col("path").endswith(".txt"))
    first = lists.groupBy("path").agg(F.min("place").alias("_first"))
    late = lists.join(first, "path").filter(F.col("loop") | (F.col("place") > F.col("_first")))
    return late.groupBy("parent", F.col("path").alias("child")).agg(F.max("loop").alias("loop"))


def lines_to_edges(lists: DataFrame) -> DataFrame:
    """List files (path, text) to edges; blank lines skipped, entries relative to the list."""
    lines = lists.select(F.col("path").alias("parent"), F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    kept = lines.filter(F.col("line") != "")
    joined = F.when(scalars.is_absolute(F.col("line")), F.col("line")).otherwise(
        F.concat_ws("/", F.nullif(scalars.folder(F.col("parent")), F.lit("")), F.col("line"))
    )
    return kept.select("parent", joined.alias("child"), F.col("ord").cast("bigint").alias("ord"))


# --- descriptors ------------------------------------------------------------------


def _kind(variant: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))


def parse_descriptors(texts: DataFrame) -> DataFrame:
    """Descriptor texts (path, text) to rows; faults are listed, not raised.

    Columns: path, kind (region, volume, legacy, invalid), errors, the six
    resolved paths, invert_normals, bounding_box, volume_bounding_box.
    """
    # The parser stops after the first value; text behind it is a fault too.
    closed = F.rtrim(F.regexp_replace("text", r"\s+$", "")).endswith("}")
    parsed = texts.withColumn("_v", F.when(closed, F.try_parse_json("text"))).withColumn(
        "_keys", F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"})
    )
    v, keys = F.col("_v"), F.col("_keys")
    get = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind)
    has = lambda key: F.coalesce(F.map_contains_key(keys, F.lit(key)), F.lit(False))
    legacy = has("ppms") & has("regions")
    kind_name = get("type", "string")
    box, volume_box = get("bounding_box", "array<double>"), get("volume_bounding_box", "array<double>")

    def fault(condition, text):
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))

    empty = lambda key: get(key, "string") == ""
    region = kind_name == "region"
    faults = F.array_compact(F.array(
        fault(v.isNull(), "not valid JSON"),
        fault(v.isNotNull() & legacy, "deprecated region set layout"),
        fault(v.isNotNull() & ~legacy & (F.coalesce(get("schema_version", "string"), F.lit("")) != SCHEMA_VERSION), "unsupported schema version"),
        fault(v.isNotNull() & ~legacy & ~F.coalesce(kind_name.isin("region", "volume"), F.lit(False)), "unknown type"),
        fault(v.isNotNull() & ~legacy & ~F.coalesce(_kind(v, "volume") == "STRING", F.lit(False)), "volume is not a path"),
        *[fault(region & ~has(k), f"missing {k}") for k in REGION_KEYS],
        fault(region & box.isNotNull() & ~F.size(box).isin(0, 4), "bounding box does not have 4 values"),
        fault((kind_name == "volume") & volume_box.isNotNull() & ~F.size(volume_box).isin(0, 6), "volume box does not have 6 values"),
    ))
    base = scalars.folder(F.col("path"))

    def path_of(key):
        text = get(key, "string")
        return F.when(~empty(key), scalars.resolve_path(text, base)).alias(key)

    some = lambda b: F.when(F.size(b) > 0, b.cast("array<int>"))
    rows = parsed.select(
        "path", faults.alias("errors"), legacy.alias("_legacy"), kind_name.alias("_kind"), *[path_of(k) for k in PATH_KEYS],
        F.coalesce(get("invert_normals", "boolean"), F.lit(False)).alias("invert_normals"),
        some(box).alias("bounding_box"), some(volume_box).alias("volume_bounding_box"),
    )
    kind = F.when(F.col("_legacy"), "legacy").when(F.size("errors") > 0, "invalid").otherwise(F.col("_kind"))
    return rows.withColumn("kind", kind).drop("_legacy", "_kind")


def descriptor_text(sources: DataFrame) -> Column:
    """JSON of a source row; regions carry their nine keys, volumes three.

    Expects path columns, ``invert_normals``, ``bounding_box`` and ``type``.
    """
    common = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("type"), F.col("volume")]
    region = [F.col(c) for c in ("ppm", "invert_normals", "mask", "ink_label", "rgb_label", "volcart_texture_label", "bounding_box")]
    keep_nulls = {"ignoreNullFields": "false"}
    return F.when(F.col("type") == "region", F.to_json(F.struct(*common, *region), keep_nulls)).otherwise(
        F.to_json(F.struct(*common), keep_nulls)
    )


LEGACY_SCHEMA = (
    "ppms map<string, struct<path: string, volume: string, mask: string, `ink-label`: string, `rgb-label`: string, "
    "`volcart-texture-label`: string, `invert-normal`: boolean>>, "
    "regions map<string, array<struct<ppm: string, bounds: array<int>>>>"
)


def convert_legacy(texts: DataFrame) -> DataFrame:
    """Old region sets (path, text), comments allowed, to descriptor rows.

    Names are generated from the file, set and position.
    """
    body = F.from_json("text", LEGACY_SCHEMA, {"allowComments": "true"})
    sets = texts.select("path", body.alias("b")).select("path", "b.ppms", F.explode("b.regions").alias("set_type", "regions"))
    each = sets.select("path", "ppms", "set_type", F.posexplode("regions").alias("position", "region"))
    ppm = F.col("ppms")[F.col("region.ppm")]
    name = F.concat_ws("_", scalars.stem(F.col("path")), F.col("set_type"), F.col("position"))
    return each.select(
        F.concat(name, F.lit(".json")).alias("name"), F.concat(scalars.stem(F.col("path")), F.lit("_"), "set_type", F.lit(".txt")).alias("manifest"),
        F.lit("region").alias("type"), ppm["volume"].alias("volume"), ppm["path"].alias("ppm"), ppm["mask"].alias("mask"),
        F.coalesce(ppm["invert-normal"], F.lit(False)).alias("invert_normals"), F.col("region.bounds").alias("bounding_box"),
        ppm["ink-label"].alias("ink_label"), ppm["rgb-label"].alias("rgb_label"), ppm["volcart-texture-label"].alias("volcart_texture_label"),
    )


# --- relations between sources --------------------------------------------------------


def siblings(sources: DataFrame, path: str) -> DataFrame:
    """Other sources on the surface map of one source."""
    mine = sources.filter(F.col("path") == path).agg(F.first("ppm")).scalar()
    return sources.filter((F.col("ppm") == mine) & (F.col("path") != path))


def sibling_counts(sources: DataFrame) -> DataFrame:
    """How many other sources share each source's surface map; no pairs are formed."""
    sizes = sources.groupBy("ppm").agg((F.count("*") - 1).alias("siblings"))
    return sources.select("path", "ppm").join(sizes, "ppm")


def regions_by(sources: DataFrame, key: str, order: str, bucket: int = 1024) -> DataFrame:
    """Boxes listed per mask (or other key) with their position in it."""
    return ordering.number_rows(sources, F.floor(F.col(order) / bucket), [order], "position", by=[key])


# Fixed parts of a deliverable: file suffixes with the image mode each must have.
EXTRAS = ("_alignment.psd", "_cellmap.tif", "_faux_rgb.png", "_faux_rgb.psd", "_ir.png", ".mtl", ".obj", ".png", ".ppm",
          "_surface_volume_grid2x1.txt", "_surface_volume.json", "_surface_volume.ppm", ".tif", "_uvs.png")
ROOT_FILES = ("_inklabels.png", "_mask.png")
IMAGE_MODES = {"extras/_faux_rgb.png": "RGB", "extras/_ir.png": "L", "extras/.png": "I", "_inklabels.png": "P", "_mask.png": "P"}
SLICES = 65


def audit(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Faults of deliverables. ``listing``: name, suffix, mode; slices have suffix ``slice``.

    A deliverable's files are a bit each and its slices a number, so what is grouped is one row a name.
    Columns: name, item, fault (missing, mode, slices).
    """
    expected = [f"extras/{s}" for s in EXTRAS] + list(ROOT_FILES) + ["meta.json"]
    bit, right_mode = F.lit(0), F.lit(None).cast("string")
    for n, suffix in enumerate(expected):
        bit = F.when(F.col("suffix") == suffix, 1 << n).otherwise(bit)
    bit = F.when(F.col("suffix") == "slice", 0).otherwise(bit)  # most files are slices, and are compared once
    for suffix, mode in IMAGE_MODES.items():
        right_mode = F.when(F.col("suffix") == suffix, mode).otherwise(right_mode)
    wrong = listing.filter(right_mode.isNotNull() & (F.col("mode") != right_mode))
    found = listing.groupBy("name").agg(F.bit_or(bit).alias("found"), F.count_if(F.col("suffix") == "slice").alias("n"))
    held = names.join(found, "name", "left")
    gone = [F.when(F.coalesce("found", F.lit(0)).bitwiseAND(1 << n) == 0, F.struct(F.lit(s).alias("item"), F.lit("missing").alias("fault"))) for n, s in enumerate(expected)]
    short = F.when(F.coalesce("n", F.lit(0)) != SLICES, F.struct(F.lit("slice").alias("item"), F.lit("slices").alias("fault")))
    faults = held.select("name", F.explode(F.array_compact(F.array(*gone, short))).alias("f")).select("name", "f.*")
    return faults.unionByName(wrong.select("name", F.col("suffix").alias("item"), F.lit("mode").alias("fault")))


def audit_references(descriptors: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths that descriptors name but no listing holds."""
    named = descriptors.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("target")) for k in PATH_KEYS])).alias("n"))
    targets = named.select("path", "n.*").filter(F.col("target").isNotNull())
    return targets.join(existing.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
