"""Reading voxels and labels around points.

Row form: every sample cell becomes a row with an integer key and meets the
voxel table in an equi join. It suits small blocks and needs no Python. For
large blocks use :mod:`voxelsheet.operators.bricks`, which gives the same cells.

Trilinear cells meet cubes of voxels instead, which hold their eight corners.

Cells outside the volume are dropped before the join, so that only keys that
can match are shuffled. Each point carries one marker row (``cell = -1``) that
matches nothing, so a point without any cell inside still has a row. Absent
cells read as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chance, geometry as g, scalars, tensors as t
from ..functions.ordering import explode_count, spread
from . import augment
from .blocks import dense_blocks


@dataclass(frozen=True)
class BlockOptions:
    """How a block of voxels is read around a point; shapes are (z, y, x)."""

    shape: tuple[int, int, int] = (48, 48, 48)
    shape_microns: tuple[float, float, float] | None = None
    voxel_microns: float = 1.0
    move_along_normal: float = 0.0
    jitter_max: int = 0
    method: str = "nearest_neighbor"
    standardize: bool = False
    augment: bool = False
    window: tuple[float, float] | None = None
    compat_corner: bool = False
    seed: int = 0

    @property
    def ratio(self) -> tuple[float, float, float]:
        return g.size_ratio(self.shape, self.shape_microns, self.voxel_microns)

    @property
    def cells(self) -> int:
        z, y, x = self.shape
        return z * y * x


def surface_points(surface: DataFrame, invert: Column | bool = False) -> DataFrame:
    """Sampling centres of surface pixels, normals turned round where asked."""
    flip = invert if isinstance(invert, Column) else F.lit(invert)
    turned = [F.when(flip, -F.col(c)).otherwise(F.col(c)).alias(c) for c in ("nx", "ny", "nz")]
    rest = [c for c in surface.columns if c not in ("nx", "ny", "nz")]
    return surface.select(*rest, *turned)


def place_centers(points: DataFrame, options: BlockOptions, id_columns: list[str], portable: bool = False) -> DataFrame:
    """Unit normals, centres moved along them, and optional jitter.

    Adds ``cx, cy, cz`` and the nine basis columns ``xx .. zz``.
    """
    normal = g.sampling_normal(g.vec("nx", "ny", "nz"))
    unit = points.select("*", *[c.alias(f"_u{a}") for a, c in zip("xyz", normal)])
    normal = g.vec("_ux", "_uy", "_uz")
    distance = F.lit(float(options.move_along_normal))
    if options.jitter_max:
        span = 2 * options.jitter_max + 1
        step = chance.draw(options.seed, *id_columns, portable=portable) % span - options.jitter_max
        distance = distance + step
    center = g.move_along(g.vec("x", "y", "z"), normal, distance)
    basis = g.basis_from_unit_normal(normal)
    names = [f"{axis}{part}" for axis in "xyz" for part in "xyz"]
    columns = [c for v in basis for c in v]
    # Never null: keeps Catalyst from copying whole formulas into null checks.
    # A point without a position becomes NaN and fails at the cast to a key.
    sure = lambda c: F.coalesce(c, F.lit(float("nan")))
    return unit.select(
        *points.columns,
        *[sure(c).alias(f"c{a}") for a, c in zip("xyz", center)],
        *[sure(c).alias(f"b{n}") for n, c in zip(names, columns)],
    )


def _basis_columns() -> g.Basis:
    return g.Basis(*[g.vec(f"b{a}x", f"b{a}y", f"b{a}z") for a in "xyz"])


def explode_cells(placed: DataFrame, keys: list[str], options: BlockOptions) -> DataFrame:
    """One row per sample cell and the marker: keys, ``cell``, position ``qx, qy, qz``."""
    nz, ny, nx = options.shape
    cells = spread(placed, *keys).withColumn("cell", F.explode(F.sequence(F.lit(-1), F.lit(options.cells - 1))))
    z, y, x = scalars.unflatten(F.col("cell"), ny, nx)
    offset = g.Vec(g.centered_offset(x, nx), g.centered_offset(y, ny), g.centered_offset(z, nz))
    position = g.sample_position(g.vec("cx", "cy", "cz"), _basis_columns(), offset, options.ratio)
    return cells.select(*keys, "cell", *[c.alias(f"q{a}") for a, c in zip("xyz", position)])


def _inside(shape) -> Column:
    depth, height, width = shape
    return (
        F.col("z").between(0, depth - 1) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    )


def _meet(cells: DataFrame, voxels: DataFrame, shape) -> DataFrame:
    """Left join with the voxels; markers get a key no voxel has, spread over y and x."""
    marked = cells.withColumn("z", F.when(F.col("cell") < 0, -1).otherwise(F.col("z")))
    kept = marked.filter((F.col("cell") < 0) | _inside(shape))
    # A volume is never a side to broadcast, however small its files look.
    return kept.join(voxels.select("z", "y", "x", "v").hint("merge"), ["z", "y", "x"], "left")


def nearest_hits(placed: DataFrame, voxels: DataFrame, keys: list[str], options: BlockOptions, shape) -> DataFrame:
    """keys, ``cell``, ``v``."""
    cells = explode_cells(placed, keys, options).select(
        *keys, "cell", *[g.truncate(F.col(f"q{a}") + 0.5).alias(a) for a in "xyz"]
    )
    return _meet(cells, voxels, shape).select(*keys, "cell", "v")


TILE_BITS = 2


def corner_tiles(voxels: DataFrame, shape, bits: int = TILE_BITS) -> DataFrame:
    """``tz, ty, tx, tile``: voxels in cubes of 2^bits cells an axis, each with one more layer from its upper neighbours.

    All eight corners of a cell whose first corner lies in a cube are then in that
    cube's map, of at most (2^bits + 1)^3 entries. Values at one place are added up first.
    """
    edge = 1 << bits
    summed = voxels.filter(_inside(shape) & F.col("v").isNotNull()).groupBy("z", "y", "x").agg(F.sum("v").alias("v"))
    rows = summed.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(7))))
    step = {a: F.shiftright(F.col("_side"), i) % 2 for i, a in enumerate("xyz")}
    near = F.lit(True)
    for a in "xyz":
        near = near & ((step[a] == 0) | (F.col(a).bitwiseAND(edge - 1) == 0))
    local = {a: F.col(a).bitwiseAND(edge - 1) + step[a] * edge for a in "xyz"}
    place = (local["z"] * (edge + 1) + local["y"]) * (edge + 1) + local["x"]
    placed = rows.filter(near).select(*[(F.shiftright(F.col(a), bits) - step[a]).alias(f"t{a}") for a in "zyx"], place.alias("place"), "v")
    return placed.groupBy("tz", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("tile"))


def trilinear_hits(placed: DataFrame, voxels: DataFrame, keys: list[str], options: BlockOptions, shape) -> DataFrame:
    """Eight-corner weighted cells: keys, ``cell``, ``v``; weights of 0 count for nothing.

    A cell travels once, to the tile that holds all its corners. Sums get 1e-6
    before truncation, so that the order of summation cannot turn an exact integer
    into the one below. ``compat_corner`` reads corner (x1, y0, z0) where (x1, y1, z0) belongs.
    """
    edge = 1 << TILE_BITS
    base = explode_cells(placed, keys, options).select(
        *keys, "cell", *[g.truncate(F.col(f"q{a}")).alias(f"i{a}") for a in "xyz"],
        *[(F.col(f"q{a}") - g.truncate(F.col(f"q{a}"))).alias(f"d{a}") for a in "xyz"],
    )
    size = dict(zip("zyx", shape))
    corners, wanted = [], F.lit(False)
    for bits in range(8):
        step = {a: bits >> i & 1 for i, a in enumerate("xyz")}
        weight = F.lit(1.0)
        for a in "xyz":
            weight = weight * (F.col(f"d{a}") if step[a] else 1.0 - F.col(f"d{a}"))
        if options.compat_corner and step["x"] == 1 and step["z"] == 0:
            step["y"] = 0
        inside = weight != 0
        for a in "xyz":
            inside = inside & F.col(f"i{a}").between(-step[a], size[a] - 1 - step[a])
        wanted = wanted | inside
        corners.append((weight, (step["z"] * (edge + 1) + step["y"]) * (edge + 1) + step["x"]))
    # Listed, not filtered: a filter would be pushed below the positions and compute each of them many times.
    # Markers get a tile that no voxel has, spread over y and x.
    tile = lambda tz: F.array(F.struct(tz.alias("tz"), *[F.shiftright(F.col(f"i{a}"), TILE_BITS).alias(f"t{a}") for a in "yx"]))
    listed = F.when(F.col("cell") < 0, tile(F.lit(-2))).when(wanted, tile(F.shiftright(F.col("iz"), TILE_BITS)))
    keyed = base.select("*", F.explode(listed).alias("_t")).select(*base.columns, "_t.*")
    met = keyed.join(corner_tiles(voxels, shape).hint("merge"), ["tz", "ty", "tx"], "left")
    first = F.lit(0)
    for a in "zyx":
        first = first * (edge + 1) + F.col(f"i{a}").bitwiseAND(edge - 1)
    at = met.withColumn("_first", first)
    shares = at.select(*keys, "cell", *[F.when(w != 0, w * F.col("tile")[F.col("_first") + k]).alias(f"_s{n}") for n, (w, k) in enumerate(corners)])
    names = [f"_s{n}" for n in range(8)]
    whole = F.lit(0.0)
    for name in names:
        whole = whole + F.coalesce(name, F.lit(0.0))
    some = shares.select(*keys, "cell", F.when(F.coalesce(*names).isNotNull(), whole).alias("s"))
    summed = some.groupBy(*keys, "cell").agg(F.sum("s").alias("s"))
    return summed.select(*keys, "cell", F.pmod(F.floor(F.col("s") + 1e-6).cast("bigint"), F.lit(65536)).cast("int").alias("v"))


SAMPLING_METHODS = {"nearest_neighbor": nearest_hits, "interpolated": trilinear_hits}


def gather(points: DataFrame, voxels: DataFrame, keys: list[str], options: BlockOptions, shape,
           portable: bool = False) -> DataFrame:
    """Non-empty cells around points that carry ``x, y, z, nx, ny, nz``."""
    if options.method not in SAMPLING_METHODS:
        raise ValueError(f"unknown sampling method {options.method!r}")
    placed = place_centers(points, options, keys, portable)
    return SAMPLING_METHODS[options.method](placed, voxels, keys, options, shape)


def summarize(hits: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """Per point: cell count, sum and maximum, absent cells counted as 0."""
    v = F.coalesce("v", F.lit(0))
    return hits.groupBy(*keys).agg(
        F.lit(cells).cast("bigint").alias("n"), F.sum(v.cast("bigint")).alias("sum_v"), F.max(v).alias("max_v")
    )


def as_blocks(hits: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """One dense ``block`` array per point. A group holds at most ``cells`` + 1 rows."""
    return dense_blocks(hits, keys, "cell", "v", cells, (F.col("cell") >= 0) & F.col("v").isNotNull())


def finish_block(block: Column, options: BlockOptions, ids: list[str], portable: bool = False) -> Column:
    """uint16 block to a model input: window, [0, 1], flips, [-1, 1], standardise.

    Flips happen only when ``augment`` is on: :func:`~voxelsheet.operators.augment.random_flips`.
    """
    scaled = block
    if options.window is not None:
        low, high = options.window
        scaled = F.transform(scaled, lambda v: F.floor(scalars.rewindow(v.cast("double"), low, high, 0.0, 65535.0)))
    scaled = F.transform(scaled, lambda v: scalars.unit_from_uint16(v.cast("double")))
    if options.augment:
        key = F.col(ids[0]) if len(ids) == 1 else F.xxhash64(*ids)
        scaled = augment.random_flips(scaled, options.shape, options.seed, key, portable)
    scaled = F.transform(scaled, scalars.centered)
    return t.standardize(scaled) if options.standardize else scaled


# --- other block shapes -------------------------------------------------------


def axis_aligned(points: DataFrame, voxels: DataFrame, keys: list[str], block, shape) -> DataFrame:
    """Box slice turned to the strongest normal axis: keys, ``cell``, ``v``; marker rows as above.

    Boxes that leave the volume, and shapes the quarter turn does not map onto
    themselves, have no cells and read as zero.
    """
    sz, sy, sx = block
    rz, ry, rx = sz // 2, sy // 2, sx // 2
    size = {"z": shape[0], "y": shape[1], "x": shape[2]}
    ax, ay, az = (F.abs(F.col(c)) for c in ("nx", "ny", "nz"))
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    strongest = F.when(axis == 0, F.col("nx")).when(axis == 1, F.col("ny")).otherwise(F.col("nz"))
    start = points.select(
        *keys, axis.alias("axis"), (strongest < 0).alias("turned"),
        *[F.rint(F.col(c)).cast("int").alias(f"c{c}") for c in "xyz"],
    )
    # Half sizes along volume x, y, z and the block shape each case yields.
    half = {0: {"x": rz, "y": rx, "z": ry}, 1: {"x": ry, "y": rz, "z": rx}, 2: {"x": rx, "y": ry, "z": rz}}
    yields = {0: (2 * rz, 2 * rx, 2 * ry), 1: (2 * rz, 2 * rx, 2 * ry), 2: (2 * rz, 2 * ry, 2 * rx)}
    usable = F.lit(False)
    for case in range(3):
        fits = F.lit(yields[case] == (sz, sy, sx))
        for a in "xyz":
            h = half[case][a]
            fits = fits & (F.col(f"c{a}") - h >= 0) & (F.col(f"c{a}") + h <= size[a])
        usable = usable | ((F.col("axis") == case) & fits)
    reach = F.when(usable, F.sequence(F.lit(-1), F.lit(sz * sy * sx - 1))).otherwise(F.array(F.lit(-1)))
    cells = spread(start, *keys).withColumn("cell", F.explode(reach))
    a, b, c = scalars.unflatten(F.col("cell"), sy, sx)
    a = F.when(F.col("turned"), sz - 1 - a).otherwise(a)
    b = F.when(F.col("turned"), sy - 1 - b).otherwise(b)
    case = F.col("axis")
    x = F.when(case == 0, F.col("cx") - rz + a).when(case == 1, F.col("cx") - ry + c).otherwise(F.col("cx") - rx + c)
    y = F.when(case == 0, F.col("cy") - rx + b).when(case == 1, F.col("cy") - rz + a).otherwise(F.col("cy") - ry + b)
    z = F.when(case == 0, F.col("cz") + ry - 1 - c).when(case == 1, F.col("cz") + rx - 1 - b).otherwise(F.col("cz") - rz + a)
    at = cells.select(*keys, "cell", z.alias("z"), y.alias("y"), x.alias("x"))
    return _meet(at, voxels, shape).select(*keys, "cell", "v")


def oblique_slice(requests: DataFrame, voxels: DataFrame, keys: list[str], radius: int, resolution: float, shape) -> DataFrame:
    """Square slice through a point, turned by Euler angles; positions outside
    the volume read the nearest voxel inside. ``row`` and ``col`` are those of
    the transposed picture. Requests carry ``x, y, z, ax, ay, az``.
    """
    side = 2 * radius + 1
    cells = spread(requests, *keys).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    i = scalars.int_div(F.col("cell"), side)
    j = F.col("cell") % side
    flat = g.Vec((i - radius).cast("double"), (j - radius).cast("double"), F.lit(0.0))
    turned = g.euler_rotate(flat, F.col("ax"), F.col("ay"), F.col("az"))
    depth, height, width = shape
    at = [g.truncate(t / F.lit(float(resolution)) + F.col(a)) for t, a in zip(turned, "xyz")]
    limits = (width - 1, height - 1, depth - 1)
    keyed = cells.select(
        *keys, j.alias("row"), i.alias("col"), *[c.alias(f"raw_{a}") for c, a in zip(at, "xyz")],
        *[scalars.clip(c, 0, top).alias(a) for c, a, top in zip(at, "xyz", limits)],
    )
    joined = keyed.join(voxels.select("z", "y", "x", "v"), ["z", "y", "x"], "left")
    return joined.select(*keys, "row", "col", "raw_x", "raw_y", "raw_z", F.coalesce("v", F.lit(0)).alias("v"))


def slice_radius(radius_microns: float, voxel_microns: float, resolution: float) -> int:
    return int(radius_microns // voxel_microns * resolution)


def oblique_corners(requests: DataFrame, keys: list[str], radius: int, resolution: float) -> DataFrame:
    """The four corners of the slice in drawing order, as volume positions."""
    order = [(-radius, -radius), (-radius, radius), (radius, radius), (radius, -radius)]
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("corner"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("w"))
                                 for n, (u, v) in enumerate(order)]))
    rows = requests.select("*", corner.alias("c"))
    turned = g.euler_rotate(g.Vec(F.col("c.u"), F.col("c.w"), F.lit(0.0)), F.col("ax"), F.col("ay"), F.col("az"))
    at = [g.truncate(t / F.lit(float(resolution)) + F.col(a)) for t, a in zip(turned, "xyz")]
    return rows.select(*keys, "c.corner", *[c.alias(f"corner_{a}") for c, a in zip(at, "xyz")],
                       *[F.col(a).alias(f"at_{a}") for a in "xyz"])


def plane_crossings(corners: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Where the slice's four edges cross the plane ``axis = at_axis``.

    An edge that changes side gives the interpolated point; an edge lying in
    the plane gives its first corner; others give nothing. Each request has
    four corners, so its array is bounded.
    """
    across = [a for a in "xyz" if a != axis]
    ring = corners.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("corner", "corner_x", "corner_y", "corner_z", "at_x", "at_y", "at_z"))).alias("ring")
    )
    edge = ring.select(*keys, "ring", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("edge"))
    p = F.col("ring")[F.col("edge")]
    q = F.col("ring")[(F.col("edge") + 1) % 4]
    plane = p[f"at_{axis}"]
    d0, d1 = p[f"corner_{axis}"] - plane, q[f"corner_{axis}"] - plane
    changes = F.signum(d0) != F.signum(d1)
    lies = (d0 == 0) & (d1 == 0)
    t = F.try_divide(-d0, q[f"corner_{axis}"] - p[f"corner_{axis}"])
    points = [
        F.when(changes, p[f"corner_{a}"] + t * (q[f"corner_{a}"] - p[f"corner_{a}"]))
        .otherwise(p[f"corner_{a}"].cast("double")).alias(n)
        for a, n in zip(across, ("u", "w"))
    ]
    return edge.filter(changes | lies).select(*keys, "edge", *points)


def next_seeds(points: DataFrame, keys: list[str], radius_microns: float, voxel_microns: float, shape) -> DataFrame:
    """Four neighbours of each point in its turned plane, inside the volume."""
    steps = [(1, 0), (0, -1), (-1, 0), (0, 1)]
    step = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w"))
                               for n, (u, w) in enumerate(steps)]))
    rows = points.select("*", step.alias("s"))
    turned = g.euler_rotate(g.Vec(F.col("s.u"), F.col("s.w"), F.lit(0.0)), F.col("ax"), F.col("ay"), F.col("az"))
    at = [g.truncate(t * radius_microns / voxel_microns + F.col(a)) for t, a in zip(turned, "xyz")]
    moved = rows.select(*keys, "s.step", *[c.alias(f"next_{a}") for c, a in zip(at, "xyz")])
    depth, height, width = shape
    return moved.filter(
        F.col("next_x").between(0, width - 1) & F.col("next_y").between(0, height - 1) & F.col("next_z").between(0, depth - 1)
    )


def request_blocks(requests: DataFrame, voxels: DataFrame, shape, interval: float = 1.0) -> DataFrame:
    """Blocks with an explicit basis and radii: 2r+1 cells per axis.

    Requests carry ``request_id, cx, cy, cz, rx, ry, rz`` and optionally the
    nine basis columns; without them the axes are those of the volume. Radii
    may differ from row to row.
    """
    axes = {f"b{a}{b}": 1.0 if a == b else 0.0 for a in "xyz" for b in "xyz"}
    placed = requests.select(
        "request_id", "cx", "cy", "cz", "rx", "ry", "rz",
        *[(F.col(n) if n in requests.columns else F.lit(v)).alias(n) for n, v in axes.items()],
    )
    side = [2 * F.col(f"r{a}") + 1 for a in "zyx"]
    count = side[0].cast("bigint") * side[1] * side[2] + 1
    cells = explode_count(placed, count, "cell").withColumn("cell", F.col("cell") - 1)
    index = scalars.unflatten(F.col("cell"), side[1], side[2])
    oz, oy, ox = (i - F.col(f"r{a}") for i, a in zip(index, "zyx"))
    at = g.sample_position(g.vec("cx", "cy", "cz"), _basis_columns(), g.Vec(ox, oy, oz), (interval, interval, interval))
    keyed = cells.select("request_id", F.col("cell").cast("int").alias("cell"), "rx", "ry", "rz", *[g.truncate(c + 0.5).alias(a) for c, a in zip(at, "xyz")])
    return _meet(keyed, voxels, shape).select("request_id", "cell", "v")


def label_hits(points: DataFrame, raster: DataFrame, keys: list[str], value: Column, patch: tuple[int, int]) -> DataFrame:
    """Label cells of an ``h x w`` window centred by ``shape // 2``: keys, ``cell``, ``v``.

    Only pixels with a value enter the join; the rest, and pixels off the
    surface, read as 0. ``points`` carry ``face_id, px, py``.
    """
    h, w = patch
    cells = spread(points, *keys).withColumn("cell", F.explode(F.sequence(F.lit(-1), F.lit(h * w - 1))))
    row = F.col("py") - h // 2 + scalars.int_div(F.col("cell"), w)
    at = cells.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "cell", "face_id",
        (F.col("px") - w // 2 + F.col("cell") % w).alias("px"),
        F.when(F.col("cell") < 0, -1).otherwise(row).alias("py"),
    )
    labelled = raster.select("face_id", "px", "py", value.alias("v")).filter(F.col("v") != 0)
    met = at.join(labelled, ["face_id", "px", "py"], "left")
    return met.select(*[F.col(f"_k_{k}").alias(k) for k in keys], "cell", "v")
