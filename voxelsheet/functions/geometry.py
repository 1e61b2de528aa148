"""Vector, rotation and sampling-position expressions.

Everything is a Column expression, so it stays inside generated code. A vector
is a plain ``(x, y, z)`` tuple of Columns; nothing is boxed into structs on the
hot path.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Basis(NamedTuple):
    x: Vec
    y: Vec
    z: Vec


def vec(x, y, z) -> Vec:
    return Vec(*[F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z)])


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def scale(a: Vec, k) -> Vec:
    return Vec(a.x * k, a.y * k, a.z * k)


def add(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def subtract(a: Vec, b: Vec) -> Vec:
    return Vec(a.x - b.x, a.y - b.y, a.z - b.z)


def negate(a: Vec) -> Vec:
    return Vec(-a.x, -a.y, -a.z)


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Unit vector; the zero vector stays zero."""
    size = length(a)
    return Vec(*[F.when(size > 0, c / F.when(size > 0, size).otherwise(1.0)).otherwise(F.lit(0.0)) for c in a])


def angle_between(a: Vec, b: Vec) -> Column:
    return F.atan2(length(cross(a, b)), dot(a, b))


def dominant_axis(a: Vec) -> Column:
    """0, 1 or 2 for the component of largest size; later axes win ties."""
    sizes = F.array(*[F.abs(c) for c in a])
    return F.lit(3) - F.array_position(F.reverse(sizes), F.array_max(sizes)).cast("int")


def orthogonal(a: Vec) -> Vec:
    """A vector at a right angle to ``a``: its cross product with (1, -1, 0), or with +z where ``a`` lies flat.

    Fixed value: for +z this is (1, 1, 0), the axis of the half turn to -z.
    """
    flat = F.abs(a.z) * 4 < F.abs(a.x) + F.abs(a.y)
    return Vec(F.when(flat, a.y).otherwise(a.z), F.when(flat, -a.x).otherwise(a.z), F.when(flat, 0.0).otherwise(-a.x - a.y))


def with_quaternion_between(df: DataFrame, a: Vec, b: Vec, name: str) -> DataFrame:
    """Add ``{name}w .. {name}z``: the shortest rotation from ``a`` to ``b``.

    For unit vectors that is (1 + a . b, a x b), scaled to length 1; opposed
    vectors have no such axis and take an orthogonal one.
    """
    a, b = normalize(a), normalize(b)
    opposed = 1.0 + dot(a, b) < 1e-15
    parts = zip("wxyz", (1.0 + dot(a, b), *cross(a, b)), (F.lit(0.0), *orthogonal(a)))
    raw = df.select("*", *[F.when(opposed, half).otherwise(c).alias(f"_{n}") for n, c, half in parts])
    size = F.sqrt(sum((F.col(f"_{n}") * F.col(f"_{n}") for n in "xyz"), F.col("_w") * F.col("_w")))
    return raw.select(*df.columns, *[(F.col(f"_{n}") / size).alias(f"{name}{n}") for n in "wxyz"])


def rotate(v: Vec, q) -> Vec:
    """Rotate by a unit quaternion: v + 2w(u x v) + 2u x (u x v)."""
    w, u = q[0], Vec(q[1], q[2], q[3])
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, w)), cross(u, t))


def quaternion_matrix(q) -> tuple[Vec, Vec, Vec]:
    """Images of the three axes under the rotation."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return tuple(rotate(v, q) for v in (Vec(one, zero, zero), Vec(zero, one, zero), Vec(zero, zero, one)))


def sampling_normal(n: Vec) -> Vec:
    """Unit normal for sampling; absent or all-zero normals point along +z."""
    size = F.coalesce(length(n), F.lit(0.0))
    safe = F.when(size > 0, size).otherwise(F.lit(1.0))
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return Vec(*[F.when(size > 0, c / safe).otherwise(d) for c, d in zip(n, up)])


def basis_from_unit_normal(n: Vec) -> Basis:
    """Axes after the shortest rotation taking +z to the unit normal ``n``.

    With k = 1/(1+c) the rotation has a closed form. For c < 0 the same k is
    written (1-c)/(a*a+b*b), which loses no digits close to the opposed case;
    exactly opposed, it is the half turn about (1, 1, 0).
    """
    a, b, c = n
    side = a * a + b * b
    opposed = (c < 0) & (side == 0)
    k = F.when(c >= 0, 1.0 / (1.0 + F.when(c >= 0, c).otherwise(0.0))).otherwise(
        (1.0 - c) / F.when(side > 0, side).otherwise(1.0)
    )

    def pick(value, turned):
        return F.when(opposed, F.lit(turned)).otherwise(value)

    return Basis(
        Vec(pick(1.0 - a * a * k, 0.0), pick(-(a * b * k), 1.0), -a),
        Vec(pick(-(a * b * k), 1.0), pick(1.0 - b * b * k, 0.0), -b),
        Vec(a, b, c),
    )


def move_along(center: Vec, normal: Vec, distance) -> Vec:
    return add(center, scale(normal, distance))


def truncate(c: Column) -> Column:
    """Toward zero, as a machine integer."""
    return c.cast("int")


def centered_offset(index: Column, n: int) -> Column:
    """Distance of cell ``index`` of ``n`` from the block's middle.

    Truncation makes odd sizes lopsided: n = 3 gives 0, 0, 1.
    """
    return truncate(index - F.lit((n - 1) / 2.0) + 0.5)


def size_ratio(shape_voxels, shape_microns, voxel_microns):
    """Volume voxels per sample cell for each axis (z, y, x)."""
    if shape_microns is None:
        return (1.0, 1.0, 1.0)
    return tuple(m / n / voxel_microns for m, n in zip(shape_microns, shape_voxels))


def sample_position(center: Vec, basis: Basis, offset: Vec, ratio=(1.0, 1.0, 1.0)) -> Vec:
    """Volume position of one sample cell; ``ratio`` is in (z, y, x) order."""
    rz, ry, rx = ratio

    def along(c, bx, by, bz):
        return c + offset.x * bx * F.lit(rx) + offset.y * by * F.lit(ry) + offset.z * bz * F.lit(rz)

    return Vec(
        along(center.x, basis.x.x, basis.y.x, basis.z.x),
        along(center.y, basis.x.y, basis.y.y, basis.z.y),
        along(center.z, basis.x.z, basis.y.z, basis.z.z),
    )


def euler_rotate(v: Vec, ax: Column, ay: Column, az: Column) -> Vec:
    """Rotate about the fixed x, then y, then z axis."""
    sa, ca, sb, cb, sc, cc = F.sin(ax), F.cos(ax), F.sin(ay), F.cos(ay), F.sin(az), F.cos(az)
    return Vec(
        cb * cc * v.x + (sa * sb * cc - ca * sc) * v.y + (ca * sb * cc + sa * sc) * v.z,
        cb * sc * v.x + (sa * sb * sc + ca * cc) * v.y + (ca * sb * sc - sa * cc) * v.z,
        -sb * v.x + sa * cb * v.y + ca * cb * v.z,
    )


def sphere_direction(u_angle: Column, u_height: Column) -> Vec:
    """Uniform direction from two uniforms in [0, 1)."""
    theta = u_angle * F.lit(2 * math.pi)
    z = u_height * 2.0 - 1.0
    ring = F.sqrt(1.0 - z * z)
    return Vec(ring * F.cos(theta), ring * F.sin(theta), z)
