"""Rotations, rigid and similarity transforms as column expressions.

Poses are world-to-camera with OpenCV axes (x right, y down, z forward). Quaternions are w, x, y, z.
A rotation is an array of 9 numbers, row by row; a translation or point is an array of 3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions.vec import dot, norm


def _array(*parts: Column) -> Column:
    """An array that remembers its parts: a step on it takes the one that it needs, not the whole array once for every number."""
    a = F.array(*parts)
    a.__dict__["_parts"] = parts
    return a


def _at(a: Column, k: int) -> Column:
    parts = a.__dict__.get("_parts")
    return F.get(a, F.lit(k)) if parts is None else parts[k]


def rotation_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Of any length but 0 (NULL then)."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.when(n > 0, c / n) for c in (w, x, y, z))
    return _array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def quaternion_of_rotation(r: Column) -> Column:
    """w, x, y, z with w >= 0; the sign of a zero difference counts as positive."""
    d = [_at(r, 0), _at(r, 4), _at(r, 8)]
    half = lambda s: F.sqrt(F.greatest(F.lit(0.0), s)) / 2
    signed = lambda size, by: F.when(by < 0, -size).otherwise(size)
    return _array(
        half(1 + d[0] + d[1] + d[2]),
        signed(half(1 + d[0] - d[1] - d[2]), _at(r, 7) - _at(r, 5)),
        signed(half(1 - d[0] + d[1] - d[2]), _at(r, 2) - _at(r, 6)),
        signed(half(1 - d[0] - d[1] + d[2]), _at(r, 3) - _at(r, 1)),
    )


def rotate(r: Column, v: Column) -> Column:
    return _array(*[sum((_at(r, 3 * i + k) * _at(v, k) for k in range(1, 3)), _at(r, 3 * i) * _at(v, 0)) for i in range(3)])


def rotate_back(r: Column, v: Column) -> Column:
    """By the transpose."""
    return _array(*[sum((_at(r, 3 * k + i) * _at(v, k) for k in range(1, 3)), _at(r, i) * _at(v, 0)) for i in range(3)])


def multiply(a: Column, b: Column) -> Column:
    return _array(*[sum((_at(a, 3 * i + k) * _at(b, 3 * k + j) for k in range(1, 3)), _at(a, 3 * i) * _at(b, j)) for i in range(3) for j in range(3)])


def transpose(r: Column) -> Column:
    return _array(*[_at(r, 3 * j + i) for i in range(3) for j in range(3)])


def add(a: Column, b: Column, sign: int = 1) -> Column:
    return _array(*[_at(a, k) + sign * _at(b, k) for k in range(3)])


def times(a: Column, s: Column) -> Column:
    return _array(*[_at(a, k) * s for k in range(3)])


def centre(r: Column, t: Column) -> Column:
    """The camera's place in the world."""
    return times(rotate_back(r, t), F.lit(-1.0))


def angle_deg(r: Column) -> Column:
    cos = (_at(r, 0) + _at(r, 4) + _at(r, 8) - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def angle_between_deg(ra: Column, rb: Column) -> Column:
    """Angle of ra^T rb; its trace is the sum of the products of equal places."""
    cos = (sum((_at(ra, k) * _at(rb, k) for k in range(1, 9)), _at(ra, 0) * _at(rb, 0)) - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def direction_angle_deg(a: Column, b: Column) -> Column:
    cos = dot(a, b) / (norm(a) * norm(b) + 1e-12)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def relative(ra: Column, ta: Column, rb: Column, tb: Column) -> tuple[Column, Column]:
    """Rotation and translation from camera a to camera b."""
    r = multiply(rb, transpose(ra))
    return r, add(tb, rotate(r, ta), -1)


def rotation_of_vector(v: Column) -> Column:
    """Rodrigues: the rotation about ``v`` by its length in radians."""
    x, y, z = _at(v, 0), _at(v, 1), _at(v, 2)
    th = F.sqrt(x * x + y * y + z * z)
    s = F.when(th > 1e-8, F.sin(th) / th).otherwise(F.lit(1.0))
    c = F.when(th > 1e-8, (1 - F.cos(th)) / (th * th)).otherwise(F.lit(0.5))
    return _array(
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )


def rotation_of_gimbal(yaw: Column, pitch: Column) -> Column:
    """World (east, north, up) to camera; yaw clockwise from north, pitch below the horizon negative, no roll."""
    y, p = F.radians(yaw), F.radians(pitch)
    sy, cy, sp, cp = F.sin(y), F.cos(y), F.sin(p), F.cos(p)
    return _array(cy, -sy, F.lit(0.0), sy * sp, cy * sp, -cp, sy * cp, cy * cp, sp)


def similarity(s: Column, r: Column, t: Column) -> Column:
    """x -> s r x + t as a struct."""
    return F.struct(s.alias("s"), r.alias("r"), t.alias("t"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, so that nested transforms do not multiply the expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def apply_similarity(m: Column, x: Column) -> Column:
    return let(m, lambda a: let(x, lambda p: add(times(rotate(a["r"], p), a["s"]), a["t"])))


def compose_similarity(a: Column, b: Column) -> Column:
    """First b, then a."""
    return let(a, lambda p: let(b, lambda q: similarity(p["s"] * q["s"], multiply(p["r"], q["r"]), add(times(rotate(p["r"], q["t"]), p["s"]), p["t"]))))


def invert_similarity(m: Column) -> Column:
    return let(m, lambda a: similarity(1.0 / a["s"], transpose(a["r"]), times(rotate_back(a["r"], a["t"]), -1.0 / a["s"])))


def move_pose(m: Column, r: Column, t: Column) -> tuple[Column, Column]:
    """A world-to-camera pose after the world has been moved by ``m``; depths scale with it."""
    turned = multiply(r, transpose(m["r"]))
    return turned, add(times(t, m["s"]), rotate(turned, m["t"]), -1)


def project(r: Column, t: Column, x: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel of a world point as struct u, v, z; u and v are NULL for points behind the camera."""
    c = add(rotate(r, x), t)
    z = _at(c, 2)
    ahead = z > 1e-12
    return F.struct(F.when(ahead, fx * _at(c, 0) / z + cx).alias("u"), F.when(ahead, fy * _at(c, 1) / z + cy).alias("v"), z.alias("z"))


def reprojection_error(pixel: Column, u: Column, v: Column) -> Column:
    """Pixels; infinite for points behind the camera."""
    return F.coalesce(F.sqrt(F.pow(pixel["u"] - u, F.lit(2.0)) + F.pow(pixel["v"] - v, F.lit(2.0))), F.lit(float("inf")))


def intrinsics(model: Column, params: Column) -> Column:
    """fx, fy, cx, cy by camera model: three models share one focal length."""
    one = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    p = lambda k: _at(params, k)
    return F.struct(
        p(0).alias("fx"),
        F.when(one, p(0)).otherwise(p(1)).alias("fy"),
        F.when(one, p(1)).otherwise(p(2)).alias("cx"),
        F.when(one, p(2)).otherwise(p(3)).alias("cy"),
    )
