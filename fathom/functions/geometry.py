"""Vectors, shapes and rotations as tuples of columns; (w, x, y, z) for quaternions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, x: s + x, (x * y for x, y in zip(a, b, strict=True)))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def along(a: Vec, b: Vec, t) -> Vec:
    """a + t * b."""
    return tuple(x + t * y for x, y in zip(a, b, strict=True))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """From a point to the nearest point of a segment, which may be one point."""
    d = sub(b, a)
    size = dot(d, d)
    t = F.when(size > 0, F.least(F.greatest(dot(sub(p, a), d) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return norm(sub(p, along(a, d, t)))


def segments_cross(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Whether two plane segments share a point, touching and collinear overlap included."""
    turn = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    within = lambda p, q, r: r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    s1, s2, s3, s4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    touch = ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touch


def plane_distance(p: Vec, origin: Vec, normal: Vec) -> Column:
    """Signed."""
    return dot(sub(p, origin), normal) / norm(normal)


def ray_plane(start: Vec, direction: Vec, origin: Vec, normal: Vec) -> Column:
    """Parameter of the hit; null if the ray is parallel or points away."""
    slope = dot(direction, normal)
    t = F.try_divide(dot(sub(origin, start), normal), slope)
    return F.when(t >= 0, t)


def in_ball(p: Vec, centre: Vec, radius) -> Column:
    d = sub(p, centre)
    return dot(d, d) <= radius * radius


def balls_meet(a: Vec, ra, b: Vec, rb) -> Column:
    d = sub(a, b)
    return dot(d, d) <= (ra + rb) * (ra + rb)


def in_box(p: Vec, low: Vec, high: Vec) -> Column:
    return reduce(lambda s, x: s & x, (x.between(lo, hi) for x, lo, hi in zip(p, low, high, strict=True)))


def boxes_meet(alow: Vec, ahigh: Vec, blow: Vec, bhigh: Vec) -> Column:
    return reduce(lambda s, x: s & x, ((a <= d) & (c <= b) for a, b, c, d in zip(alow, ahigh, blow, bhigh, strict=True)))


def _axis(p: Vec, base: Vec, axis: Vec) -> tuple[Column, Column]:
    """Height along the unit axis and distance from it."""
    d = sub(p, base)
    h = dot(d, axis) / norm(axis)
    return h, F.sqrt(F.greatest(dot(d, d) - h * h, F.lit(0.0)))


def in_cylinder(p: Vec, base: Vec, axis: Vec, radius, height) -> Column:
    h, r = _axis(p, base, axis)
    return h.between(0, height) & (r <= radius)


def in_cone(p: Vec, apex: Vec, axis: Vec, radius, height) -> Column:
    h, r = _axis(p, apex, axis)
    return h.between(0, height) & (r <= radius * h / height)


def bezier(points: list[Vec], t: Column) -> Vec:
    """De Casteljau's scheme for any degree."""
    while len(points) > 1:
        points = [along(a, sub(b, a), t) for a, b in zip(points, points[1:], strict=False)]
    return points[0]


def q_mul(a: Vec, b: Vec) -> Vec:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw


def q_conjugate(q: Vec) -> Vec:
    return q[0], -q[1], -q[2], -q[3]


def q_inverse(q: Vec) -> Vec:
    n = dot(q, q)
    return tuple(x / n for x in q_conjugate(q))


def q_axis_angle(axis: Vec, angle: Column) -> Vec:
    s = F.sin(angle / 2) / norm(axis)
    return F.cos(angle / 2), axis[0] * s, axis[1] * s, axis[2] * s


def q_matrix(q: Vec) -> list[Vec]:
    """Rows of the rotation matrix of a unit quaternion."""
    w, x, y, z = q
    return [
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    ]


def q_slerp(a: Vec, b: Vec, t: Column) -> Vec:
    """Shorter way between unit quaternions; nearly equal ones are mixed linearly."""
    c = dot(a, b)
    sign, angle = F.when(c < 0, -1.0).otherwise(1.0), F.acos(F.least(F.abs(c), F.lit(1.0)))
    near = F.abs(c) > 0.999999
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = sign * F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
    mixed = tuple(wa * x + wb * y for x, y in zip(a, b, strict=True))
    size = norm(mixed)
    return tuple(x / size for x in mixed)


def transform(matrix: list[Vec], shift: Vec, p: Vec) -> Vec:
    """Rotation (or any linear map) and translation of a point."""
    return tuple(dot(row, p) + s for row, s in zip(matrix, shift, strict=True))
