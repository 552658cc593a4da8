"""Rotations, rigid motions and projections as tuples of columns; quaternions are (w, x, y, z), matrices lists of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import geometry as G

Vec = G.Vec


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def pure(v: Vec) -> Vec:
    """The quaternion of a vector."""
    return (F.lit(0.0), *v)


def from_euler(x: Column, y: Column, z: Column) -> Vec:
    """Turn about the x, then the y, then the z axis of space: Rz Ry Rx."""
    axes = [tuple(F.lit(float(i == k)) for i in range(3)) for k in range(3)]
    a, b, c = (G.q_axis_angle(axis, angle) for axis, angle in zip(axes, (x, y, z), strict=True))
    return G.q_mul(c, G.q_mul(b, a))


def to_euler(q: Vec) -> Vec:
    """Angles (x, y, z) of from_euler; at the poles z is counted in x. Sines whose two terms cancel but for rounding are zero."""
    m = G.q_matrix(q)
    w, x, y, z = q
    sine_x, sine_y, sine_z = (2 * _cancelled(a, b) for a, b in ((w * x, y * z), (w * y, -x * z), (w * z, x * y)))
    s = F.greatest(F.least(sine_y, F.lit(1.0)), F.lit(-1.0))
    pole = F.abs(s) > 1 - 1e-12
    return F.when(pole, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(sine_x, m[2][2])), F.asin(s), F.when(pole, 0.0).otherwise(F.atan2(sine_z, m[0][0]))


def _cancelled(a: Column, b: Column) -> Column:
    """a + b, zero where it is below the rounding error of a and b, products of a few factors each."""
    return F.when(F.abs(a + b) <= 16 * 2.0**-53 * (F.abs(a) + F.abs(b)), 0.0).otherwise(a + b)


def from_matrix(m: list[Vec]) -> Vec:
    """The unit quaternion, w not negative, of a rotation matrix; the largest component is worked out first."""
    t = m[0][0] + m[1][1] + m[2][2]
    squares = [1 + t, 1 + 2 * m[0][0] - t, 1 + 2 * m[1][1] - t, 1 + 2 * m[2][2] - t]
    products = {(0, 1): m[2][1] - m[1][2], (0, 2): m[0][2] - m[2][0], (0, 3): m[1][0] - m[0][1], (1, 2): m[0][1] + m[1][0], (1, 3): m[0][2] + m[2][0], (2, 3): m[1][2] + m[2][1]}
    most = F.greatest(*squares)
    forms = []
    for k in range(4):
        root = F.sqrt(F.greatest(squares[k], F.lit(1e-300)))
        forms.append([root / 2 if i == k else products[min(i, k), max(i, k)] / (2 * root) for i in range(4)])
    q = [F.when(squares[0] == most, forms[0][i]).when(squares[1] == most, forms[1][i]).when(squares[2] == most, forms[2][i]).otherwise(forms[3][i]) for i in range(4)]
    return tuple(F.when(q[0] < 0, -x).otherwise(x) for x in q)


def angle(q: Vec) -> Column:
    """Between 0 and pi for w >= 0."""
    return 2 * F.atan2(G.norm(q[1:]), q[0])


def axis(q: Vec) -> Vec:
    """Unit vector; the x axis where nothing turns."""
    n = G.norm(q[1:])
    return tuple(F.when(n > 0, x / F.when(n > 0, n)).otherwise(float(k == 0)) for k, x in enumerate(q[1:]))


def rotate(q: Vec, v: Vec) -> Vec:
    return G.q_mul(G.q_mul(q, pure(v)), G.q_conjugate(q))[1:]


Matrix = list[tuple]


def translation(shift: Vec) -> Matrix:
    return [(*(F.lit(float(i == j)) for j in range(3)), _c(shift[i])) for i in range(3)] + [_LAST]


def scaling(factors: Vec) -> Matrix:
    return [(*(_c(factors[i]) if i == j else F.lit(0.0) for j in range(3)), F.lit(0.0)) for i in range(3)] + [_LAST]


_LAST = (0.0, 0.0, 0.0, 1.0)


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        new = []
        for j in range(len(b[0])):
            s = _c(row[0]) * _c(b[0][j])
            for k in range(1, len(row)):
                s = s + _c(row[k]) * _c(b[k][j])
            new.append(s)
        out.append(tuple(new))
    return out


def apply(m: Matrix, p: Vec) -> Vec:
    """A point through a 4 x 4 matrix, divided by its last coordinate."""
    h = [x[0] for x in product(m, [(c,) for c in (*p, F.lit(1.0))])]
    return tuple(x / h[3] for x in h[:3])


@dataclass(frozen=True)
class Isometry:
    """Rotation, then translation."""

    rotation: Vec
    shift: Vec

    def __call__(self, p: Vec) -> Vec:
        return tuple(a + b for a, b in zip(rotate(self.rotation, p), self.shift, strict=True))

    def __mul__(self, o: Isometry) -> Isometry:
        return Isometry(G.q_mul(self.rotation, o.rotation), self(o.shift))

    def inverse(self) -> Isometry:
        back = G.q_conjugate(self.rotation)
        return Isometry(back, tuple(-x for x in rotate(back, self.shift)))

    def matrix(self, size=1.0) -> Matrix:
        """Size other than 1: a similarity."""
        return [(*(x * size for x in row), s) for row, s in zip(G.q_matrix(self.rotation), self.shift, strict=True)] + [_LAST]


@dataclass(frozen=True)
class DualQuaternion:
    """A rigid motion as a pair of quaternions."""

    real: Vec
    dual: Vec

    @staticmethod
    def of(m: Isometry) -> DualQuaternion:
        return DualQuaternion(m.rotation, tuple(x / 2 for x in G.q_mul(pure(m.shift), m.rotation)))

    def __mul__(self, o: DualQuaternion) -> DualQuaternion:
        a, b = G.q_mul(self.real, o.dual), G.q_mul(self.dual, o.real)
        return DualQuaternion(G.q_mul(self.real, o.real), tuple(x + y for x, y in zip(a, b, strict=True)))

    def translation(self) -> Vec:
        return tuple(2 * x for x in G.q_mul(self.dual, G.q_conjugate(self.real))[1:])

    def isometry(self) -> Isometry:
        return Isometry(self.real, self.translation())


def perspective(height_angle: Column, aspect, near, far) -> Matrix:
    """Eye space (looking along -z) to clip space with depths -1 to 1."""
    f = 1 / F.tan(_c(height_angle) / 2)
    near, far = _c(near), _c(far)
    return [(f / _c(aspect), 0.0, 0.0, 0.0), (0.0, f, 0.0, 0.0), (0.0, 0.0, (far + near) / (near - far), 2 * far * near / (near - far)), (0.0, 0.0, -1.0, 0.0)]


def orthographic(left, right, bottom, top, near, far) -> Matrix:
    ends = [(_c(a), _c(b)) for a, b in ((left, right), (bottom, top), (near, far))]
    out = []
    for k, (a, b) in enumerate(ends):
        row = [0.0, 0.0, 0.0, -(b + a) / (b - a)]
        row[k] = (2.0 if k < 2 else -2.0) / (b - a)
        out.append(tuple(row))
    return [*out, _LAST]


def look_at(eye: Vec, target: Vec, up: Vec) -> Matrix:
    """World to eye space."""
    unit = lambda v: tuple(x / G.norm(v) for x in v)
    f = unit(G.sub(target, eye))
    s = unit(G.cross(f, up))
    u = G.cross(s, f)
    return [(*s, -G.dot(s, eye)), (*u, -G.dot(u, eye)), (*(-x for x in f), G.dot(f, eye)), _LAST]
