"""Vector geometry as Column expressions, and the fuzzy comparisons that all operators share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tolerance of every comparison of lengths.
EPSILON = 1e-10
TAU = 6.283185307179586
PI = TAU / 2


def eq(a, b) -> Column:
    return F.abs(a - b) <= EPSILON


def lt(a, b) -> Column:
    return a + EPSILON < b


def gt(a, b) -> Column:
    return a - EPSILON > b


def le(a, b) -> Column:
    return a < b + EPSILON


def ge(a, b) -> Column:
    return a + EPSILON > b


def rounded(x: Column, places: int) -> Column:
    """F.round() of doubles, without a negative zero. F.round() goes by way of decimal numbers, which takes longer than all else that
    is done with a row; so only numbers near the middle between two results, and very large ones, go that way."""
    scale = float(10**places)
    steps = x * F.lit(scale)
    whole = F.rint(steps)
    clear = (F.abs(steps - whole) < F.lit(0.5 - 1e-6)) & (F.abs(steps) < F.lit(1e9))
    return F.when(clear, whole / F.lit(scale)).otherwise(F.round(x, places)) + F.lit(0.0)


class Vec(NamedTuple):
    """Three Columns (or numbers) as a vector."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str) -> Vec:
        return cls(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def over(self, k) -> Vec:
        return Vec(self.x / k, self.y / k, self.z / k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def aliased(self, prefix: str) -> list[Column]:
        return [self.x.alias(f"{prefix}x"), self.y.alias(f"{prefix}y"), self.z.alias(f"{prefix}z")]


def square_distance(a: Vec, b: Vec) -> Column:
    d = a.minus(b)
    return d.dot(d)


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(square_distance(a, b))


def spheres_intersect(d2, ra, rb) -> Column:
    """Spheres at a squared distance d2 that share more than a point."""
    return lt(d2, (ra + rb) * (ra + rb))


def sphere_contains(d2, outer, inner) -> Column:
    """Whether the sphere of radius ``outer`` contains, or equals, the one of radius ``inner``."""
    return ge(outer, inner) & le(d2, (outer - inner) * (outer - inner))


def spheres_equal(a: Vec, ra, b: Vec, rb) -> Column:
    return points_equal(a, b) & eq(ra, rb)


def points_equal(a: Vec, b: Vec) -> Column:
    return eq(a.x, b.x) & eq(a.y, b.y) & eq(a.z, b.z)


def plane_offset(d, ra, rb) -> Column:
    """Signed distance from the first centre to the radical plane of two spheres d apart."""
    return F.when(d < EPSILON, F.lit(0.0)).otherwise((d * d + ra * ra - rb * rb) / (d * 2.0))


def circle_radius(h, ra) -> Column:
    """Radius of the circle in which the radical plane at offset h cuts the sphere of radius ra."""
    c = F.when(ra > 0, h / ra).otherwise(F.lit(1.0))
    return ra * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - c * c))


def halfspace(plane: Vec, normal: Vec, point: Vec) -> Column:
    """1, -1 or 0 as the point is in front of, behind or in the plane."""
    s = signed_distance(plane, normal, point)
    return F.when(gt(s, F.lit(0.0)), 1).when(lt(s, F.lit(0.0)), -1).otherwise(0)


def signed_distance(plane: Vec, normal: Vec, point: Vec) -> Column:
    return normal.over(normal.norm()).dot(point.minus(plane))


def any_normal(u: Vec) -> Vec:
    """A unit vector at right angles to u: u crossed with the axis along which it is shortest."""
    ax, ay, az = F.abs(u.x), F.abs(u.y), F.abs(u.z)
    on_x = (ax <= ay) & (ax <= az)
    on_y = ~on_x & (ay <= az)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = u.cross(Vec(one(on_x), one(on_y), one(~on_x & ~on_y)))
    return n.over(n.norm())


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return b.minus(a).cross(c.minus(a)).norm() / 2.0


def min_angle(o: Vec, a: Vec, b: Vec) -> Column:
    """The angle at o between a and b, 0 to pi."""
    p, q = a.minus(o), b.minus(o)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p.dot(q) / (p.norm() * q.norm()))))


def directed_angle(o: Vec, a: Vec, b: Vec, tip: Vec) -> Column:
    """The angle from a to b at o, counter-clockwise as seen from tip, 0 up to 2 pi."""
    p, q, axis = a.minus(o), b.minus(o), tip.minus(o)
    turn = F.atan2(axis.over(axis.norm()).dot(p.cross(q)), p.dot(q))
    return F.when(turn < 0, turn + TAU).otherwise(turn)


def rotate(axis: Vec, angle, v: Vec) -> Vec:
    """v turned around a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    return v.times(c).plus(axis.cross(v).times(s)).plus(axis.times(axis.dot(v) * (F.lit(1.0) - c)))


def exact_sum(column: Column) -> Column:
    """The sum of doubles of up to about 10^12 in all, the same whatever the order: each is split into two integers, of
    2^-20 and of 2^-48, whose sums are exact."""
    scaled = column * float(1 << 20)
    whole = F.floor(scaled)
    rest = F.round((scaled - whole) * float(1 << 28)).cast("long")
    return F.sum(whole).cast("double") / float(1 << 20) + F.sum(rest).cast("double") / float(1 << 48)
