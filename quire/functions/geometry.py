"""Expressions over boxes ``x0, y0, x1, y1`` and affine matrices ``a..f``, all of them columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
POINTS_PER_INCH, EMU_PER_INCH, TWIPS_PER_POINT = 72, 914_400, 20
HEADER_SHARE, FOOTER_SHARE = 0.12, 0.88


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in cls._fields))

    @property
    def area(self) -> Column:
        return F.greatest(self.x1 - self.x0, F.lit(0.0)) * F.greatest(self.y1 - self.y0, F.lit(0.0))


class Matrix(NamedTuple):
    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    def then(self, m: Matrix) -> Matrix:
        """This one first, then ``m``."""
        return Matrix(
            self.a * m.a + self.b * m.c,
            self.a * m.b + self.b * m.d,
            self.c * m.a + self.d * m.c,
            self.c * m.b + self.d * m.d,
            self.e * m.a + self.f * m.c + m.e,
            self.e * m.b + self.f * m.d + m.f,
        )

    def point(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def bounds(self, box: Box) -> Box:
        """The upright box around the transformed one."""
        ps = [self.point(x, y) for x in (box.x0, box.x1) for y in (box.y0, box.y1)]
        xs, ys = zip(*ps, strict=True)
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    common = intersection_area(a, b)
    union = a.area + b.area - common
    return F.when(union > 0, common / union).otherwise(0.0)


def covered_share(a: Box, b: Box) -> Column:
    """How much of ``a`` lies in ``b``; 0 where ``a`` has no area."""
    return F.when(a.area > 0, intersection_area(a, b) / a.area).otherwise(0.0)


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Common width over the smaller width; 0 where that is empty."""
    width = F.least(a.x1 - a.x0, b.x1 - b.x0)
    common = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    return F.when(width > 0, common / width).otherwise(0.0)


def vertical_distance(a: Box, b: Box) -> Column:
    """The smaller distance from the one's top to the other's bottom, whether they overlap or not."""
    return F.least(F.abs(a.y0 - b.y1), F.abs(b.y0 - a.y1))


def contains(outer: Box, inner: Box) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def margin_role(box: Box, page_height: Column) -> Column:
    """header in the top 12 % of a page, footer in the bottom 12 %, else null."""
    return F.when(box.y1 <= page_height * HEADER_SHARE, "header").when(box.y0 >= page_height * FOOTER_SHARE, "footer")


def is_axis_rectangle(points: Column, tolerance: float = 0.001) -> Column:
    """Whether four ``(x, y)`` structs in order are the corners of an upright rectangle."""
    p = [points[i] for i in range(4)]
    near = lambda a, b: F.abs(a - b) <= tolerance
    one = near(p[0]["y"], p[1]["y"]) & near(p[1]["x"], p[2]["x"]) & near(p[2]["y"], p[3]["y"]) & near(p[3]["x"], p[0]["x"])
    two = near(p[0]["x"], p[1]["x"]) & near(p[1]["y"], p[2]["y"]) & near(p[2]["x"], p[3]["x"]) & near(p[3]["y"], p[0]["y"])
    return (F.size(points) == 4) & (one | two)


def emu_to_points(v: Column) -> Column:
    return v * (POINTS_PER_INCH / EMU_PER_INCH)


def emu_to_inches(v: Column) -> Column:
    return v / EMU_PER_INCH


def twips_to_points(v: Column) -> Column:
    return v / TWIPS_PER_POINT


def native_width(kind: Column, value: Column) -> Column:
    """struct(unit, value): ``dxa`` in points, ``pct`` (fiftieths of a percent or ``n%``) as a ratio,
    ``auto`` and ``nil`` as themselves without a value; null for other kinds or unreadable values."""
    number = F.regexp_replace(value, "%$", "").try_cast("double")
    pct = F.when(F.endswith(value, F.lit("%")), number / 100).otherwise(number / 5000)
    made = lambda unit, v: F.struct(F.lit(unit).alias("unit"), v.cast("double").alias("value"))
    return (
        F.when((kind == "dxa") & number.isNotNull(), made("pt", number / TWIPS_PER_POINT))
        .when((kind == "pct") & number.isNotNull(), made("ratio", pct))
        .when(kind == "auto", made("auto", F.lit(None)))
        .when(kind == "nil", made("nil", F.lit(None)))
    )


def page_coverage(area: Column, page_area: Column) -> Column:
    """min(area / page, 1); 0 for an empty page."""
    return F.when(page_area > 0, F.least(area / page_area, F.lit(1.0))).otherwise(0.0)
