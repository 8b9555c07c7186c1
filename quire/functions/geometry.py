"""Numbers, boxes, page space and colours over columns; all are JVM expressions.

Coordinates are doubles in points from the top left.  Rounding multiplies, rounds half away from zero and divides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def round3(v: Column | str) -> Column:
    return F.round(_c(v) * F.lit(1000.0)) / F.lit(1000.0)


def round1(v: Column | str) -> Column:
    """One decimal; never negative zero."""
    return F.round(_c(v) * F.lit(10.0)) / F.lit(10.0) + F.lit(0.0)


def scaled(v: Column | str) -> Column:
    """Thousandths as a whole number: a sort and join key."""
    return F.round(_c(v) * F.lit(1000.0)).cast("bigint")


def lean_number(v: Column | str) -> Column:
    """At most one decimal, none if it is zero."""
    return F.regexp_replace(F.format_string("%.1f", round1(v)), r"\.0$", "")


def lean_box(*edges: Column | str) -> Column:
    return F.concat_ws(" ", *map(lean_number, edges or BOX))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(_c(x1) - _c(x0), F.lit(0.0)) * F.greatest(_c(y1) - _c(y0), F.lit(0.0))


def clipped_area(width: Column | str, height: Column | str, box: tuple = BOX) -> Column:
    """Area of a box within its page."""
    x0, y0, x1, y1 = map(_c, box)
    w, h = _c(width), _c(height)
    return area(clamp(x0, 0.0, w), clamp(y0, 0.0, h), clamp(x1, 0.0, w), clamp(y1, 0.0, h))


def overlap(a: tuple, b: tuple) -> Column:
    """Common area of two boxes."""
    return area(F.greatest(_c(a[0]), _c(b[0])), F.greatest(_c(a[1]), _c(b[1])), F.least(_c(a[2]), _c(b[2])), F.least(_c(a[3]), _c(b[3])))


def centre_distance(a: tuple, b: tuple) -> Column:
    dx = (_c(a[0]) + _c(a[2]) - _c(b[0]) - _c(b[2])) / 2.0
    dy = (_c(a[1]) + _c(a[3]) - _c(b[1]) - _c(b[3])) / 2.0
    return F.hypot(dx, dy)


def ordered_box(box: tuple = BOX) -> Column:
    """Whether all edges are finite and in order."""
    ok = F.lit(True)
    for e in map(_c, box):
        ok = ok & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return ok & (_c(box[2]) >= _c(box[0])) & (_c(box[3]) >= _c(box[1]))


def union_box(box: tuple = BOX) -> list[Column]:
    """Aggregates of the smallest box that holds all."""
    names = [b if isinstance(b, str) else n for b, n in zip(box, BOX, strict=True)]
    return [F.min(box[0]).alias(names[0]), F.min(box[1]).alias(names[1]), F.max(box[2]).alias(names[2]), F.max(box[3]).alias(names[3])]


def page_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """From bottom-left points of an unrotated page to top-left points of the page turned clockwise."""
    px = F.when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, height - y).otherwise(x)
    py = F.when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, width - x).otherwise(height - y)
    return px, py


def corners_box(points: list[tuple[Column, Column]]) -> list[Column]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1")]


def page_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column) -> list[Column]:
    """A box in page space."""
    return corners_box([page_point(x, y, width, height, rotation) for x, y in ((x0, y0), (x1, y1))])


def matrix_point(m: tuple[Column, ...], x: Column | float, y: Column | float) -> tuple[Column, Column]:
    """A point under the matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def unit_square_box(m: tuple[Column, ...]) -> list[Column]:
    return corners_box([matrix_point(m, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])


def vertical_scale(c: Column, d: Column) -> Column:
    return F.hypot(c, d)


def rotated_box(x: Column, y: Column, w: Column, h: Column, degrees: Column, flip_h: Column, flip_v: Column) -> list[Column]:
    """The box of a frame turned about its centre, flipped first."""
    cx, cy, t = x + w / 2.0, y + h / 2.0, F.radians(degrees)
    points = []
    for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h)):
        dx, dy = F.when(flip_h, cx - px).otherwise(px - cx), F.when(flip_v, cy - py).otherwise(py - cy)
        points.append((cx + dx * F.cos(t) - dy * F.sin(t), cy + dx * F.sin(t) + dy * F.cos(t)))
    return corners_box(points)


def emu(v: Column) -> Column:
    return v / F.lit(12700.0)


def twips(v: Column) -> Column:
    return v / F.lit(20.0)


def channel(v: Column) -> Column:
    return clamp(F.round(v), 0.0, 255.0)


def tint(c: Column, share: Column) -> Column:
    """Towards white, by 255ths; ``share`` is what stays."""
    return F.floor((c * share + F.lit(255) * (F.lit(255) - share)) / 255).cast("int")


def shade(c: Column, share: Column) -> Column:
    """Towards black, by 255ths."""
    return F.floor(c * share / 255).cast("int")


def modified(rgb: Column, steps: Column) -> Column:
    """Colour channels after an array of structs (kind tint/shade/lumMod/lumOff, v) in order; every step rounds and clamps."""
    def step(acc: Column, s: Column) -> Column:
        v = s["v"]
        one = lambda c: channel(F.when(s["kind"] == "tint", c * v + F.lit(255.0) * (F.lit(1.0) - v)).when(s["kind"].isin("shade", "lumMod"), c * v).when(s["kind"] == "lumOff", c + F.lit(255.0) * v).otherwise(c))
        return F.transform(acc, one)

    return F.transform(F.aggregate(steps, F.transform(rgb, lambda c: c.cast("double")), step), lambda c: c.cast("smallint"))


def lean_style(bold: Column, italic: Column, fill: Column) -> Column:
    """b, i, bi or -, then the colour unless it is black or unknown."""
    face = F.concat(F.when(bold, "b").otherwise(""), F.when(italic, "i").otherwise(""))
    code = F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.get(fill, F.lit(k)).cast("bigint")), 2, "0")) for k in range(3)))
    painted = fill.isNotNull() & ((F.get(fill, F.lit(0)) != 0) | (F.get(fill, F.lit(1)) != 0) | (F.get(fill, F.lit(2)) != 0))
    return F.concat(F.when(face == "", "-").otherwise(face), F.when(painted, code).otherwise(""))
