"""Box algebra on struct<x0, y0, x1, y1> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES)])


def valid(b: Column) -> Column:
    """The box, or null if a side is null or NaN, or the box has no area."""
    ok = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    for s in SIDES:
        ok = ok & b[s].isNotNull() & ~F.isnan(b[s])
    return F.when(ok, b)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def quad(b: Column) -> Column:
    """The corners from the top left, clockwise."""
    corner = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))


def convert(b: Column, width: Column, height: Column, to: str, clip: bool = False) -> Column:
    """From shares of the page to points, or back (``to``: 'point' or 'share')."""
    f = (lambda v, size: v * size) if to == "point" else (lambda v, size: v / size)
    out = [f(b["x0"], width), f(b["y0"], height), f(b["x1"], width), f(b["y1"], height)]
    if clip:
        most = [width, height, width, height] if to == "point" else [F.lit(1.0)] * 4
        out = [F.greatest(F.lit(0.0), F.least(v, m)) for v, m in zip(out, most)]
    return box(*out)


def quarter_turn(angle: Column) -> Column:
    """The nearest of 0, 90, 180 and 270."""
    return F.pmod(F.round(angle / 90), F.lit(4)).cast("int") * 90


def rotate(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """The box after its page (width, height) is turned clockwise by a quarter-turn angle."""
    a = quarter_turn(angle)
    return (
        F.when(a == 90, box(height - b["y1"], b["x0"], height - b["y0"], b["x1"]))
        .when(a == 180, box(width - b["x1"], height - b["y1"], width - b["x0"], height - b["y0"]))
        .when(a == 270, box(b["y0"], width - b["x1"], b["y1"], width - b["x0"]))
        .otherwise(b)
    )


def relative(a: Column, b: Column) -> Column:
    """Where ``b`` is, seen from ``a``."""
    return F.struct((b["x1"] < a["x0"]).alias("left"), (a["x1"] < b["x0"]).alias("right"), (b["y1"] < a["y0"]).alias("above"), (a["y1"] < b["y0"]).alias("below"))


def gap(a: Column, b: Column) -> Column:
    """The shortest distance between two boxes; 0 if they meet."""
    dx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    dy = F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def centre_distance(a: Column, b: Column) -> Column:
    dx, dy = centre(a)["x"] - centre(b)["x"], centre(a)["y"] - centre(b)["y"]
    return F.sqrt(dx * dx + dy * dy)


def overlap(a: Column, b: Column) -> Column:
    """The area that both boxes cover."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def overlap_of_first(a: Column, b: Column) -> Column:
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(0.0)


def union(b: Column) -> Column:
    """Aggregate: the box around a group's boxes."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def per_mille(b: Column) -> Column:
    """A share-of-page box as whole per-mille, halves to even; null if it isn't inside the page or has no area."""
    inside = F.lit(True)
    for s in SIDES:
        inside = inside & b[s].between(0, 1) & ~F.isnan(b[s])
    m = F.struct(*[F.bround(b[s] * 1000).cast("int").alias(s) for s in SIDES])
    return F.when(inside & (m["x1"] > m["x0"]) & (m["y1"] > m["y0"]), m)


def widths_compatible(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    wa, wb = a["x1"] - a["x0"], b["x1"] - b["x0"]
    return (F.least(wa, wb) > 0) & (F.abs(wa - wb) / F.least(wa, wb) < tolerance)


def affine(x: Column, y: Column, m: list[float]) -> Column:
    """A point under the matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))
