"""Pixel-to-micron transforms as column arithmetic.

A transform is six numbers ``a b c d e f``: ``x = a*px + b*py + c`` and ``y = d*px + e*py + f``. With a
grid origin and step per axis the pixel position of index ``i`` is ``origin + step*i``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a", "b", "c", "d", "e", "f")


def columns(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in NAMES}


def literal(a=1.0, b=0.0, c=0.0, d=0.0, e=1.0, f=0.0) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in dict(a=a, b=b, c=c, d=d, e=e, f=f).items()}


def with_grid(t: dict[str, Column], x_origin=0.0, x_step=1.0, y_origin=0.0, y_step=1.0) -> dict[str, Column]:
    """Fold grid origin and step into a transform, so that it maps (col, row) indices."""
    x0, xs, y0, ys = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x_origin, x_step, y_origin, y_step))
    return {
        "a": t["a"] * xs,
        "b": t["b"] * ys,
        "c": t["a"] * x0 + t["b"] * y0 + t["c"],
        "d": t["d"] * xs,
        "e": t["e"] * ys,
        "f": t["d"] * x0 + t["e"] * y0 + t["f"],
    }


def apply(t: dict[str, Column], px: Column, py: Column) -> tuple[Column, Column]:
    """Pixel (col, row) to micron (x, y)."""
    return t["a"] * px + t["b"] * py + t["c"], t["d"] * px + t["e"] * py + t["f"]


def invert(t: dict[str, Column]) -> dict[str, Column]:
    """Closed-form inverse. A singular or non-finite transform is an error when its row is used."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    usable = (det != 0) & (F.abs(det) < float("inf"))
    for name in ("c", "f"):
        usable = usable & (F.abs(t[name]) < float("inf"))
    det = F.when(F.coalesce(usable, F.lit(False)), det).otherwise(F.raise_error(F.lit("a transform cannot be inverted")).cast("double"))
    a, b = F.try_divide(t["e"], det), F.try_divide(-t["b"], det)
    d, e = F.try_divide(-t["d"], det), F.try_divide(t["a"], det)
    return {
        "a": a,
        "b": b,
        "c": -(a * t["c"] + b * t["f"]),
        "d": d,
        "e": e,
        "f": -(d * t["c"] + e * t["f"]),
    }


def window_bounds(t: dict[str, Column], row0: Column, row1: Column, col0: Column, col1: Column) -> dict[str, Column]:
    """Micron bounding box of a pixel window, from its four corners."""
    corners = [apply(t, c, r) for r in (row0, row1) for c in (col0, col1)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return {"xmin": F.least(*xs), "ymin": F.least(*ys), "xmax": F.greatest(*xs), "ymax": F.greatest(*ys)}
