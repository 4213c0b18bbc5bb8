"""Planar geometry over vertex arrays, as Spark SQL expressions.

A vertex is ``struct<x,y>``, a ring an array of vertices, an edge ``struct<x1,y1,x2,y2>``. Functions take
and give SQL text, so that they nest and still reach Spark as one expression; wrap the result in
``F.expr``. Each array is walked once. Areas and crossings use products only, which ANSI arithmetic
accepts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTICES = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<exterior:{VERTICES},holes:array<{VERTICES}>>>"
NO_HOLES = f"cast(array() as array<{VERTICES}>)"


def vertex(x: Column, y: Column) -> Column:
    """A vertex from two columns."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def all_finite(v: str) -> str:
    def one(n: str) -> str:
        return f"({n} IS NOT NULL AND NOT isnan({n}) AND abs({n}) < double('Infinity'))"

    return f"forall({v}, fv -> {one('fv.x')} AND {one('fv.y')})"


def swap_xy(v: str) -> str:
    """Exchange the two coordinates (display ``(y, x)`` to geometry ``(x, y)`` and back)."""
    return f"transform({v}, sv -> named_struct('x', sv.y, 'y', sv.x))"


def all_close(a: str, b: str) -> str:
    """Two vertices equal within 1e-8 plus 1e-5 of the second."""
    return (
        f"(abs({a}.x - {b}.x) <= 1e-8D + 1e-5D * abs({b}.x) AND abs({a}.y - {b}.y) <= 1e-8D + 1e-5D * abs({b}.y))"
    )


def first_of(v: str) -> str:
    return f"get({v}, 0)"


def last_of(v: str) -> str:
    return f"get({v}, size({v}) - 1)"


def close_ring(v: str) -> str:
    """Append the first vertex unless the last one is already (nearly) it."""
    body = f"CASE WHEN size(cr) = 0 OR {all_close(first_of('cr'), last_of('cr'))} THEN cr ELSE concat(cr, slice(cr, 1, 1)) END"
    return let(v, "cr", body)


def drop_repeats(v: str) -> str:
    """Remove vertices identical to the one before them."""
    return let(v, "dr", "filter(dr, (dv, di) -> di = 0 OR dv <> get(dr, di - 1))")


def _pairs(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (pa, pb) -> named_struct('x1', pa.x, 'y1', pa.y, 'x2', pb.x, 'y2', pb.y))"


def edges_of_line(v: str) -> str:
    """Consecutive vertex pairs of a line."""
    return let(v, "el", _pairs("slice(el, 1, greatest(size(el) - 1, 0))", "slice(el, 2, greatest(size(el) - 1, 0))"))


def edges_of_ring(v: str) -> str:
    """Consecutive vertex pairs of a ring, closing edge included."""
    pairs = _pairs("er", "concat(slice(er, 2, greatest(size(er) - 1, 0)), slice(er, 1, 1))")
    return let(v, "er", f"filter({pairs}, ef -> ef.x1 <> ef.x2 OR ef.y1 <> ef.y2)")


def rings_of_part(part: str) -> str:
    return f"concat(array({part}.exterior), coalesce({part}.holes, {NO_HOLES}))"


def edges_of_parts(parts: str) -> str:
    """Every edge of a (multi)polygon, holes included."""
    rings = f"flatten(transform({parts}, ep -> {rings_of_part('ep')}))"
    return f"flatten(transform({rings}, eg -> {edges_of_ring('eg')}))"


def exterior_vertices(parts: str) -> str:
    return f"flatten(transform({parts}, xp -> xp.exterior))"


def bounds(v: str) -> dict[str, Column]:
    """Bounding box of a list of vertices, by name."""
    return {
        f"{axis}{end}": F.expr(f"array_{end}(transform({v}, bv -> bv.{axis}))") for axis in ("x", "y") for end in ("min", "max")
    }


def _ring_sums(v: str, ox: str, oy: str) -> str:
    """Signed double area and first moments of a ring about an origin."""
    step = (
        f"named_struct('c', (re.x1 - {ox}) * (re.y2 - {oy}) - (re.x2 - {ox}) * (re.y1 - {oy}), "
        f"'sx', re.x1 + re.x2 - 2 * {ox}, 'sy', re.y1 + re.y2 - 2 * {oy})"
    )
    return (
        f"aggregate(transform({edges_of_ring(v)}, re -> {step}), named_struct('a', 0D, 'mx', 0D, 'my', 0D), "
        "(rs, rt) -> named_struct('a', rs.a + rt.c, 'mx', rs.mx + rt.sx * rt.c, 'my', rs.my + rt.sy * rt.c))"
    )


def ring_area(v: str) -> str:
    return let(v, "ra", f"abs({_ring_sums('ra', 'ra[0].x', 'ra[0].y')}.a) / 2")


def polygon_measures(parts: str) -> str:
    """``struct<area,cx,cy>`` of a (multi)polygon with holes subtracted."""
    signed = (
        f"flatten(transform({parts}, mp -> concat(array(named_struct('r', mp.exterior, 's', 1D)), "
        f"transform(coalesce(mp.holes, {NO_HOLES}), mh -> named_struct('r', mh, 's', -1D)))))"
    )
    sums = f"transform({signed}, mq -> named_struct('s', mq.s, 't', {_ring_sums('mq.r', 'mo.x', 'mo.y')}))"
    turned = f"transform({sums}, mu -> named_struct('k', CASE WHEN mu.t.a < 0 THEN -mu.s ELSE mu.s END, 't', mu.t))"
    total = (
        f"aggregate({turned}, named_struct('a', 0D, 'mx', 0D, 'my', 0D), (ms, mt) -> named_struct("
        "'a', ms.a + mt.k * mt.t.a, 'mx', ms.mx + mt.k * mt.t.mx, 'my', ms.my + mt.k * mt.t.my))"
    )
    result = (
        "named_struct('area', mw.a / 2, 'cx', mo.x + try_divide(mw.mx, mw.a * 3), 'cy', mo.y + try_divide(mw.my, mw.a * 3))"
    )
    return let(f"{parts}[0].exterior[0]", "mo", let(total, "mw", result))


def _cross(e: str, px: str, py: str) -> str:
    return f"(({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({px} - {e}.x1) * ({e}.y2 - {e}.y1))"


def _place(edges: str, px: str, py: str) -> str:
    """0 outside, 1 inside, 2 on the boundary: even-odd rule with the boundary told apart.

    Edges above, below or left of the point cannot matter and are passed over with comparisons only;
    of a real outline that is all but a few.
    """
    cross = _cross("pe", px, py)
    passed = f"(pe.y1 < {py} AND pe.y2 < {py}) OR (pe.y1 > {py} AND pe.y2 > {py}) OR (pe.x1 < {px} AND pe.x2 < {px})"
    on = f"{cross} = 0 AND {px} >= least(pe.x1, pe.x2) AND {px} <= greatest(pe.x1, pe.x2)"
    hit = f"(pe.y1 > {py}) <> (pe.y2 > {py}) AND ({cross} > 0) = (pe.y2 > pe.y1)"
    return (
        f"aggregate({edges}, 0, (ps, pe) -> CASE WHEN ps = 2 OR {passed} THEN ps WHEN {on} THEN 2 WHEN {hit} THEN 1 - ps ELSE ps END)"
    )


def contains_strictly(edges: str, px: str, py: str) -> str:
    """Interior only: a point on the boundary is outside."""
    return f"({_place(edges, px, py)} = 1)"


def covers(edges: str, px: str, py: str) -> str:
    """Interior or boundary."""
    return f"({_place(edges, px, py)} > 0)"


def inner_point(edges: str) -> str:
    """``struct<x,y>`` strictly inside a simple polygon: the middle of a scan line's first span, between its two lowest heights."""
    heights = f"array_sort(array_distinct(flatten(transform({edges}, ih -> array(ih.y1, ih.y2)))))"
    spans = (
        f"array_sort(transform(filter({edges}, ie -> (ie.y1 > iy) <> (ie.y2 > iy)), "
        "ie -> ie.x1 + (ie.x2 - ie.x1) * (iy - ie.y1) / (ie.y2 - ie.y1)))"
    )
    point = let(spans, "ix", "named_struct('x', (get(ix, 0) + get(ix, 1)) / 2, 'y', iy)")
    return let(let(heights, "hs", "(get(hs, 0) + get(hs, 1)) / 2"), "iy", point)


def polygon_meets_box(edges: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Whether a polygon and a closed box share a point: an edge meets the box, or the box is inside."""
    corners = ", ".join(_cross("be", x, y) for x in (x0, x1) for y in (y0, y1))
    meets = (
        f"least(be.x1, be.x2) <= {x1} AND greatest(be.x1, be.x2) >= {x0} AND least(be.y1, be.y2) <= {y1} "
        f"AND greatest(be.y1, be.y2) >= {y0} AND least({corners}) <= 0 AND greatest({corners}) >= 0"
    )
    return f"(exists({edges}, be -> {meets}) OR {covers(edges, x0, y0)})"


def _turn(e: str, x: str, y: str) -> str:
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"


def _turns(a: str, b: str) -> list[str]:
    return [_turn(b, f"{a}.x1", f"{a}.y1"), _turn(b, f"{a}.x2", f"{a}.y2"), _turn(a, f"{b}.x1", f"{b}.y1"), _turn(a, f"{b}.x2", f"{b}.y2")]


def segments_touch(a: str, b: str) -> str:
    """Whether two closed segments share a point (crossing, touching or overlapping)."""
    d1, d2, d3, d4 = _turns(a, b)
    near = " AND ".join(
        f"greatest({p}.{k}1, {p}.{k}2) >= least({q}.{k}1, {q}.{k}2)" for k in "xy" for p, q in ((a, b), (b, a))
    )
    return (
        f"({near} AND least({d1}, {d2}) <= 0 AND greatest({d1}, {d2}) >= 0 AND least({d3}, {d4}) <= 0 AND greatest({d3}, {d4}) >= 0)"
    )


def segments_cross(a: str, b: str) -> str:
    """Whether two segments pass through each other in their interiors."""
    d1, d2, d3, d4 = _turns(a, b)
    return f"(least({d1}, {d2}) < 0 AND greatest({d1}, {d2}) > 0 AND least({d3}, {d4}) < 0 AND greatest({d3}, {d4}) > 0)"


def folds_back(a: str, b: str) -> str:
    """Whether edge ``b``, which follows ``a``, runs back along it."""
    ax, ay, bx, by = f"({a}.x2 - {a}.x1)", f"({a}.y2 - {a}.y1)", f"({b}.x2 - {b}.x1)", f"({b}.y2 - {b}.y1)"
    return f"({ax} * {by} - {ay} * {bx} = 0 AND {ax} * {bx} + {ay} * {by} < 0)"


def line_length(v: str) -> str:
    return f"aggregate({edges_of_line(v)}, 0D, (ls, le) -> ls + hypot(le.x2 - le.x1, le.y2 - le.y1))"


def nearest_on_line(v: str, px: str, py: str) -> str:
    """``struct<d2,i,x,y>``: the closest point of a line, the first one where several tie."""
    along = (
        f"try_divide(({px} - ne.x1) * (ne.x2 - ne.x1) + ({py} - ne.y1) * (ne.y2 - ne.y1), "
        "(ne.x2 - ne.x1) * (ne.x2 - ne.x1) + (ne.y2 - ne.y1) * (ne.y2 - ne.y1))"
    )
    clamped = f"least(greatest(coalesce({along}, 0D), 0D), 1D)"
    point = let(clamped, "nt", "named_struct('x', ne.x1 + nt * (ne.x2 - ne.x1), 'y', ne.y1 + nt * (ne.y2 - ne.y1))")
    scored = let(
        point, "np", f"named_struct('d2', (np.x - {px}) * (np.x - {px}) + (np.y - {py}) * (np.y - {py}), 'i', ni, 'x', np.x, 'y', np.y)"
    )
    return f"array_min(transform({edges_of_line(v)}, (ne, ni) -> {scored}))"
