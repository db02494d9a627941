"""Row-local geometry of closed rings, as Column expressions over array<struct<x: double, y: double>>.

Sums run in ring order inside one expression, so a cell never leaves its row and whole-stage code applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = "1e-18D"


def total(terms: str) -> str:
    """SQL for the sum of an array of doubles in order."""
    return f"aggregate({terms}, 0D, (s, v) -> s + v)"


def shifted(ring: str) -> str:
    """SQL for the ring that starts one vertex later."""
    return f"concat(slice({ring}, 2, greatest(size({ring}) - 1, 0)), slice({ring}, 1, 1))"


def edges(ring: str, term: str) -> str:
    """SQL for the sum of a term over the edges a to b of the closed ring."""
    return total(f"zip_with({ring}, {shifted(ring)}, (a, b) -> {term})")


def signed_area(ring: str = "ring") -> Column:
    """Shoelace area with the sign of the direction; 0 below three vertices."""
    return F.expr(f"CASE WHEN size({ring}) < 3 THEN 0D ELSE 0.5D * {edges(ring, 'a.x * b.y - b.x * a.y')} END")


def area(ring: str = "ring") -> Column:
    """Unsigned shoelace area."""
    return F.abs(signed_area(ring))


def area_f32(ring: str = "ring") -> Column:
    """The area rounded to single precision, as the area gate compares it."""
    return area(ring).cast("float")


def perimeter(ring: str = "ring") -> Column:
    """Length of the closed ring; 0 below two vertices."""
    return F.expr(f"CASE WHEN size({ring}) < 2 THEN 0D ELSE {edges(ring, 'sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))')} END")


def circularity(a: Column, p: Column, clamp: bool = True) -> Column:
    """4 pi A / P^2, at most 1 with ``clamp``; 0 for a tiny perimeter or a value that is not finite."""
    value = F.lit(4.0) * F.pi() * a / F.nullif(p * p, F.lit(0.0))
    value = F.least(F.lit(1.0), value) if clamp else value
    return F.when((p <= 1e-18) | (a < 0) | F.isnan(a) | F.isnan(p), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def vertex_mean(ring: str = "ring") -> tuple[Column, Column]:
    """Mean of the vertices; null for an empty ring."""
    return tuple(F.expr(f"CASE WHEN size({ring}) > 0 THEN {total(f'transform({ring}, p -> p.{c})')} / size({ring}) END") for c in "xy")


def centroid(ring: str = "ring") -> tuple[Column, Column]:
    """Area-weighted centroid; the vertex mean where the area is tiny."""
    out = []
    for c, mean in zip("xy", vertex_mean(ring), strict=True):
        moment = F.expr(edges(ring, f"(a.{c} + b.{c}) * (a.x * b.y - b.x * a.y)"))
        own = signed_area(ring)
        out.append(F.when((F.abs(own) < 1e-18) | F.expr(f"size({ring}) < 3"), mean).otherwise(moment / (F.lit(6.0) * F.nullif(own, F.lit(0.0)))))
    return tuple(out)


def covariance(ring: str = "ring") -> tuple[Column, Column, Column]:
    """Population covariance xx, yy, xy of the vertices."""
    n = f"size({ring})"
    mean = {c: f"({total(f'transform({ring}, q -> q.{c})')} / {n})" for c in "xy"}
    out = []
    for c, d in (("x", "x"), ("y", "y"), ("x", "y")):
        centred = f"aggregate({ring}, named_struct('s', 0D, 'mc', {mean[c]}, 'md', {mean[d]}), (t, p) -> named_struct('s', t.s + (p.{c} - t.mc) * (p.{d} - t.md), 'mc', t.mc, 'md', t.md), t -> t.s)"
        out.append(F.expr(f"CASE WHEN {n} > 0 THEN {centred} / {n} END"))
    return tuple(out)


def eigenvalues(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of a 2x2 covariance; zeros where there is none."""
    trace, det = xx + yy, xx * yy - xy * xy
    root = F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))
    bad = trace.isNull() | F.isnan(trace) | (trace * trace / 4 - det < 0)
    return F.when(bad, 0.0).otherwise(trace / 2 + root), F.when(bad, 0.0).otherwise(F.greatest(trace / 2 - root, F.lit(0.0)))


def eccentricity(l1: Column, l2: Column) -> Column:
    """sqrt(1 - l2 / l1), 0 for a tiny l1."""
    return F.when(l1 <= 1e-18, 0.0).otherwise(F.sqrt(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), l2 / F.nullif(l1, F.lit(0.0))))))


def eccentricity_linear(l1: Column, l2: Column) -> Column:
    """1 - sqrt(l2 / l1), the definition of the feature table."""
    return F.when(l1 <= 1e-18, 0.0).otherwise(1 - F.sqrt(F.greatest(F.lit(0.0), l2) / F.nullif(l1, F.lit(0.0))))


def aspect_ratio(l1: Column, l2: Column) -> Column:
    """l1 / l2, at least 1; 1 for a tiny l2."""
    return F.when(l2 <= 1e-18, 1.0).otherwise(F.greatest(F.lit(1.0), l1 / F.nullif(l2, F.lit(0.0))))


def hu_moments(ring: str = "ring") -> Column:
    """Seven Hu invariants of the vertex cloud, each v as -log10 |v| (0 stays 0)."""
    n = f"size({ring})"
    mean = {c: f"({total(f'transform({ring}, q -> q.{c})')} / {n})" for c in "xy"}
    orders = [(2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2)]
    power = lambda c, k: " * ".join([f"(p.{c} - t.m{c})"] * k)
    fields = ", ".join(f"'m{p}{q}', t.m{p}{q} + " + " * ".join(x for x in (power("x", p), power("y", q)) if x) for p, q in orders)
    start = ", ".join(f"'m{p}{q}', 0D" for p, q in orders)
    norm = ", ".join(f"'n{p}{q}', t.m{p}{q} / pow({n}, 1D + ({p} + {q}) / 2D)" for p, q in orders)
    m = f"aggregate({ring}, named_struct('mx', {mean['x']}, 'my', {mean['y']}, {start}), (t, p) -> named_struct('mx', t.mx, 'my', t.my, {fields}), t -> named_struct({norm}))"
    a, b = "(h.n30 + h.n12)", "(h.n21 + h.n03)"
    c, d = "(h.n30 - 3 * h.n12)", "(3 * h.n21 - h.n03)"
    hu = [
        "h.n20 + h.n02",
        "(h.n20 - h.n02) * (h.n20 - h.n02) + 4 * h.n11 * h.n11",
        f"{c} * {c} + {d} * {d}",
        f"{a} * {a} + {b} * {b}",
        f"{c} * {a} * ({a} * {a} - 3 * {b} * {b}) + {d} * {b} * (3 * {a} * {a} - {b} * {b})",
        f"(h.n20 - h.n02) * ({a} * {a} - {b} * {b}) + 4 * h.n11 * {a} * {b}",
        f"{d} * {a} * ({a} * {a} - 3 * {b} * {b}) - {c} * {b} * (3 * {a} * {a} - {b} * {b})",
    ]
    return F.expr(f"CASE WHEN {n} = 0 THEN array_repeat(0D, 7) ELSE transform(flatten(transform(array({m}), h -> array({', '.join(hu)}))), v -> CASE WHEN v = 0 THEN 0D ELSE -log10(abs(v)) END) END")


def bbox(ring: str = "ring") -> Column:
    """struct(x0, y0, x1, y1)."""
    part = lambda f, c: F.expr(f"array_{f}(transform({ring}, p -> p.{c}))")
    return F.struct(part("min", "x").alias("x0"), part("min", "y").alias("y0"), part("max", "x").alias("x1"), part("max", "y").alias("y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes; 0 for a tiny union."""
    w = f"greatest(0D, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"greatest(0D, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    size = lambda s: f"(greatest(0D, {s}.x1 - {s}.x0) * greatest(0D, {s}.y1 - {s}.y0))"
    union = f"({size(a)} + {size(b)} - {w} * {h})"
    return F.expr(f"CASE WHEN {union} <= 1e-12D THEN 0D ELSE {w} * {h} / {union} END")


def box_from_center(x: Column, y: Column, half: float, width: float, height: float) -> Column:
    """A square box clamped to an image."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return F.struct(clamp(x - half, width).alias("x0"), clamp(y - half, height).alias("y0"), clamp(x + half, width).alias("x1"), clamp(y + half, height).alias("y1"))


def shift(ring: str, dx: str, dy: str) -> Column:
    """The ring moved by (dx, dy)."""
    return F.expr(f"transform({ring}, p -> struct(p.x + {dx} AS x, p.y + {dy} AS y))")


def counter_clockwise(ring: str = "ring") -> Column:
    """The ring, reversed where its signed area is negative."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(F.col(ring))


def every_second(ring: str = "ring") -> Column:
    """Vertices 0, 2, 4 and so on."""
    return F.expr(f"filter({ring}, (p, i) -> i % 2 = 0)")


def circle(x: str, y: str, r: str, n: int = 128) -> Column:
    """A regular n-gon."""
    return F.expr(f"transform(sequence(0, {n - 1}), i -> struct({x} + {r} * cos(2 * pi() * i / {n}) AS x, {y} + {r} * sin(2 * pi() * i / {n}) AS y))")


def radius(attributes: str = "attributes") -> Column:
    """Radius from a map of lower-cased names to doubles: radius or r, half of diameter or size, sqrt(area / pi), else 4."""
    get = lambda *names: "coalesce(" + ", ".join(f"CASE WHEN {attributes}['{n}'] > 0 THEN {attributes}['{n}'] END" for n in names) + ")"
    return F.expr(f"coalesce({get('radius', 'r')}, {get('diameter', 'size')} * 0.5D, sqrt({get('area')} / pi()), 4D)")


def finite(ring: str = "ring") -> Column:
    """Whether all coordinates are finite."""
    ok = lambda c: f"p.{c} IS NOT NULL AND NOT isnan(p.{c}) AND abs(p.{c}) < double('Infinity')"
    return F.expr(f"forall({ring}, p -> {ok('x')} AND {ok('y')})")


def digest(ring: str = "ring", digits: int = 6, close: str = "") -> Column:
    """sha256 over the formatted coordinates in order."""
    return F.expr(f"sha2(concat(array_join(transform({ring}, p -> format_string('%.{digits}f,%.{digits}f;', p.x, p.y)), ''), '{close}'), 256)")


def distance_to_polygon(x: str, y: str, hull: str = "hull") -> Column:
    """Distance of a point to the edges of a hull: infinite without points, to the point or segment with one or two."""
    vx, vy, wx, wy = "(b.x - a.x)", "(b.y - a.y)", f"({x} - a.x)", f"({y} - a.y)"
    len2 = f"({vx} * {vx} + {vy} * {vy})"
    t = f"greatest(0D, least(1D, CASE WHEN {len2} <= 1e-36D THEN 0D ELSE ({wx} * {vx} + {wy} * {vy}) / {len2} END))"
    d2 = f"({x} - a.x - {t} * {vx}) * ({x} - a.x - {t} * {vx}) + ({y} - a.y - {t} * {vy}) * ({y} - a.y - {t} * {vy})"
    return F.expr(f"CASE WHEN {hull} IS NULL OR size({hull}) = 0 THEN double('Infinity') ELSE sqrt(array_min(zip_with({hull}, {shifted(hull)}, (a, b) -> {d2}))) END")


def turning(ring: str = "ring") -> Column:
    """Mean absolute turning angle over the vertices."""
    n = f"size({ring})"
    at = lambda k: f"element_at({ring}, int((i + {k}) % {n}) + 1)"
    u, v = f"({at(1)}.x - {at(0)}.x)", f"({at(1)}.y - {at(0)}.y)"
    w, z = f"({at(2)}.x - {at(1)}.x)", f"({at(2)}.y - {at(1)}.y)"
    long = f"(sqrt({u} * {u} + {v} * {v}) * sqrt({w} * {w} + {z} * {z}))"
    angle = f"CASE WHEN {long} <= 1e-18D THEN 0D ELSE acos(greatest(-1D, least(1D, ({u} * {w} + {v} * {z}) / {long}))) END"
    return F.expr(f"CASE WHEN {n} < 3 THEN 0D ELSE {total(f'transform(sequence(0, {n} - 1), i -> {angle})')} / {n} END")
