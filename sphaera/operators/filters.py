"""A filter language for suitability, validated and compiled to one Column.

A spec holds hard (all must hold), soft (a weighted sum) and mult (factors) parts; the result is never negative.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import cos, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "between": lambda c, v: c.between(v[0], v[1]),
    "in": lambda c, v: c.isin(*v),
}
_unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
SOFT = {
    "linear": lambda c, p: _unit(c * p.get("scale", 1.0)),
    "min1": lambda c, p: F.least(F.lit(1.0), c / p.get("scale", 1.0)),
    "gauss": lambda c, p: F.exp(-F.pow((c - p["center"]) / p["width"], F.lit(2.0))),
    "inv": lambda c, p: 1 - F.least(F.lit(1.0), c / p.get("scale", 1.0)),
}
MULT = {
    "penalty": lambda c, p: 1 - F.least(F.lit(p.get("cap", 0.8)), c * p.get("scale", 1.0)),
    "bonus": lambda c, p: 1 + p.get("weight", 0.5) * F.least(F.lit(1.0), c / p.get("scale", 1.0)),
}


def validate(spec: Mapping, fields: Sequence[str]) -> list[str]:
    """All that is wrong with a spec, not just the first thing."""
    errors = []
    for part, table, word in (("hard", HARD, "op"), ("soft", SOFT, "fn"), ("mult", MULT, "fn")):
        for i, term in enumerate(spec.get(part, ())):
            at = f"{part}[{i}]"
            if term.get("field") not in fields:
                errors.append(f"{at}: unknown field {term.get('field')!r}")
            if term.get(word) not in table:
                errors.append(f"{at}: unknown {word} {term.get(word)!r}")
            elif part == "hard" and term[word] == "between" and len(term.get("value", ())) != 2:
                errors.append(f"{at}: between takes two values")
            elif part == "hard" and "value" not in term:
                errors.append(f"{at}: no value")
            elif term[word] == "gauss" and not {"center", "width"} <= set(term):
                errors.append(f"{at}: gauss takes center and width")
    return errors + [f"unknown part {k!r}" for k in spec if k not in ("hard", "soft", "mult", "include", "exclude")]


def hard(spec: Mapping) -> Column:
    return reduce(lambda a, b: a & b, (HARD[t["op"]](F.col(t["field"]), t["value"]) for t in spec.get("hard", ())), F.lit(True))


def suitability(spec: Mapping, masks: Column | None = None) -> Column:
    """hard * max(0, weighted soft) * product of mult * masks, at least 0; one expression, so one generated stage."""
    soft = reduce(lambda a, b: a + b, (t.get("weight", 1.0) * SOFT[t["fn"]](F.col(t["field"]), t) for t in spec.get("soft", ())), F.lit(0.0))
    mult = reduce(lambda a, b: a * b, (MULT[t["fn"]](F.col(t["field"]), t) for t in spec.get("mult", ())), F.lit(1.0))
    on = hard(spec) if masks is None else hard(spec) & masks
    return F.when(on, F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), soft) * mult)).otherwise(0.0)


def combine_masks(include: Sequence[Column], exclude: Sequence[Column]) -> Column:
    """Within any of include (or everywhere, if there is none) and in none of exclude."""
    inside = reduce(lambda a, b: a | b, include) if include else F.lit(True)
    return reduce(lambda a, b: a & ~b, exclude, inside)


def _unit_vector(lon: float, lat: float) -> tuple[float, float, float]:
    lo, la = radians(lon), radians(lat)
    return cos(la) * cos(lo), sin(la), cos(la) * sin(lo)


def in_polygon(points: DataFrame, vertices: Sequence[tuple[float, float]]) -> Column:
    """Whether a point (lon, lat) lies in a polygon of (lon, lat) vertices that is smaller than half of the sphere, by the angle
    that its outline turns around the point. The vertices are the query's own, hence literals."""
    lon, lat = F.col("lon"), F.col("lat")

    def bearing(vlon: float, vlat: float) -> Column:
        d = F.radians(F.lit(vlon) - lon)
        return F.atan2(F.sin(d) * F.cos(F.radians(F.lit(vlat))), F.cos(F.radians(lat)) * F.sin(F.radians(F.lit(vlat))) - F.sin(F.radians(lat)) * F.cos(F.radians(F.lit(vlat))) * F.cos(d))

    turn = F.lit(0.0)
    for a, b in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        step = bearing(*b) - bearing(*a)
        turn = turn + F.pmod(step + F.pi(), 2 * F.pi()) - F.pi()
    # Seen from within or from the antipodes the outline turns once; from the side of its middle it is within.
    mid = [sum(c) for c in zip(*(_unit_vector(*v) for v in vertices), strict=True)]
    la = F.radians(lat)
    near = mid[0] * F.cos(la) * F.cos(F.radians(lon)) + mid[1] * F.sin(la) + mid[2] * F.cos(la) * F.sin(F.radians(lon)) > 0
    return (F.abs(turn) > F.pi()) & near
