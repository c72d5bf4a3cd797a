"""Differences, similarities and small geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.02
INF = float("inf")


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / max(|b|, 1e-9), infinite if either is null. Not symmetric."""
    return F.coalesce(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)), F.lit(INF))


def nine_places(c: Column) -> Column:
    """Not negative, rounded half up to nine places in doubles, as SQL engines do it: round() goes by way of a decimal for each value."""
    return F.floor(c * 1e9 + 0.5) / 1e9


def percent_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) * 100


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def link_confidence(combined: Column, name: Column) -> Column:
    return F.greatest(F.lit(0.60), F.least(F.lit(0.97), combined * 0.68 + name * 0.24 + 0.08))


def metadata_alignment(a: str, b: str) -> Column:
    """a, b: prefixes of amount, quantity, unit_price and unit. Sum of closeness over the sum of weights; 0 without any.

    Weights (1.6, 1, 1 and 0.8) are summed as tenths: 1.6 + 1.0 + 0.8 in doubles isn't 3.4, and its last bit would part equal scores.
    """
    score, weight = F.lit(0.0), F.lit(0)
    for field, w in (("amount", 16), ("quantity", 10), ("unit_price", 10)):
        x, y = F.col(a + field), F.col(b + field)
        here = x.isNotNull() & y.isNotNull()
        close = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), relative_difference(x, y)))
        score, weight = score + F.when(here, close).otherwise(0.0), weight + F.when(here, w).otherwise(0)
    x, y = (F.lower(F.trim(F.coalesce(F.col(p + "unit"), F.lit("")))) for p in (a, b))
    here = (x != "") & (y != "")
    score, weight = score + F.when(here & (x == y), 1.0).otherwise(0.0), weight + F.when(here, 8).otherwise(0)
    return F.when(weight > 0, score / (weight / 10.0)).otherwise(0.0)


def mismatches(a: str, b: str, tol: float = TOLERANCE) -> Column:
    """Names of the fields, present on both sides, that differ by more than tol."""
    fields = ("amount", "quantity", "unit_price")
    found = F.array(*(F.when(F.col(a + f).isNotNull() & F.col(b + f).isNotNull() & (relative_difference(F.col(a + f), F.col(b + f)) > tol), F.lit(f)) for f in fields))
    return F.filter(found, lambda x: x.isNotNull())


def within_tolerance(a: str, b: str, tol: float = TOLERANCE) -> Column:
    """Whether the numbers agree: all fields that both have; else one side's amount with the other's quantity x price."""
    comparable = F.lit(False)
    for f in ("amount", "quantity", "unit_price"):
        comparable = comparable | (F.col(a + f).isNotNull() & F.col(b + f).isNotNull())
    computed = lambda p: F.col(p + "quantity") * F.col(p + "unit_price")
    against_b = F.col(a + "amount").isNotNull() & F.coalesce(computed(b) != 0, F.lit(False))
    against_a = F.col(b + "amount").isNotNull() & F.coalesce(computed(a) != 0, F.lit(False))
    fallback = (
        F.when(against_b, relative_difference(F.col(a + "amount"), computed(b)) <= tol)
        .when(against_a, relative_difference(F.col(b + "amount"), computed(a)) <= tol)
        .otherwise(False)
    )
    return F.when(comparable, F.size(mismatches(a, b, tol)) == 0).otherwise(fallback)


def dual_confidence(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), (a + b) / 2 + 0.08)


def coverage_percent(covered: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.round(covered * 100.0 / expected, 1))


def overlap_ratio(a: str, b: str) -> Column:
    """Shared area over the smaller one, of rectangles in columns <prefix>x0, y0, x1, y1."""
    w = F.least(F.col(a + "x1"), F.col(b + "x1")) - F.greatest(F.col(a + "x0"), F.col(b + "x0"))
    h = F.least(F.col(a + "y1"), F.col(b + "y1")) - F.greatest(F.col(a + "y0"), F.col(b + "y0"))
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    return F.when((w > 0) & (h > 0), w * h / F.greatest(F.lit(1e-9), F.least(area(a), area(b)))).otherwise(0.0)


def rectangle_used(a: str, b: str) -> Column:
    middle = lambda p: (F.col(p + "y0") + F.col(p + "y1")) / 2
    return (overlap_ratio(a, b) >= 0.85) | ((F.abs(middle(a) - middle(b)) <= 2.8) & (F.abs(F.col(a + "x0") - F.col(b + "x0")) <= 180))


def hit_rectangle(x0: Column, x1: Column, top: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A padded text hit with y from the bottom up; null if nothing is left of it."""
    low, high = height - F.least(bottom + 0.8, height), height - F.greatest(top - 0.8, F.lit(0.0))
    box = F.struct(F.greatest(x0 - 1.5, F.lit(0.0)).alias("x0"), low.alias("y0"), F.least(x1 + 1.5, width).alias("x1"), high.alias("y1"))
    return F.when(high > low, box)


def quad_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(x0, y1, x1, y1, x0, y0, x1, y0)


def note_place(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, size: float = 14.0, gap: float = 3.0) -> Column:
    """A note beside a rectangle: to its right, else to its left, on the page."""
    low = F.greatest(F.lit(2.0), F.least((y0 + y1) / 2 - size / 2, height - size - 2))
    right = x1 + gap
    left_end = F.greatest(F.lit(2.0 + size), x0 - gap)
    at = F.greatest(F.lit(2.0), F.when(right + size > width - 2, left_end - size).otherwise(right))
    return F.struct(at.alias("x0"), low.alias("y0"), (at + size).alias("x1"), (low + size).alias("y1"))


def margin_note(width: Column, height: Column, index: Column, size: float = 14.0) -> Column:
    """The index-th note down the right margin."""
    x0 = F.greatest(F.lit(2.0), width - 20)
    y1 = F.greatest(F.lit(16.0), height - 24 - index * (size + 2))
    return F.struct(x0.alias("x0"), F.greatest(F.lit(2.0), y1 - size).alias("y0"), F.least(width - 2, x0 + size).alias("x1"), y1.alias("y1"))
