"""Set keys, vectors and boxes as Column expressions.  A box is a pair of integer arrays ``low`` and ``high`` of like length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---------------------------------------------------------------- set keys


def same_set(keys: Column, word: Column) -> Column:
    return F.array_sort(F.array_distinct(keys)) == F.array_sort(F.array_distinct(word))


def superset(keys: Column, word: Column) -> Column:
    """Every element of ``word`` is in ``keys``; the empty word matches all."""
    return F.size(F.array_except(word, keys)) == 0


def subset(keys: Column, word: Column) -> Column:
    """Every element of ``keys`` is in ``word``; empty keys always match."""
    return F.size(F.array_except(keys, word)) == 0


def union_many(sets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(sets)))


def intersect_many(sets: Column) -> Column:
    return F.array_sort(F.aggregate(F.slice(sets, 2, F.size(sets)), F.element_at(sets, 1), lambda a, x: F.array_intersect(a, x)))


# ---------------------------------------------------------------- vectors


def vector(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.zip_with(a, b, f)


add, sub = vector(lambda x, y: x + y), vector(lambda x, y: x - y)
least, greatest = vector(lambda x, y: F.least(x, y)), vector(lambda x, y: F.greatest(x, y))


def middle(a: Column, b: Column) -> Column:
    """Integer means, truncated."""
    return F.zip_with(a, b, lambda x, y: F.expr("cast(0 as bigint)") + ((x + y) / 2).cast("bigint"))


def every(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.forall(F.zip_with(a, b, test), lambda x: x)


def some(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.exists(F.zip_with(a, b, test), lambda x: x)


COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda x, y: x == y,
    "neq": lambda x, y: x != y,
    "gt": lambda x, y: x > y,
    "gte": lambda x, y: x >= y,
    "lt": lambda x, y: x < y,
    "lte": lambda x, y: x <= y,
}


# ---------------------------------------------------------------- boxes


@dataclass(frozen=True)
class Box:
    """An axis-parallel box, bounds included."""

    low: Column
    high: Column

    @classmethod
    def checked(cls, low: Column, high: Column) -> Box:
        """Fails at run time on an empty box, unlike lengths or a bound below the other."""
        ok = (F.size(low) > 0) & (F.size(low) == F.size(high)) & every(low, high, COMPARISONS["lte"])
        return cls(F.when(ok, low).otherwise(F.raise_error(F.lit("not a box")).cast("array<bigint>")), high)

    @classmethod
    def point(cls, at: Column) -> Box:
        return cls(at, at)

    @classmethod
    def from_origin(cls, to: Column) -> Box:
        """Between the origin and a point, whose coordinates may be negative."""
        return cls(F.transform(to, lambda x: F.least(x, F.lit(0))), F.transform(to, lambda x: F.greatest(x, F.lit(0))))

    def dimensions(self) -> Column:
        return F.size(self.low)

    def center(self) -> Column:
        return middle(self.low, self.high)

    def wrap(self, other: Box) -> Box:
        return Box(least(self.low, other.low), greatest(self.high, other.high))

    def intersection(self, other: Box) -> Box:
        """May be inverted where the boxes do not meet."""
        return Box(greatest(self.low, other.low), least(self.high, other.high))

    def intersects(self, other: Box) -> Column:
        """The usual index test: false only if one box lies wholly above the other in every dimension, or wholly below in every one."""
        return ~(every(self.low, other.high, COMPARISONS["gt"]) | every(self.high, other.low, COMPARISONS["lt"]))

    def meets(self, other: Box) -> Column:
        """Whether the boxes share a point."""
        return every(self.low, other.high, COMPARISONS["lte"]) & every(self.high, other.low, COMPARISONS["gte"])

    def inside(self, outer: Box) -> Column:
        return every(outer.low, self.low, COMPARISONS["lte"]) & every(outer.high, self.high, COMPARISONS["gte"])

    def area(self) -> Column:
        return F.aggregate(sub(self.high, self.low), F.lit(1).cast("bigint"), lambda a, x: a * x)


def wrap_all(low: str, high: str, dimensions: int) -> tuple[Column, Column]:
    """Aggregates: the bounds of all boxes of a group."""
    return F.array(*[F.min(F.get(low, F.lit(i))) for i in range(dimensions)]), F.array(*[F.max(F.get(high, F.lit(i))) for i in range(dimensions)])


def intersect_all(low: str, high: str, dimensions: int) -> tuple[Column, Column]:
    """Aggregates: what all boxes of a group share, perhaps inverted."""
    return F.array(*[F.max(F.get(low, F.lit(i))) for i in range(dimensions)]), F.array(*[F.min(F.get(high, F.lit(i))) for i in range(dimensions)])
