"""Rates, thresholds and states as columns. A rate without anything measured is NULL, never 0 or 1."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of threshold tests, in percent points; movement below MOVEMENT counts as none.
RATE_EPSILON = 1e-9
MOVEMENT = 1e-4
T = TypeVar("T")


def rate(hit: Column, total: Column) -> Column:
    return F.try_divide(hit.cast("double"), total.cast("double"))


def meets(value: Column, percent: Column | float) -> Column:
    """Is the rate at or above the percentage."""
    return value * 100 >= _col(percent) - RATE_EPSILON


def below(value: Column, percent: Column | float) -> Column:
    """Measured, and under the percentage."""
    return value.isNotNull() & ~meets(value, percent)


def exceeds(score: Column, most: Column | float) -> Column:
    return score > _col(most) + RATE_EPSILON


def percent(value: Column) -> Column:
    """Percent with two digits, halves to even on the binary value."""
    return F.rint(value * 100 * 100) / 100


def floored(value: Column) -> Column:
    """Percent floored to one digit: what a rate that misses its threshold is shown as."""
    return F.floor(value * 100 * 10 + RATE_EPSILON) / 10


def crap(complexity: Column, coverage: Column) -> Column:
    comp, miss = complexity.cast("double"), F.lit(1.0) - coverage
    return comp * comp * miss * miss * miss + comp


def line_status(hits: Column, covered: Column, total: Column) -> Column:
    """Miss, Partial or Hit; an untracked line (NULL hits) is a miss."""
    return F.when(F.coalesce(hits, F.lit(0)) == 0, "Miss").when(covered < total, "Partial").otherwise("Hit")


def file_change(before: Column, after: Column, in_before: Column, in_after: Column) -> Column:
    moved = F.abs(after - before)
    return F.when(~in_before, "Added").when(~in_after, "Removed").when(moved.isNull() | (moved < MOVEMENT), "Unchanged").otherwise("Modified")


def line_change(before: Column, after: Column) -> Column:
    """What became of a line; NULL if its state is the same on both sides."""
    return (
        F.when(before.isNull(), "Added")
        .when(after.isNull(), "Removed")
        .when((before == 0) & (after != 0), "NewlyHit")
        .when((before != 0) & (after == 0), "NewlyMissed")
    )


def match_change(change: Column, *, added: Column, removed: Column, newly_hit: Column, newly_missed: Column) -> Column:
    """One value for each kind of line change; all four must be given."""
    return F.when(change == "Added", added).when(change == "Removed", removed).when(change == "NewlyHit", newly_hit).when(change == "NewlyMissed", newly_missed)


def switch_change(change: str, *, added: Callable[[], T], removed: Callable[[], T], newly_hit: Callable[[], T], newly_missed: Callable[[], T]) -> T:
    """Calls what belongs to one collected line change; all four must be given."""
    return {"Added": added, "Removed": removed, "NewlyHit": newly_hit, "NewlyMissed": newly_missed}[change]()


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
