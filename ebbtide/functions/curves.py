"""Column expressions over short, already aggregated curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def running_product(x: Column, over: WindowSpec) -> Column:
    """Product of the non-negative `x` over a window; exactly 0 once a factor is 0."""
    zero = F.max(F.when(x <= 0, 1).otherwise(0)).over(over) == 1
    logs = F.sum(F.ln(F.when(x > 0, x))).over(over)
    return F.when(zero, F.lit(0.0)).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))


def up_to(by: list[str], order: str) -> WindowSpec:
    """Window from the first row of a curve to the current one."""
    return (Window.partitionBy(*by or [F.lit(0)]).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, 0))


def from_here(by: list[str], order: str) -> WindowSpec:
    """Window from the current row of a curve to its last one."""
    return (Window.partitionBy(*by or [F.lit(0)]).orderBy(order)
            .rowsBetween(0, Window.unboundedFollowing))


# --- whole curves held in one array per row (no shuffle) ----------------------------

_ALL = 1 << 20  # longer than any curve; start + length must stay within an int


def fold(a: Column, start: float, step) -> Column:
    """[start, step(start, a1), step(that, a2), ...]; the array is evaluated once."""
    return F.aggregate(a, F.array(F.lit(start)), lambda acc, x: F.concat(
        acc, F.array(step(F.element_at(acc, -1), x))))


def scan(a: Column, start: float, step) -> Column:
    """The fold after each element."""
    return F.slice(fold(a, start, step), 2, _ALL)


def scan_before(a: Column, start: float, step, size: Column) -> Column:
    """The fold before each element; `size` is the number of elements."""
    return F.slice(fold(a, start, step), F.lit(1), size)


def survival_from_hazard(hazard: Column) -> Column:
    """S(1..H) from h(1..H)."""
    return scan(hazard, 1.0, lambda s, h: s * (1.0 - h))


def lagged(curve: Column) -> Column:
    """The curve one step earlier, 1 before the first."""
    return F.slice(F.concat(F.array(F.lit(1.0)), curve), F.lit(1), F.size(curve))


def at_time(curve: Column, t: Column) -> Column:
    """Right-continuous step lookup, 1 before the first period, flat after the last."""
    k = F.least(F.floor(t), F.size(curve)).cast("int")
    return F.when(k < 1, F.lit(1.0)).otherwise(F.element_at(curve, F.greatest(k, F.lit(1))))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
