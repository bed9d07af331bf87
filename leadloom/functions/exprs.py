"""Small expression helpers used by every job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as blank at the ends of a key.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends (plain ``trim`` only knows the space)."""
    return F.btrim(as_col(c), F.lit(BLANKS))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``fn``.

    Catalyst inlines a projected column into the filter above it, and a filter does no common
    subexpression elimination; ``lower(content)`` used by 16 ``contains`` would be computed 16 times
    per row. Binding it as a lambda variable keeps it at one evaluation wherever the optimizer moves
    the expression.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def round_half_up(c: Column, places: int) -> Column:
    """Round the decimal value, so that binary noise (8.765 as 8.76499...) never decides a tie."""
    return F.round(c.cast("decimal(18,8)"), places).cast("double")


def falsy_to(c: Column | str, default) -> Column:
    """``value or default``: null and 0 both become the default."""
    c = as_col(c)
    return F.when(c.isNull() | (c == F.lit(0)), F.lit(default)).otherwise(c)


def blank_to(c: Column | str, default: Column) -> Column:
    """``value or default`` for strings: null and the empty string both become the default."""
    c = as_col(c)
    return F.when(c.isNull() | (c == F.lit("")), default).otherwise(c)


def whole_number_text(c: Column) -> Column:
    """A number as text without decimals; halves go to the even neighbour."""
    return F.bround(c, 0).cast("bigint").cast("string")
