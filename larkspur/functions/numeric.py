"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: machine epsilon of float64, the MAPE denominator floor.
FLOAT64_EPS = 2.220446049250313e-16


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of raising on a zero divisor."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def flag(cond: Column) -> Column:
    """int(cond) with NULL -> 0 (pandas ``(x > 0).astype(int)``)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def null_sum(cols) -> Column:
    """Row sum that skips NULLs; all-NULL gives 0 (pandas ``sum(axis=1)``)."""
    return reduce(add, [F.coalesce(col_(c).cast("double"), F.lit(0.0)) for c in cols])


def clip(c, lo=None, hi=None) -> Column:
    out = col_(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def round_half_even(c, places: int = 2) -> Column:
    """numpy-style rounding (half to even)."""
    return F.bround(col_(c), places)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def currency(c, places: int = 2) -> Column:
    """``$1,234.56`` text; negative values keep their sign after the $."""
    return F.concat(F.lit("$"), F.format_number(col_(c).cast("double"), places))
