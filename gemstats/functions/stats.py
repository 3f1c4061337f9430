"""Aggregate expressions that stay safe under ANSI mode.

All of them are built-in Spark aggregates, so they run as partial
aggregates before the shuffle and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result doubles are rounded to this many decimals before they are compared
# with another engine: sums of doubles differ in the last bits by order.
DIGITS = 6


def c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def r6(expr: Column) -> Column:
    return F.round(expr, DIGITS)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; NULL (not an error) when ``den`` is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def share_pct(predicate: Column) -> Column:
    """Percent of *all* rows (NULLs included) for which ``predicate`` holds.

    Written as count / n * 100, the order of operations of the statistics
    it mirrors; NULL on an empty input.
    """
    return ratio(F.count_if(predicate), F.count(F.lit(1))) * F.lit(100.0)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r with pairwise deletion; NULL for < 2 pairs or zero variance.

    ``corr`` itself raises DIVIDE_BY_ZERO under ANSI on a constant column,
    so the ratio is taken with ``try_divide`` over pair-complete inputs.
    """
    x, y = c(x), c(y)
    xp = F.when(y.isNotNull(), x)
    yp = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(xp, yp), F.stddev_samp(xp) * F.stddev_samp(yp))


def self_corr(x: str | Column) -> Column:
    """Diagonal of a correlation matrix: 1.0, or NULL without variance."""
    v = F.var_samp(c(x))
    return F.try_divide(v, v)


def avg_where(value: str | Column, predicate: Column) -> Column:
    return F.avg(F.when(predicate, c(value)))


def greater_or_false(a: Column, b: Column) -> Column:
    """``a > b``; false when either side is missing."""
    return F.coalesce(a > b, F.lit(False))


def _known(order: tuple[Column, ...], key: Column) -> Column:
    """The sort key; NULL (so the row can't win) where any part of it is missing."""
    there = order[0].isNotNull()
    for o in order[1:]:
        there = there & o.isNotNull()
    return F.when(there, F.struct(*order, key))


def arg_first(key: str | Column, *order: Column) -> Column:
    """Key of the first row in ``order`` (ties broken by the key itself). Rows
    whose ``order`` is NULL don't take part, as pandas' idxmin skips them."""
    return F.min_by(c(key), _known(order, c(key)))


def arg_last(key: str | Column, *order: Column) -> Column:
    """Key of the last row in ``order`` (ties broken by the key itself)."""
    return F.max_by(c(key), _known(order, c(key)))
