"""Display text built from numbers with Spark's own formatters.

``format_number`` rounds half-to-even on the exact binary value, as the
``,.0f`` / ``.2f`` format specs of the statistics it mirrors do;
``format_string('%.2f')`` would round half-up on the decimal text instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import c


def thousands(value: str | Column, decimals: int = 0) -> Column:
    """``f"{v:,.{decimals}f}"``: grouped thousands."""
    return F.format_number(c(value), decimals)


def fixed(value: str | Column, decimals: int) -> Column:
    """``f"{v:.{decimals}f}"``: no grouping."""
    return F.regexp_replace(F.format_number(c(value), decimals), ",", "")


def dollars(value: str | Column, decimals: int = 0) -> Column:
    return F.concat(F.lit("$"), thousands(value, decimals))


def grouped(value: str | Column, kind: T.DataType | None = None) -> Column:
    """``f"{v:,}"``: grouped thousands, and for a fractional type (``kind`` is
    double, float or decimal) the shortest fraction, at least one digit."""
    v = c(value)
    if kind is None or isinstance(kind, T.IntegralType):
        return F.format_number(v, 0)
    exact = F.abs(v.cast("double")).cast("decimal(38,15)")
    fraction = F.rtrim(F.substring_index(exact.cast("string"), ".", -1), F.lit("0"))
    whole = F.format_number(F.floor(exact).cast("decimal(38,0)"), 0)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(""), whole, F.lit("."),
                    F.when(fraction == "", F.lit("0")).otherwise(fraction))


def item_label(id_col: str | Column, carat: str | Column = "carat",
               color: str | Column = "color", clarity: str | Column = "clarity",
               price: str | Column = "price", price_type: T.DataType | None = None) -> Column:
    """``Diamond {id}: {carat:.2f}ct, {color}-{clarity}, ${price:,}``."""
    return F.concat(
        F.lit("Diamond "), c(id_col).cast("string"), F.lit(": "),
        fixed(carat, 2), F.lit("ct, "),
        c(color), F.lit("-"), c(clarity), F.lit(", $"),
        grouped(price, price_type),
    )
