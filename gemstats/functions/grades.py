"""Grade vocabularies and the column expressions that map them.

Every lookup is a literal ``map`` column, so it is evaluated inside the
generated code of the stage that reads the row; no join, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's tables for right results.
# ---------------------------------------------------------------------------
COLOR_ORDINAL = {"D": 1, "E": 2, "F": 3, "G": 4, "H": 5, "I": 6, "J": 7}
CLARITY_ORDINAL = {
    "I1": 1, "SI2": 2, "SI1": 3, "VS2": 4, "VS1": 5, "VVS2": 6, "VVS1": 7, "IF": 8,
}
CUT_LAB_GRADE = {
    "Fair": "Poor",
    "Good": "Good",
    "Very Good": "Very Good",
    "Premium": "Excellent",
    "Ideal": "Excellent",
}
# Allowed values of a manually entered stone (in the order the entry form lists them).
CUT_CHOICES = ["Ideal", "Premium", "Very Good", "Good", "Fair"]
COLOR_CHOICES = ["D", "E", "F", "G", "H", "I", "J"]
CLARITY_CHOICES = ["IF", "VVS1", "VVS2", "VS1", "VS2", "SI1", "SI2", "I1"]
MANUAL_CARAT_RANGE = (0.1, 10.0)
MANUAL_PRICE_RANGE = (100, 100000)
# Grade groups used by the share statistics.
PREMIUM_CUTS = ["Premium", "Ideal"]
PREMIUM_COLORS = ["D", "E", "F"]
SWEET_SPOT_CLARITIES = ["SI1", "VS2"]
PREMIUM_CLARITIES = ["IF", "VVS1", "VVS2"]
# Carat thresholds of the small / large shares.
SMALL_CARAT_MAX = 1.0
LARGE_CARAT_MIN = 2.0
# Correlation thresholds of the two flags.
STRONG_CORRELATION = 0.8
WEAK_CORRELATION = 0.3
# Grade pairs compared by the two price "paradox" flags: (dearer-looking, cheaper-looking).
COLOR_PARADOX = ("J", "D")
CLARITY_PARADOX = ("SI2", "VVS1")
# Reference lines of the cumulative-distribution chart.
ECDF_PERCENT_LINE = 80.0
ECDF_CARAT_LINE = 1.2
# Bin caps of the two histograms, listing / preview sizes.
CARAT_BINS = 30
PRICE_BINS = 50
LISTING_ROWS = 100
PREVIEW_ROWS = 5
# ---------------------------------------------------------------------------


def lookup(mapping: dict, column: str | Column) -> Column:
    """``mapping[column]`` as a literal map; unknown or NULL keys give NULL."""
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    col = F.col(column) if isinstance(column, str) else column
    return F.create_map(*pairs)[col]


def rank_of(values: list[str], column: str | Column) -> Column:
    """1-based position of ``column`` in ``values`` (NULL when absent)."""
    return lookup({v: i + 1 for i, v in enumerate(values)}, column)


def color_ordinal(column: str | Column = "color") -> Column:
    return lookup(COLOR_ORDINAL, column)


def clarity_ordinal(column: str | Column = "clarity") -> Column:
    return lookup(CLARITY_ORDINAL, column)


def cut_lab_grade(column: str | Column = "cut") -> Column:
    return lookup(CUT_LAB_GRADE, column)
