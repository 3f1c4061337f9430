"""One object per uploaded table, with a method per page of the original app.

    a = DiamondAnalytics.load(spark, "s3://bucket/diamonds.csv")
    a.quality_report().show()
    a.analysis("Color Analysis")["price_per_carat"].show()
    led = a.ledger().add_all(a.filtered(price=(1000, 5000)))

Every method returns lazy DataFrames built by the operators; the cleaned
table is written once to the shared folder and read back, so each page's
queries get pushed filters and pruned columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import grades
from .operators import category as cat
from .operators import clean as cln
from .operators import correlation as cor
from .operators import distribution as dst
from .operators import filters as flt
from .operators import insight as ins
from .operators import inventory as inv
from .operators import profile as prf
from .plans.store import files_identity, frame_identity, stored
from .sources.files import read_table


class DiamondAnalytics:
    def __init__(self, spark: SparkSession, cleaned: DataFrame):
        self.spark = spark
        self.df = cleaned

    @classmethod
    def load(cls, spark: SparkSession, path: str, fmt: str | None = None,
             refresh: bool = False) -> "DiamondAnalytics":
        """Read (CSV / Parquet / JSON), clean, store once, and read back."""
        return cls(spark, stored(spark, f"upload|{fmt}|{path}", files_identity(spark, path),
                                 lambda: cln.clean(read_table(spark, path, fmt, ordered=True)), refresh))

    @classmethod
    def from_frame(cls, spark: SparkSession, raw: DataFrame, key: str,
                   refresh: bool = False) -> "DiamondAnalytics":
        """Same, for raw rows already described by a DataFrame (``key`` names it)."""
        return cls(spark, stored(spark, f"frame|{key}", frame_identity(raw), lambda: cln.clean(raw), refresh))

    # -- upload page -----------------------------------------------------------
    def preview(self, n: int = grades.PREVIEW_ROWS) -> DataFrame:
        return cln.preview(self.df, n)

    def quality_report(self) -> DataFrame:
        return cln.quality_report(self.df)

    # -- overview page -----------------------------------------------------------
    def overview(self) -> dict[str, DataFrame]:
        return {"metrics": prf.overview_metrics(self.df), "labels": prf.overview_labels(self.df),
                "price_histogram": dst.histogram(self.df, "price", grades.PRICE_BINS),
                "scatter_density": dst.scatter_density(self.df)}

    # -- analysis page -------------------------------------------------------------
    def analysis(self, analysis_type: str) -> dict[str, DataFrame]:
        """The chart data and statistics of one analysis type."""
        d = self.df
        if analysis_type == "Carat Analysis":
            out = {"histogram": dst.histogram(d, "carat", grades.CARAT_BINS),
                   "ecdf": dst.ecdf_values(d, "carat"), "ecdf_lines": dst.ecdf_thresholds(d, "carat"),
                   "scatter_density": dst.scatter_density(d), "stats": prf.carat_stats(d),
                   "shares": prf.carat_shares(d)}
        elif analysis_type == "Cut Analysis":
            out = {"counts": cat.frequency(d, "cut"), "avg_price": cat.mean_by(d, "cut", "price"),
                   "extremes": cat.cut_extremes(d),
                   "premium_share": cat.grade_shares(d, "cut", {"premium_cuts_pct": grades.PREMIUM_CUTS})}
        elif analysis_type == "Color Analysis":
            out = {"counts": cat.frequency(d, "color", by_key=True), "price_per_carat": cat.color_profile(d),
                   "extremes": cat.color_extremes(d), "paradoxes": cat.price_paradoxes(d),
                   "premium_share": cat.grade_shares(d, "color", {"premium_colors_pct": grades.PREMIUM_COLORS})}
        elif analysis_type == "Clarity Analysis":
            out = {"counts": cat.frequency(d, "clarity"), "box": dst.box_stats(d, "price", "clarity"),
                   "outliers": dst.box_outliers(d, "price", "clarity"),
                   "avg_price": cat.mean_by(d, "clarity", "price"), "extremes": cat.clarity_extremes(d),
                   "shares": cat.grade_shares(d, "clarity", {
                       "sweet_spot_clarity_pct": grades.SWEET_SPOT_CLARITIES,
                       "premium_clarity_pct": grades.PREMIUM_CLARITIES})}
        elif analysis_type == "Correlation Analysis":
            out = {"matrix": cor.corr_matrix(d), "flags": cor.corr_flags(d), "labels": cor.corr_labels(d)}
        else:
            raise ValueError(f"unknown analysis type {analysis_type!r}")
        stats = ins.insight_stats(d, analysis_type)
        out["insight_stats"] = stats
        out["insight_prompt"] = ins.insight_prompts(stats)
        return out

    # -- inventory page -------------------------------------------------------------
    def filter_bounds(self) -> DataFrame:
        return flt.filter_bounds(self.df)

    def filter_options(self) -> DataFrame:
        return flt.filter_options(self.df)

    def filtered(self, **bounds) -> DataFrame:
        """``price=(lo, hi)``, ``carat=(lo, hi)``, ``colors=[...]``, ``clarities=[...]``, ``cuts=[...]``."""
        return flt.apply_filters(self.df, **bounds)

    def filter_counts(self, **bounds) -> DataFrame:
        return flt.filter_counts(self.df, flt.diamond_predicate(**bounds))

    def listing(self, n: int = grades.LISTING_ROWS, **bounds) -> DataFrame:
        return flt.listing(self.filtered(**bounds), n)

    def ledger(self) -> inv.Ledger:
        """An empty ledger with all columns and types of this table."""
        return inv.Ledger(self.spark, item_schema=inv.widened(self.df.schema, inv.MANUAL_SCHEMA))
