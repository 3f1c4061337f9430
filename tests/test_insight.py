import json
import os

from gemstats.operators import insight as ins
from gemstats.operators.clean import clean
from gemstats.sources.fixture import diamond_raw
from tests.conftest import SF_SMALL


def test_bundles_and_prompts(spark, scratch):
    df = clean(diamond_raw(spark, SF_SMALL))
    stats = ins.all_insight_stats(df)
    got = {r.analysis_type: json.loads(r.stats_json) for r in stats.collect()}
    assert list(got) == ins.ANALYSIS_TYPES
    assert all(b["total_diamonds"] == 5964 for b in got.values())
    carat = got["Carat Analysis"]
    assert carat["carat_quartiles"][1] == carat["median_carat"]
    assert len(carat["carat_range"]) == 2
    color = got["Color Analysis"]
    assert set(color["color_distribution"]) == set("DEFGHIJK")
    assert sum(color["color_distribution"].values()) == 5964
    assert isinstance(color["color_price_paradox"], bool)
    assert got["Correlation Analysis"]["carat_dominates_pricing"] is True
    prompts = ins.insight_prompts(stats).collect()
    for r in prompts:
        for section in ins.SECTIONS:
            assert section in r.prompt
        assert r.stats_json in r.prompt and f"Topic: {r.analysis_type}" in r.prompt
    own = ins.insight_prompts(stats, role="R", sections=("A", "B"), context=("c1",), style="S").first().prompt
    assert own.startswith("R\nSections: A, B.\nContext: c1\nTopic: ") and own.endswith("\nS\n")
    out = os.path.join(scratch, "insights")
    ins.save_insights(ins.insight_prompts(stats), out)
    back = spark.read.json(out)
    assert back.count() == 5 and set(back.columns) == {"analysis_type", "stats_json", "prompt"}
    txt = os.path.join(scratch, "prompts_txt")
    ins.save_insights(ins.insight_prompts(stats), txt, fmt="text")
    assert spark.read.text(txt).count() > 5  # prompts span many lines


def test_unknown_type_has_total_only(spark):
    df = spark.createDataFrame([(1.0, "Ideal", "D", "IF", 100)],
                               "carat double, cut string, color string, clarity string, price bigint")
    r = ins.insight_stats(df, "Something Else").first()
    assert json.loads(r.stats_json) == {"total_diamonds": 1, "analysis_type": "Something Else"}


def test_correlation_bundle_needs_derived_columns(spark):
    df = spark.createDataFrame([(1.0, 100)], "carat double, price bigint")
    r = ins.insight_stats(df, "Correlation Analysis").first()
    assert json.loads(r.stats_json) == {"total_diamonds": 1, "analysis_type": "Correlation Analysis"}


def test_empty_table_bundle(spark):
    df = spark.createDataFrame([], "carat double, cut string, color string, clarity string, price bigint")
    b = json.loads(ins.insight_stats(df, "Cut Analysis").first().stats_json)
    assert b["most_common_cut"] is None and b["premium_cuts_pct"] is None and b["total_diamonds"] == 0
    c = json.loads(ins.insight_stats(df, "Carat Analysis").first().stats_json)
    assert c["carat_quartiles"] == [None, None, None] and c["carat_range"] == [None, None]
    assert c["median_carat"] is None and c["total_diamonds"] == 0


def test_bundle_numbers_equal_checked_queries(spark):
    """The grouping-sets bundles give the same numbers as the SQL-checked queries."""
    import __spark_entry__ as entry
    q = entry.queries()
    stats = {r.analysis_type: json.loads(r.stats_json)
             for r in q["insight_stats"](spark, SF_SMALL).collect()}

    def one(name):
        return q[name](spark, SF_SMALL).first().asDict()

    r6 = lambda x: None if x is None else round(x, 6)
    carat, cs, sh = stats["Carat Analysis"], one("carat_stats"), one("carat_shares")
    assert r6(carat["avg_carat"]) == cs["avg_carat"] and r6(carat["carat_std"]) == cs["carat_std"]
    assert [r6(v) for v in carat["carat_quartiles"]] == [cs["q25"], cs["q50"], cs["q75"]]
    assert carat["carat_range"] == [cs["min_carat"], cs["max_carat"]]
    assert r6(carat["small_diamonds_pct"]) == sh["small_diamonds_pct"]
    assert r6(carat["price_carat_correlation"]) == cs["price_carat_corr"]
    cut, ce = stats["Cut Analysis"], one("cut_extremes")
    assert all(cut[k] == ce[k] for k in ce)
    assert cut["cut_distribution"] == {r.cut: r.n for r in q["cut_counts"](spark, SF_SMALL).collect()}
    assert r6(cut["premium_cuts_pct"]) == one("cut_premium_share")["premium_cuts_pct"]
    color, prof = stats["Color Analysis"], q["color_profile"](spark, SF_SMALL).collect()
    assert {k: r6(v) for k, v in color["price_per_carat_by_color"].items()} == {r.color: r.price_per_carat for r in prof}
    assert color["best_value_color"] == one("color_extremes")["best_value_color"]
    assert color["color_price_paradox"] == one("price_paradoxes")["color_price_paradox"]
    clarity, cl = stats["Clarity Analysis"], one("clarity_shares")
    assert r6(clarity["premium_clarity_pct"]) == cl["premium_clarity_pct"]
    assert clarity["highest_priced_clarity"] == one("clarity_extremes")["highest_priced_clarity"]
    corr, cf = stats["Correlation Analysis"], one("corr_flags")
    assert r6(corr["price_color_corr"]) == cf["price_color_corr"]
    assert corr["color_weak_correlation"] == cf["color_weak_correlation"]
