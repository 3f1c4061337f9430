"""Random filter settings against a pandas brute force on the fixture."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gemstats.operators import filters as flt
from gemstats.plans.store import cleaned_diamonds
from tests.conftest import SF_SMALL

COLORS = list("DEFGHIJK")
CLARITIES = ["I1", "SI2", "SI1", "VS2", "VS1", "VVS2", "VVS1", "IF"]
CUTS = ["Fair", "Good", "Very Good", "Premium", "Ideal"]


@pytest.fixture(scope="module")
def data(spark):
    df = cleaned_diamonds(spark, SF_SMALL)
    return df, df.toPandas()


bounds = st.one_of(st.none(), st.tuples(st.integers(0, 10000), st.integers(0, 10000)).map(sorted).map(tuple))
carats = st.one_of(st.none(), st.tuples(st.floats(0, 5), st.floats(0, 5)).map(sorted).map(tuple))
members = lambda vals: st.one_of(st.none(), st.lists(st.sampled_from(vals), max_size=4, unique=True))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(price=bounds, carat=carats, colors=members(COLORS), clarities=members(CLARITIES), cuts=members(CUTS))
def test_filter_matches_brute_force(data, price, carat, colors, clarities, cuts):
    df, pdf = data
    kw = dict(price=price, carat=carat, colors=colors, clarities=clarities, cuts=cuts)
    mask = pdf["price"].notna()
    if price:
        mask &= (pdf["price"] >= price[0]) & (pdf["price"] <= price[1])
    if carat:
        mask &= (pdf["carat"] >= carat[0]) & (pdf["carat"] <= carat[1])
    for col, vals in (("color", colors), ("clarity", clarities), ("cut", cuts)):
        if vals is not None:
            mask &= pdf[col].isin(vals)
    c = flt.filter_counts(df, flt.diamond_predicate(**kw)).first()
    assert c.n_filtered == int(mask.sum()) <= c.n_total == len(pdf)
    assert flt.apply_filters(df, **kw).count() == c.n_filtered
