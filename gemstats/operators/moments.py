"""Mergeable centred moments: counts, means, squared deviations, co-moments.

Raw sums of squares lose everything when values lie far from zero (1e8 + 0.06
squared leaves no digit for the 0.06). Here each group keeps its mean and the
squares and products of deviations from it (Spark's ``var_pop`` and ``regr_*``
aggregates, which are updated and merged that way in every map task), and parts
are combined by what their means differ: for parts i with n_i rows, mean m_i and
squared deviations s_i, the whole has ``sum(s_i) + sum(n_i * (m_i - m)^2)``, and
co-moments alike. The mean of means is taken from the smallest one on, so equal
parts leave no rounding behind.

A table of parts can be stored, added to and rolled up again; rows are read once.
Pairs use the rows that have both values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pairs = dict[str, tuple[str, str]]


def _pair_columns(name: str) -> list[str]:
    return [f"{name}_{k}" for k in ("n", "mx", "my", "sxx", "syy", "sxy", "lox", "hix", "loy", "hiy")]


def moments_sql(columns: list[str], pairs: Pairs) -> list[str]:
    """Aggregates over rows as SQL text: n; for a column c n_c, mean_c, m2_c;
    for a pair its count, means, sxx, syy, sxy and ends."""
    out = ["count(1) AS n"]
    for c in columns:
        v = f"CAST(`{c}` AS DOUBLE)"
        out += [f"count(`{c}`) AS n_{c}", f"avg({v}) AS mean_{c}", f"var_pop({v}) * count(`{c}`) AS m2_{c}"]
    for name, (x, y) in pairs.items():
        x, y = f"CAST(`{x}` AS DOUBLE)", f"CAST(`{y}` AS DOUBLE)"
        xp, yp = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
        found = (f"regr_count({y}, {x})", f"regr_avgx({y}, {x})", f"regr_avgy({y}, {x})", f"regr_sxx({y}, {x})",
                 f"regr_syy({y}, {x})", f"regr_sxy({y}, {x})", f"min({xp})", f"max({xp})", f"min({yp})", f"max({yp})")
        out += [f"{sql} AS {c}" for sql, c in zip(found, _pair_columns(name), strict=True)]
    return out


def moments(df: DataFrame, by: list[str], columns: list[str], pairs: Pairs, also: list[str] = []) -> DataFrame:
    """One row per group: the moments, and further aggregates given as SQL."""
    aggs = [F.expr(sql) for sql in moments_sql(columns, pairs) + also]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def merged(parts: DataFrame, by: list[str], columns: list[str], pairs: Pairs, also: list[str] = []) -> DataFrame:
    """Parts with the columns of ``moments`` rolled up to the keys ``by``;
    ``also``: further aggregates over the parts, as SQL with aliases."""
    whole = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in by) or '1'})"
    means = [(f"n_{c}", f"mean_{c}") for c in columns] + [(f"{p}_n", f"{p}_{m}") for p in pairs for m in ("mx", "my")]
    first = parts.selectExpr("*", *[f"min({m}) {whole} AS _low_{m}" for _, m in means])
    shifted = first.selectExpr("*", *[
        f"_low_{m} + try_divide(sum({n} * ({m} - _low_{m})) {whole}, sum(CASE WHEN {m} IS NOT NULL THEN {n} END) {whole}) AS _all_{m}" for n, m in means])

    def apart(m: str) -> str:
        return f"({m} - _all_{m})"

    aggs = ["sum(n) AS n"]
    for c in columns:
        aggs += [f"sum(n_{c}) AS n_{c}", f"max(_all_mean_{c}) AS mean_{c}",
                 f"sum(m2_{c} + n_{c} * {apart(f'mean_{c}')} * {apart(f'mean_{c}')}) AS m2_{c}"]
    for p in pairs:
        mx, my = apart(f"{p}_mx"), apart(f"{p}_my")
        aggs += [f"sum({p}_n) AS {p}_n", f"max(_all_{p}_mx) AS {p}_mx", f"max(_all_{p}_my) AS {p}_my",
                 *[f"sum({p}_{s} + {p}_n * {a} * {b}) AS {p}_{s}" for s, a, b in (("sxx", mx, mx), ("syy", my, my), ("sxy", mx, my))],
                 *[f"{end}({p}_{c}) AS {p}_{c}" for end, c in (("min", "lox"), ("max", "hix"), ("min", "loy"), ("max", "hiy"))]]
    exprs = [F.expr(sql) for sql in aggs + also]
    return shifted.groupBy(*by).agg(*exprs) if by else shifted.agg(*exprs)


def rolled_up(parts: DataFrame, keys: list[str], columns: list[str], pairs: Pairs, also: list[str] = []) -> DataFrame:
    """Parts by all of ``keys`` rolled up to each key and to the whole: ``_set``
    is the key's place in ``keys``, or their number for the whole; the other
    keys are NULL."""
    rest = [c for c in parts.columns if c not in keys]
    sets = parts.selectExpr("*", f"explode(sequence(0, {len(keys)})) AS _set").selectExpr(
        "_set", *[f"CASE WHEN _set = {i} THEN `{k}` END AS `{k}`" for i, k in enumerate(keys)], *[f"`{c}`" for c in rest])
    return merged(sets, ["_set", *keys], columns, pairs, also)


def std_sql(column: str) -> str:
    """Sample standard deviation of a column from its moments."""
    return f"CASE WHEN n_{column} > 1 THEN sqrt(m2_{column} / (n_{column} - 1)) END"


def corr_sql(pair: str) -> str:
    """Pearson r of a pair; NULL where either side is constant."""
    return (f"CASE WHEN {pair}_lox < {pair}_hix AND {pair}_loy < {pair}_hiy THEN "
            f"try_divide({pair}_sxy, sqrt({pair}_sxx) * sqrt({pair}_syy)) END")
