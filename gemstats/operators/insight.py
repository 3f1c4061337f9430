"""Statistics bundles per analysis type, serialised to JSON, and prompt rows.

Each analysis type is one small plan: an aggregate over the rows plus
(for category analyses) maps built from the category profile, whose size
is the number of grades, not the number of rows. The HTTP call to a
language model is not made here; the rows are what such a call needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from .moments import corr_sql, moments, rolled_up, std_sql
from .ranks import exact_quantiles

# The analysis types, in menu order.
ANALYSIS_TYPES = ["Carat Analysis", "Cut Analysis", "Color Analysis",
                  "Clarity Analysis", "Correlation Analysis"]


GRADE_KEYS = ("cut", "color", "clarity")
_TYPE_KEY = {"Cut Analysis": "cut", "Color Analysis": "color", "Clarity Analysis": "clarity"}


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bundle_fields(key_set: dict, analysis_type: str, has_ordinals: bool) -> list[tuple[str, str]]:
    """``(field, SQL aggregate)`` pairs over the rolled-up moments giving one bundle (``total_diamonds`` first, as in the statistics mirrored).
    ``_quartiles`` names the exact carat quartiles, attached after the
    aggregate. SQL text, so the whole bundle set is one call to the JVM."""
    whole = f"_set = {key_set[None]}"

    def of_all(c):  # the value over all rows
        return f"max(CASE WHEN {whole} THEN `{c}` END)"

    def ratio(num, den):
        return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"

    out = [("total_diamonds", f"coalesce({of_all('n')}, CAST(0 AS BIGINT))"),
           ("analysis_type", _q(analysis_type))]
    if analysis_type == "Carat Analysis":
        return out + [
            ("avg_carat", of_all("avg_carat")),
            ("median_carat", "_quartiles[1]"),
            ("carat_std", of_all("carat_std")),
            ("carat_range", f"array(CAST({of_all('min_carat')} AS DOUBLE), CAST({of_all('max_carat')} AS DOUBLE))"),
            ("carat_quartiles", "_quartiles"),
            ("small_diamonds_pct", f"{ratio(of_all('n_small'), of_all('n'))} * 100.0D"),
            ("large_diamonds_pct", f"{ratio(of_all('n_large'), of_all('n'))} * 100.0D"),
            ("price_carat_correlation", of_all("r_price_carat"))]
    if analysis_type == "Correlation Analysis":
        if not has_ordinals:
            return out
        pc, pcol = of_all("r_price_carat"), of_all("r_price_color")
        return out + [
            ("price_carat_corr", pc),
            ("price_color_corr", pcol),
            ("price_clarity_corr", of_all("r_price_clarity")),
            ("carat_dominates_pricing", f"coalesce(abs({pc}) > {grades.STRONG_CORRELATION!r}D, false)"),
            ("color_weak_correlation", f"coalesce(abs({pcol}) < {grades.WEAK_CORRELATION!r}D, false)")]
    key = _TYPE_KEY.get(analysis_type)
    if key is None or key not in key_set:
        return out
    k = f"`{key}`"
    mine = f"_set = {key_set[key]}"
    known = f"{mine} AND {k} IS NOT NULL"
    ppc = ratio("avg_price", "avg_carat")

    def kv(value):
        return (f"map_from_entries(array_sort(collect_list("
                f"CASE WHEN {known} THEN named_struct('k', {k}, 'v', {value}) END)))")

    def first_by(order, pick="min_by"):  # a key without the ordered value can't win
        return f"{pick}({k}, CASE WHEN {known} AND ({order}) IS NOT NULL THEN struct({order}, {k}) END)"

    def last_by(order):
        return first_by(order, "max_by")

    def pct(values):
        members = ", ".join(_q(v) for v in values)
        return f"{ratio(f'coalesce(sum(CASE WHEN {mine} AND {k} IN ({members}) THEN n END), 0)', of_all('n'))} * 100.0D"

    def exceeds(pair):
        a, b = pair
        return (f"coalesce(max(CASE WHEN {mine} AND {k} = {_q(a)} THEN avg_price END)"
                f" > max(CASE WHEN {mine} AND {k} = {_q(b)} THEN avg_price END), false)")

    if key == "cut":
        return out + [
            ("cut_distribution", kv("n")),
            ("most_common_cut", first_by("-n")),
            ("least_common_cut", last_by("-n")),
            ("cut_price_avg", kv("avg_price")),
            ("highest_priced_cut", first_by("-avg_price")),
            ("lowest_priced_cut", first_by("avg_price")),
            ("premium_cuts_pct", pct(grades.PREMIUM_CUTS))]
    if key == "color":
        return out + [
            ("color_distribution", kv("n")),
            ("most_common_color", first_by("-n")),
            ("premium_colors_pct", pct(grades.PREMIUM_COLORS)),
            ("avg_carat_by_color", kv("avg_carat")),
            ("avg_price_by_color", kv("avg_price")),
            ("price_per_carat_by_color", kv(ppc)),
            ("best_value_color", first_by(f"-{ppc}")),
            ("color_price_paradox", exceeds(grades.COLOR_PARADOX))]
    return out + [
        ("clarity_distribution", kv("n")),
        ("most_common_clarity", first_by("-n")),
        ("sweet_spot_clarity_pct", pct(grades.SWEET_SPOT_CLARITIES)),
        ("premium_clarity_pct", pct(grades.PREMIUM_CLARITIES)),
        ("clarity_price_avg", kv("avg_price")),
        ("highest_priced_clarity", first_by("-avg_price")),
        ("clarity_price_paradox", exceeds(grades.CLARITY_PARADOX))]


PAIRS = {"r_price_carat": ("price", "carat"), "r_price_color": ("price", "color_numeric"),
         "r_price_clarity": ("price", "clarity_numeric")}


COLUMNS = ["carat", "price"]


def _derived(g: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Means, deviation and correlations of each group from its moments."""
    return g.selectExpr("*", "mean_carat AS avg_carat", "mean_price AS avg_price", f"{std_sql('carat')} AS carat_std",
                        *[f"{corr_sql(p)} AS {p}" for p in pairs])


def insight_bundles(df: DataFrame, types: list[str] = ANALYSIS_TYPES) -> DataFrame:
    """``analysis_type, stats_json`` for each requested type, in one pass.

    The rows are aggregated once by (cut, color, clarity) into centred moments
    (``moments``), which are rolled up to (cut), (color), (clarity) and the whole
    from that table of at most a few hundred grade combinations; so values far
    from zero keep their deviations and correlations. Exact carat quartiles are the only other read.
    NULL statistics are kept as JSON null; an unknown type carries only the
    total and the type.
    """
    has_ordinals = "color_numeric" in df.columns and "clarity_numeric" in df.columns
    keys = [k for k in GRADE_KEYS if k in df.columns and any(_TYPE_KEY.get(t) == k for t in types)]
    pairs = PAIRS if has_ordinals else {"r_price_carat": PAIRS["r_price_carat"]}
    g = moments(df, keys, COLUMNS, pairs, [
        f"count_if(carat <= {grades.SMALL_CARAT_MAX!r}D) AS n_small", f"count_if(carat >= {grades.LARGE_CARAT_MIN!r}D) AS n_large",
        "min(carat) AS min_carat", "max(carat) AS max_carat"])
    if keys:
        g = rolled_up(g, keys, COLUMNS, pairs, ["sum(n_small) AS n_small", "sum(n_large) AS n_large",
                                                "min(min_carat) AS min_carat", "max(max_carat) AS max_carat"])
    else:
        g = g.withColumn("_set", F.lit(0))
    key_set: dict = {k: i for i, k in enumerate(keys)} | {None: len(keys)}
    g = _derived(g, pairs)
    per_type = [_bundle_fields(key_set, t, has_ordinals) for t in types]
    # quartile references stay outside the aggregate; everything else is one aggregate
    aggregated = [(i, j, sql) for i, fields in enumerate(per_type) for j, (_, sql) in enumerate(fields)
                  if not sql.startswith("_quartiles")]
    one = g.selectExpr(*[f"{sql} AS b{i}_{j}" for i, j, sql in aggregated])
    if "Carat Analysis" in types:
        q = exact_quantiles(df, "carat", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
        one = one.select("*", q.select(F.array("q25", "q50", "q75")).scalar().alias("_quartiles"))
    done = {(i, j) for i, j, _ in aggregated}
    rows = []
    for i, (t, fields) in enumerate(zip(types, per_type)):
        body = ", ".join(f"{_q(name)}, {f'b{i}_{j}' if (i, j) in done else sql}"
                         for j, (name, sql) in enumerate(fields))
        rows.append(f"named_struct('analysis_type', {_q(t)}, 'stats_json', "
                    f"to_json(named_struct({body}), map('ignoreNullFields', 'false')))")
    return one.selectExpr(f"inline(array({', '.join(rows)}))")


def insight_stats(df: DataFrame, analysis_type: str) -> DataFrame:
    """One row: ``analysis_type, stats_json`` for one analysis type."""
    return insight_bundles(df, [analysis_type])


def all_insight_stats(df: DataFrame, types: list[str] = ANALYSIS_TYPES) -> DataFrame:
    return insight_bundles(df, types)


# What a prompt must carry: who answers, which sections, about what, from which
# figures. All of it but the figures can be replaced.
ROLE = "Role: market analyst for graded goods."
SECTIONS = ("Findings", "Meaning", "Actions")
CONTEXT: tuple[str, ...] = ()
STYLE = "Cite the figures given."


def prompt_text(analysis_type: Column, stats_json: Column, role: str = ROLE, sections: tuple[str, ...] = SECTIONS,
                context: tuple[str, ...] = CONTEXT, style: str = STYLE) -> Column:
    """Role, sections, context and style around the type and its statistics."""
    about = "".join(f"Context: {line}\n" for line in context)
    return F.concat(F.lit(f"{role}\nSections: {', '.join(sections)}.\n{about}Topic: "), analysis_type,
                    F.lit("\nFigures (JSON): "), stats_json, F.lit(f"\n{style}\n"))


def insight_prompts(stats: DataFrame, **wording) -> DataFrame:
    """analysis_type, stats_json, prompt; ``wording`` as in ``prompt_text``."""
    return stats.select("analysis_type", "stats_json",
                        prompt_text(F.col("analysis_type"), F.col("stats_json"), **wording).alias("prompt"))


def prompt_checks(prompts: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """analysis_type, has_type, has_stats, has_sections: what each prompt holds."""
    holds = F.lit(True)
    for name in sections:
        holds = holds & F.col("prompt").contains(name)
    return prompts.select("analysis_type", F.col("prompt").contains(F.col("analysis_type")).alias("has_type"),
                          F.col("prompt").contains(F.col("stats_json")).alias("has_stats"), holds.alias("has_sections"))


def insight_fields(stats: DataFrame) -> DataFrame:
    """The bundles in long form, parsed from their JSON: analysis_type, field,
    key (of a map's entry, a list's place, or empty), num (6 decimals) and txt
    (texts and truth values)."""
    text = "map<string,string>"
    top = stats.select("analysis_type", F.explode(F.from_json("stats_json", text)).alias("field", "v")).filter("field != 'analysis_type'")
    entries = (F.when(F.col("v").startswith("{"), F.map_entries(F.from_json("v", text)))
                .when(F.col("v").startswith("["), F.expr("transform(from_json(v, 'array<string>'), (x, i) -> struct(string(i) AS key, x AS value))"))
                .otherwise(F.array(F.struct(F.lit("").alias("key"), F.col("v").alias("value")))))
    flat = top.select("analysis_type", "field", F.explode(entries).alias("e")).select("analysis_type", "field", "e.key", "e.value")
    number = F.expr("try_cast(value AS DOUBLE)")
    return flat.select("analysis_type", "field", "key", F.round(number, 6).alias("num"), F.when(number.isNull(), F.col("value")).alias("txt"))


def save_insights(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Store bundles / prompts (``json``), or the prompt texts alone (``text``)."""
    if fmt == "text":
        rows.select("prompt").write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").json(path)
