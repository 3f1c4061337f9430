"""DuckDB twins of the registered queries, written independently in SQL.

Every text starts from the driver tables: the synthetic view (``raw``),
then the cleaning steps as CTEs. Doubles are rounded to 6 decimals and
integer results cast to the types the Spark side returns.
"""

from __future__ import annotations

from ..sources.fixture import RAW_SQL

CLEAN_SQL = """dedup AS (SELECT DISTINCT carat, cut, color, clarity, price, x, y, z FROM raw),
nonnull AS (
  SELECT * FROM dedup
  WHERE carat IS NOT NULL AND cut IS NOT NULL AND color IS NOT NULL AND clarity IS NOT NULL
    AND price IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
validdims AS (SELECT * FROM nonnull WHERE x > 0 AND y > 0 AND z > 0),
cleaned AS (
  SELECT *,
    CASE color WHEN 'D' THEN 1 WHEN 'E' THEN 2 WHEN 'F' THEN 3 WHEN 'G' THEN 4
               WHEN 'H' THEN 5 WHEN 'I' THEN 6 WHEN 'J' THEN 7 END AS color_numeric,
    CASE clarity WHEN 'I1' THEN 1 WHEN 'SI2' THEN 2 WHEN 'SI1' THEN 3 WHEN 'VS2' THEN 4
                 WHEN 'VS1' THEN 5 WHEN 'VVS2' THEN 6 WHEN 'VVS1' THEN 7 WHEN 'IF' THEN 8 END
      AS clarity_numeric,
    CASE cut WHEN 'Fair' THEN 'Poor' WHEN 'Good' THEN 'Good' WHEN 'Very Good' THEN 'Very Good'
             WHEN 'Premium' THEN 'Excellent' WHEN 'Ideal' THEN 'Excellent' END AS cut_gia
  FROM validdims)"""

PRICE_P = "price BETWEEN 1000 AND 5000"
CARAT_P = "carat BETWEEN 0.5 AND 2.0"
MEMBER_P = ("color IN ('D','E','F','G') AND clarity IN ('VS1','VS2','VVS1','VVS2','IF') "
            "AND cut IN ('Ideal','Premium','Very Good')")
ALL_P = f"{PRICE_P} AND {CARAT_P} AND {MEMBER_P}"
# The cleaned rows with the place of their first copy in the lineitem file.
_ROW = "carat, cut, color, clarity, price, x, y, z"
ORDERED = (RAW_SQL.replace("base AS (\n  SELECT ", "o_base AS (\n  SELECT rn, ", 1).replace("FROM lineitem", "FROM (SELECT *, row_number() OVER () AS rn FROM lineitem)")
           .replace("dims AS (\n  SELECT ", "o_dims AS (\n  SELECT rn, ", 1).replace("FROM base", "FROM o_base")
           .replace("raw AS (\n  SELECT ", "o_raw AS (\n  SELECT rn, ", 1).replace("UNION ALL\n  SELECT ", "UNION ALL\n  SELECT rn, ")
           .replace("FROM dims", "FROM o_dims")
           + f""",
ordered AS (SELECT c.*, rn FROM cleaned c JOIN (SELECT {_ROW}, min(rn) AS rn FROM o_raw GROUP BY ALL) o USING ({_ROW}))""")
ITEM_COLS = "carat, cut, color, clarity, price, x, y, z, color_numeric, clarity_numeric, cut_gia"
MANUAL_ROW = ("CAST(1.5 AS DOUBLE) AS carat, 'Ideal' AS cut, 'E' AS color, 'VS1' AS clarity, "
              "CAST(12000 AS BIGINT) AS price, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, "
              "CAST(NULL AS DOUBLE) AS z, CAST(NULL AS INTEGER) AS color_numeric, "
              "CAST(NULL AS INTEGER) AS clarity_numeric, CAST(NULL AS VARCHAR) AS cut_gia")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([RAW_SQL, CLEAN_SQL, *ctes]) + "\n"


def _pct(pred: str) -> str:
    return f"round(CAST(count(*) FILTER (WHERE {pred}) AS DOUBLE) / count(*) * 100, 6)"


def _bins(value: str, nbins: int, src: str = "cleaned", prefix: str = "b") -> list[str]:
    """CTEs ``{prefix}_p`` (one row: step, origin, bins) for the nice-step histogram."""
    return [
        f"""{prefix}_s AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {src})""",
        f"""{prefix}_k AS (SELECT lo, hi, (hi - lo) / {nbins}.0 AS raw,
            CAST(floor(log10((hi - lo) / {nbins}.0)) AS BIGINT) AS k FROM {prefix}_s WHERE hi > lo)""",
        f"""{prefix}_c AS (
            SELECT lo, hi, raw, m,
              CASE WHEN k >= 0 THEN CAST(m AS DOUBLE) * pow(10.0, k)
                   ELSE CAST(m AS DOUBLE) / pow(10.0, -k) END AS step
            FROM {prefix}_k, (VALUES (1), (2), (5), (10), (20), (50)) AS t(m))""",
        f"""{prefix}_f AS (
            SELECT lo, hi, m, step, floor(lo / step) * step AS origin FROM {prefix}_c
            WHERE step >= raw AND floor(round((hi - floor(lo / step) * step) / step, 9)) + 1 <= {nbins})""",
        f"""{prefix}_p AS (
            SELECT step, origin, CAST(floor(round((hi - origin) / step, 9)) + 1 AS INTEGER) AS bins
            FROM (SELECT * FROM {prefix}_f ORDER BY m LIMIT 1)
            UNION ALL
            SELECT 1.0 AS step, lo AS origin, 1 AS bins FROM {prefix}_s WHERE hi = lo)""",
    ]


def _hist(value: str, nbins: int, src: str = "cleaned") -> str:
    return _with(*_bins(value, nbins, src), f"""counts AS (
        SELECT CAST(floor(round(({value} - origin) / step, 9)) AS INTEGER) AS bin, count(*) AS n
        FROM {src}, b_p WHERE {value} IS NOT NULL GROUP BY 1)""") + """
SELECT g.bin, round(origin + g.bin * step, 6) AS bin_start, round(origin + (g.bin + 1) * step, 6) AS bin_end,
       CAST(coalesce(counts.n, 0) AS BIGINT) AS n
FROM (SELECT step, origin, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM b_p) g
LEFT JOIN counts ON counts.bin = g.bin"""


def _corr(a: str, b: str) -> str:
    return (f"CASE WHEN isnan(corr({a}, {b})) THEN NULL "
            f"ELSE corr({a}, {b}) END")


_CURRENT_SESSION = f"""
  SELECT 5 AS batch_id, 'all' AS op, {ITEM_COLS} FROM cleaned WHERE {ALL_P}
  UNION ALL
  SELECT 6, 'select', {ITEM_COLS} FROM listed WHERE pos IN (1, 2, 3)
  UNION ALL
  SELECT 7, 'manual', * FROM (SELECT {MANUAL_ROW})"""

_LISTED = f"""{ORDERED},
listed AS (
  SELECT row_number() OVER (ORDER BY rn) AS pos, * EXCLUDE (rn)
  FROM (SELECT * FROM ordered WHERE {ALL_P} ORDER BY rn LIMIT 100))"""

def _quartiles(key: str = "clarity", value: str = "price", src: str = "cleaned") -> str:
    return f"""q AS (
  SELECT {key}, count(*) AS n,
    quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
  FROM {src} WHERE {value} IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)"""


SPIKED = """spiked AS (SELECT * REPLACE (CASE WHEN price % 97 = 0 THEN price * 20 ELSE price END AS price) FROM cleaned)"""
CENTS = "cents AS (SELECT * REPLACE (price + (price % 4) / 4.0::DOUBLE AS price) FROM cleaned)"
PARTLY = """partly AS (SELECT * REPLACE (CASE WHEN cut = 'Fair' OR color = 'D' OR clarity = 'IF' THEN NULL ELSE price END AS price)
  FROM cleaned)"""


def _ecdf_values(value: str, src: str = "cleaned") -> str:
    return _with(f"v AS (SELECT {value}, count(*) AS n FROM {src} WHERE {value} IS NOT NULL GROUP BY {value})") + f"""
SELECT {value}, n, CAST(sum(n) OVER (ORDER BY {value}) AS BIGINT) AS cum,
  round(CAST(sum(n) OVER (ORDER BY {value}) AS DOUBLE) / sum(n) OVER () * 100, 6) AS pct FROM v"""


def _quantiles(value: str, src: str = "cleaned") -> str:
    names = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 0.999}
    cols = ", ".join(f"round(quantile_cont(CAST({value} AS DOUBLE), {p}), 6) AS {name}" for name, p in names.items())
    return _with() + f"SELECT {cols} FROM {src}"


def _extreme(key: str, order: str, src: str = "p") -> str:
    """Key of the first row; rows without the ordered value don't count."""
    value = order.split()[0]
    return f"(SELECT {key} FROM {src} WHERE {value} IS NOT NULL ORDER BY {order}, {key} LIMIT 1)"


def _grouped_price(value: str) -> str:
    """'{:,}' of a number with cents: the shortest fraction, at least one digit."""
    return (f"format('{{:,}}', CAST(floor({value}) AS BIGINT)) || '.' || CASE {value} - floor({value}) "
            "WHEN 0 THEN '0' WHEN 0.25 THEN '25' WHEN 0.5 THEN '5' ELSE '75' END")


def _box(key: str = "clarity", value: str = "price", src: str = "cleaned", ctes: tuple[str, ...] = ()) -> str:
    return _with(*ctes, _quartiles(key, value, src)) + f"""SELECT f.{key}, f.n, round(q1, 6) AS q1,
  round(median, 6) AS median, round(q3, 6) AS q3, round(lower_fence, 6) AS lower_fence,
  round(upper_fence, 6) AS upper_fence,
  CAST(min({value}) FILTER (WHERE {value} >= lower_fence AND {value} <= upper_fence) AS DOUBLE) AS whisker_low,
  CAST(max({value}) FILTER (WHERE {value} >= lower_fence AND {value} <= upper_fence) AS DOUBLE) AS whisker_high,
  count(*) FILTER (WHERE {value} < lower_fence OR {value} > upper_fence) AS outliers
FROM f JOIN {src} c ON c.{key} = f.{key}
GROUP BY f.{key}, f.n, q1, median, q3, lower_fence, upper_fence"""


_QUART = _quartiles()

WIDE = """wide AS (SELECT *, floor(z / (x + y) * 20000) / 100 AS depth, 'lab ' || cut AS lab FROM cleaned)"""
OUT_OF_RANGE = """odd AS (SELECT * REPLACE (
  CASE WHEN price % 10 = 0 THEN price % 100 WHEN price % 10 = 5 THEN price * 1000 ELSE price END AS price,
  CASE WHEN price % 3 = 0 THEN CASE WHEN price % 2 = 0 THEN carat * 100 END ELSE carat END AS carat) FROM raw)"""


OFFSET = "shifted AS (SELECT * REPLACE (floor(carat * 16) / 16 + 1e8::DOUBLE AS carat, price + 1000000000 AS price) FROM cleaned)"


def _insight_fields(table: str = "cleaned", ctes: tuple[str, ...] = ()) -> str:
    """The bundles' fields in long form, from the same figures as the queries above."""
    rows: list[str] = []

    def add(kind: str, field: str, sql: str, key: str = "''", txt: bool = False, src: str = "cleaned", tail: str = "") -> None:
        num, text = ("CAST(NULL AS DOUBLE)", f"CAST({sql} AS VARCHAR)") if txt else (f"round(CAST({sql} AS DOUBLE), 6)", "CAST(NULL AS VARCHAR)")
        rows.append(f"SELECT '{kind} Analysis' AS analysis_type, '{field}' AS field, {key} AS key, {num} AS num, {text} AS txt FROM {src} {tail}")

    def one(kind: str, field: str, sql: str) -> None:  # a scalar subquery that gives a text
        add(kind, field, sql, txt=True, src="(SELECT 1)")

    for kind in ("Carat", "Cut", "Color", "Clarity", "Correlation"):
        add(kind, "total_diamonds", "count(*)")
    for field, sql in (("avg_carat", "avg(carat)"), ("median_carat", "median(carat)"), ("carat_std", "stddev_samp(carat)"),
                       ("small_diamonds_pct", _pct("carat <= 1.0")), ("large_diamonds_pct", _pct("carat >= 2.0")),
                       ("price_carat_correlation", _corr("price", "carat"))):
        add("Carat", field, sql)
    for i, sql in enumerate(("min(carat)", "max(carat)")):
        add("Carat", "carat_range", sql, f"'{i}'")
    for i, p in enumerate((0.25, 0.5, 0.75)):
        add("Carat", "carat_quartiles", f"quantile_cont(carat, {p})", f"'{i}'")
    for key in ("cut", "color", "clarity"):
        rows_of = f"WHERE {key} IS NOT NULL GROUP BY {key}"
        add(key.title(), f"{key}_distribution", "count(*)", key, tail=rows_of)
        src = f"(SELECT {key}, count(*) AS n, avg(price) AS m, avg(price) / avg(carat) AS ppc FROM cleaned {rows_of})"
        one(key.title(), f"most_common_{key}", _extreme(key, "n DESC", src))
        if key == "cut":
            one("Cut", "least_common_cut", f"(SELECT cut FROM {src} ORDER BY n, cut DESC LIMIT 1)")
            one("Cut", "lowest_priced_cut", _extreme(key, "m", src))
        if key != "color":
            one(key.title(), f"highest_priced_{key}", _extreme(key, "m DESC", src))
            add(key.title(), f"{key}_price_avg", "avg(price)", key, tail=rows_of)
        else:
            one("Color", "best_value_color", _extreme(key, "ppc DESC", src))
            for field, sql in (("avg_carat_by_color", "avg(carat)"), ("avg_price_by_color", "avg(price)"),
                               ("price_per_carat_by_color", "avg(price) / avg(carat)")):
                add("Color", field, sql, key, tail=rows_of)
    add("Cut", "premium_cuts_pct", _pct("cut IN ('Premium', 'Ideal')"))
    add("Color", "premium_colors_pct", _pct("color IN ('D', 'E', 'F')"))
    add("Clarity", "sweet_spot_clarity_pct", _pct("clarity IN ('SI1', 'VS2')"))
    add("Clarity", "premium_clarity_pct", _pct("clarity IN ('IF', 'VVS1', 'VVS2')"))
    for key, a, b in (("color", "J", "D"), ("clarity", "SI2", "VVS1")):
        add(key.title(), f"{key}_price_paradox",
            f"coalesce(avg(price) FILTER (WHERE {key} = '{a}') > avg(price) FILTER (WHERE {key} = '{b}'), false)", txt=True)
    for name, other in (("carat", "carat"), ("color", "color_numeric"), ("clarity", "clarity_numeric")):
        add("Correlation", f"price_{name}_corr", _corr("price", other))
    add("Correlation", "carat_dominates_pricing", f"coalesce(abs({_corr('price', 'carat')}) > 0.8, false)", txt=True)
    add("Correlation", "color_weak_correlation", f"coalesce(abs({_corr('price', 'color_numeric')}) < 0.3, false)", txt=True)
    return _with(*ctes) + "\nUNION ALL ".join(rows).replace("FROM cleaned", f"FROM {table}")


ORACLE: dict[str, str] = {
    "csv_round_trip": _with() + "SELECT * REPLACE (CASE WHEN color = 'K' THEN '1D' ELSE color END AS color) FROM cleaned",
    "csv_line_breaks": f"""WITH {RAW_SQL},
keyed AS (SELECT *, unnest(range(1, CASE WHEN l_orderkey % 50 = 0 THEN 3 ELSE 2 END)) AS copy FROM (
  SELECT b.*, CASE WHEN l_discount = 0 AND l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE carat * 2 + 1 END AS x,
         carat * 2 + 1.5 AS y, carat + 0.5 AS z FROM base b))
SELECT carat, CASE WHEN price % 3 = 0 THEN '"' || cut || '",' || chr(10) || chr(10) || color ELSE cut END AS cut,
  color, clarity, price, x, y, z, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, carat, price, cut NULLS FIRST, color, x) - 1 AS record FROM keyed""",
    "clean_whole": _with() + "SELECT * FROM cleaned",
    "valid_dims_all": f"""WITH {RAW_SQL}
SELECT * FROM (SELECT * REPLACE (CASE WHEN price % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE y END AS y,
                                 CASE WHEN price % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE z END AS z) FROM raw) r
WHERE x > 0 AND y > 0 AND z > 0""",
    "insight_fields": _insight_fields(),
    "insight_fields_offset": _insight_fields("shifted", (OFFSET,)),
    "insight_saved_fields": _insight_fields(),
    "insight_prompt_checks": _with() + """SELECT t.analysis_type, count(*) > 0 AS has_type, count(*) > 0 AS has_stats,
  count(*) > 0 AS has_sections
FROM cleaned, (VALUES ('Carat Analysis'), ('Cut Analysis'), ('Color Analysis'), ('Clarity Analysis'),
               ('Correlation Analysis')) AS t(analysis_type) GROUP BY 1""",
    "inv_wide": _with(WIDE) + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS}, depth, lab
FROM wide WHERE {ALL_P}
UNION ALL SELECT CAST(2 AS BIGINT), 'manual', *, NULL, NULL FROM (SELECT {MANUAL_ROW})""",
    "inv_row_identity": _with(WIDE, f"w AS (SELECT * FROM wide WHERE {ALL_P})") + f"""SELECT 'items' AS what, count(*) AS n FROM w
UNION ALL SELECT 'keys', count(*) FROM (SELECT DISTINCT * FROM w)
UNION ALL SELECT 'picked again', count(*) FROM wide WHERE {PRICE_P} AND {CARAT_P} AND {MEMBER_P}""",
    "inv_fractional": _with(CENTS) + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS}
FROM cents WHERE floor(price) BETWEEN 1000 AND 5000 AND {CARAT_P} AND {MEMBER_P}
UNION ALL SELECT CAST(2 AS BIGINT), 'manual', * REPLACE (12000.5::DOUBLE AS price) FROM (SELECT {MANUAL_ROW})""",
    "inv_fractional_totals": _with(CENTS, f"""cur AS (SELECT price FROM cents
  WHERE floor(price) BETWEEN 1000 AND 5000 AND {CARAT_P} AND {MEMBER_P} UNION ALL SELECT 12000.5::DOUBLE)""") + """SELECT
  count(*) AS items, round(sum(price), 6) AS total_value, round(avg(price), 6) AS avg_price FROM cur""",
    "inv_export": _with(_LISTED, f"cur AS ({_CURRENT_SESSION})") + """SELECT carat, cut, color, clarity, price, x, y, z,
  CAST(color_numeric AS BIGINT) AS color_numeric, CAST(clarity_numeric AS BIGINT) AS clarity_numeric, cut_gia FROM cur""",
    "na_tokens": f"""WITH {RAW_SQL}
SELECT CASE WHEN price % 10 IN (0, 1, 2, 3) THEN NULL ELSE carat END AS carat,
       cut, color, clarity, price, x, y, z FROM raw""",
    "dedup_rows": _with() + "SELECT * FROM dedup",
    "drop_missing": _with() + "SELECT * FROM nonnull",
    "valid_dims": _with() + "SELECT * FROM validdims",
    "color_ordinal": _with() + "SELECT color, color_numeric, count(*) AS n FROM cleaned GROUP BY 1, 2",
    "clarity_ordinal": _with() + "SELECT clarity, clarity_numeric, count(*) AS n FROM cleaned GROUP BY 1, 2",
    "cut_lab_grade": _with() + "SELECT cut, cut_gia, count(*) AS n FROM cleaned GROUP BY 1, 2",
    "unmapped_grades": _with() + """SELECT * FROM cleaned
WHERE color_numeric IS NULL OR clarity_numeric IS NULL OR cut_gia IS NULL""",
    "clean_rows": _with() + "SELECT * FROM cleaned",
    "quality_report": _with() + """SELECT count(*) AS rows, 11 AS columns,
  CAST(count(*) FILTER (WHERE carat IS NULL) + count(*) FILTER (WHERE cut IS NULL)
     + count(*) FILTER (WHERE color IS NULL) + count(*) FILTER (WHERE clarity IS NULL)
     + count(*) FILTER (WHERE price IS NULL) + count(*) FILTER (WHERE x IS NULL)
     + count(*) FILTER (WHERE y IS NULL) + count(*) FILTER (WHERE z IS NULL)
     + count(*) FILTER (WHERE color_numeric IS NULL) + count(*) FILTER (WHERE clarity_numeric IS NULL)
     + count(*) FILTER (WHERE cut_gia IS NULL) AS BIGINT) AS missing_values
FROM cleaned""",
    "preview": _with(ORDERED) + "SELECT * EXCLUDE (rn) FROM ordered ORDER BY rn LIMIT 5",
    "filter_price": _with() + f"SELECT * FROM cleaned WHERE {PRICE_P}",
    "filter_carat": _with() + f"SELECT * FROM cleaned WHERE {CARAT_P}",
    "filter_members": _with() + f"SELECT * FROM cleaned WHERE {MEMBER_P}",
    "filter_all": _with() + f"SELECT * FROM cleaned WHERE {ALL_P}",
    "filter_bounds": _with() + """SELECT CAST(floor(min(price)) AS BIGINT) AS price_min,
  CAST(floor(max(price)) AS BIGINT) AS price_max, min(carat) AS carat_min, max(carat) AS carat_max
FROM cleaned""",
    "filter_options": _with(ORDERED) + """SELECT 'color' AS dimension, color AS value, CAST(row_number() OVER (ORDER BY color) AS INTEGER) AS place
FROM ordered GROUP BY color
UNION ALL SELECT 'clarity', clarity, CAST(row_number() OVER (ORDER BY min(rn)) AS INTEGER) FROM ordered GROUP BY clarity
UNION ALL SELECT 'cut', cut, CAST(row_number() OVER (ORDER BY min(rn)) AS INTEGER) FROM ordered GROUP BY cut""",
    "filter_counts": _with() + f"""SELECT count(*) FILTER (WHERE {ALL_P}) AS n_filtered, count(*) AS n_total
FROM cleaned""",
    "available_top100": _with(_LISTED) + "SELECT pos, carat, cut, color, clarity, price FROM listed",
    "item_label": _with(_LISTED) + """SELECT pos,
  'Diamond ' || CAST(pos AS VARCHAR) || ': ' || format('{:.2f}', carat) || 'ct, ' || color || '-' || clarity
  || ', $' || format('{:,}', price) AS label
FROM listed""",
    "overview_metrics": _with() + """SELECT count(*) AS total_diamonds, round(avg(price), 6) AS avg_price,
  round(avg(carat), 6) AS avg_carat, min(price) AS min_price, max(price) AS max_price FROM cleaned""",
    "overview_labels": _with() + """SELECT format('{:,}', count(*)) AS total_label,
  '$' || format('{:,.0f}', avg(price)) AS avg_price_label,
  format('{:.2f}', avg(carat)) AS avg_carat_label,
  '$' || format('{:,}', min(price)) || ' - $' || format('{:,}', max(price)) AS price_range_label
FROM cleaned""",
    "carat_stats": _with() + f"""SELECT round(avg(carat), 6) AS avg_carat, round(median(carat), 6) AS median_carat,
  round(stddev_samp(carat), 6) AS carat_std, min(carat) AS min_carat, max(carat) AS max_carat,
  round(quantile_cont(carat, 0.25), 6) AS q25, round(quantile_cont(carat, 0.5), 6) AS q50,
  round(quantile_cont(carat, 0.75), 6) AS q75,
  round({_corr('price', 'carat')}, 6) AS price_carat_corr
FROM cleaned""",
    "carat_shares": _with() + f"""SELECT {_pct('carat <= 1.0')} AS small_diamonds_pct,
  {_pct('carat >= 2.0')} AS large_diamonds_pct FROM cleaned""",
    "cut_counts": _with() + "SELECT cut, count(*) AS n FROM cleaned WHERE cut IS NOT NULL GROUP BY cut",
    "cut_extremes": _with("""p AS (SELECT cut, count(*) AS n, avg(price) AS m FROM cleaned
  WHERE cut IS NOT NULL GROUP BY cut)""") + """SELECT
  (SELECT cut FROM p ORDER BY n DESC, cut LIMIT 1) AS most_common_cut,
  (SELECT cut FROM p ORDER BY n ASC, cut DESC LIMIT 1) AS least_common_cut,
  (SELECT cut FROM p ORDER BY m DESC, cut LIMIT 1) AS highest_priced_cut,
  (SELECT cut FROM p ORDER BY m ASC, cut LIMIT 1) AS lowest_priced_cut""",
    "cut_avg_price": _with() + """SELECT cut, round(avg(price), 6) AS avg_price FROM cleaned
WHERE cut IS NOT NULL GROUP BY cut""",
    "cut_premium_share": _with() + f"""SELECT {_pct("cut IN ('Premium', 'Ideal')")} AS premium_cuts_pct
FROM cleaned""",
    "color_counts": _with() + "SELECT color, count(*) AS n FROM cleaned WHERE color IS NOT NULL GROUP BY color",
    "color_profile": _with() + """SELECT color, count(*) AS n, round(avg(carat), 6) AS avg_carat,
  round(avg(price), 6) AS avg_price, round(avg(price) / avg(carat), 6) AS price_per_carat
FROM cleaned WHERE color IS NOT NULL GROUP BY color""",
    "color_extremes": _with("""p AS (SELECT color, count(*) AS n, avg(price) / avg(carat) AS ppc FROM cleaned
  WHERE color IS NOT NULL GROUP BY color)""") + """SELECT
  (SELECT color FROM p ORDER BY n DESC, color LIMIT 1) AS most_common_color,
  (SELECT color FROM p ORDER BY ppc DESC, color LIMIT 1) AS best_value_color""",
    "cut_extremes_partly_priced": _with(PARTLY, "p AS (SELECT cut, count(*) AS n, avg(price) AS m FROM partly GROUP BY cut)") + f"""SELECT
  {_extreme('cut', 'n DESC')} AS most_common_cut,
  (SELECT cut FROM p ORDER BY n ASC, cut DESC LIMIT 1) AS least_common_cut,
  {_extreme('cut', 'm DESC')} AS highest_priced_cut, {_extreme('cut', 'm ASC')} AS lowest_priced_cut""",
    "color_extremes_partly_priced": _with(PARTLY, """p AS (SELECT color, count(*) AS n, avg(price) / avg(carat) AS ppc
  FROM partly GROUP BY color)""") + f"""SELECT
  {_extreme('color', 'n DESC')} AS most_common_color, {_extreme('color', 'ppc DESC')} AS best_value_color""",
    "clarity_extremes_partly_priced": _with(PARTLY, "p AS (SELECT clarity, count(*) AS n, avg(price) AS m FROM partly GROUP BY clarity)")
    + f"""SELECT {_extreme('clarity', 'n DESC')} AS most_common_clarity,
  {_extreme('clarity', 'm DESC')} AS highest_priced_clarity""",
    "overview_labels_cents": _with(CENTS) + f"""SELECT format('{{:,}}', count(*)) AS total_label,
  '$' || format('{{:,.0f}}', avg(price)) AS avg_price_label,
  format('{{:.2f}}', avg(carat)) AS avg_carat_label,
  '$' || {_grouped_price('min(price)')} || ' - $' || {_grouped_price('max(price)')} AS price_range_label
FROM cents""",
    "item_label_cents": _with(ORDERED, f"""listed AS (SELECT row_number() OVER (ORDER BY rn) AS pos, * FROM (
  SELECT * REPLACE (price + (price % 4) / 4.0::DOUBLE AS price) FROM ordered WHERE {ALL_P} ORDER BY rn LIMIT 100))""")
    + f"""SELECT pos,
  'Diamond ' || CAST(pos AS VARCHAR) || ': ' || format('{{:.2f}}', carat) || 'ct, ' || color || '-' || clarity
  || ', $' || {_grouped_price('price')} AS label
FROM listed""",
    "color_premium_share": _with() + f"""SELECT {_pct("color IN ('D', 'E', 'F')")} AS premium_colors_pct
FROM cleaned""",
    "price_paradoxes": _with() + """SELECT
  coalesce(avg(price) FILTER (WHERE color = 'J') > avg(price) FILTER (WHERE color = 'D'), false)
    AS color_price_paradox,
  coalesce(avg(price) FILTER (WHERE clarity = 'SI2') > avg(price) FILTER (WHERE clarity = 'VVS1'), false)
    AS clarity_price_paradox
FROM cleaned""",
    "clarity_counts": _with() + """SELECT clarity, count(*) AS n FROM cleaned WHERE clarity IS NOT NULL
GROUP BY clarity""",
    "clarity_extremes": _with("""p AS (SELECT clarity, count(*) AS n, avg(price) AS m FROM cleaned
  WHERE clarity IS NOT NULL GROUP BY clarity)""") + """SELECT
  (SELECT clarity FROM p ORDER BY n DESC, clarity LIMIT 1) AS most_common_clarity,
  (SELECT clarity FROM p ORDER BY m DESC, clarity LIMIT 1) AS highest_priced_clarity""",
    "clarity_shares": _with() + f"""SELECT {_pct("clarity IN ('SI1', 'VS2')")} AS sweet_spot_clarity_pct,
  {_pct("clarity IN ('IF', 'VVS1', 'VVS2')")} AS premium_clarity_pct FROM cleaned""",
    "clarity_avg_price": _with() + """SELECT clarity, round(avg(price), 6) AS avg_price FROM cleaned
WHERE clarity IS NOT NULL GROUP BY clarity""",
    "hist_carat": _hist("carat", 30),
    "hist_price": _hist("price", 50),
    "ecdf_rows": _with() + """SELECT carat, row_number() OVER (ORDER BY carat) AS position,
  round(CAST(row_number() OVER (ORDER BY carat) AS DOUBLE) / count(*) OVER () * 100, 6) AS pct
FROM cleaned WHERE carat IS NOT NULL""",
    "ecdf_values": _with("""v AS (SELECT carat, count(*) AS n FROM cleaned WHERE carat IS NOT NULL GROUP BY carat)""")
    + """SELECT carat, n, CAST(sum(n) OVER (ORDER BY carat) AS BIGINT) AS cum,
  round(CAST(sum(n) OVER (ORDER BY carat) AS DOUBLE) / sum(n) OVER () * 100, 6) AS pct FROM v""",
    "ecdf_thresholds": _with(
        """v AS (SELECT carat, count(*) AS n FROM cleaned WHERE carat IS NOT NULL GROUP BY carat)""",
        """c AS (SELECT carat, CAST(sum(n) OVER (ORDER BY carat) AS DOUBLE) / sum(n) OVER () * 100 AS pct FROM v)""")
    + """SELECT min(carat) FILTER (WHERE pct >= 80) AS carat_at_pct_line,
  round(coalesce(max(pct) FILTER (WHERE carat <= 1.2), 0.0), 6) AS pct_at_value_line FROM c""",
    "box_price_by_clarity": _box(),
    "box_outliers": _with(_QUART) + f"""SELECT c.*, f.lower_fence, f.upper_fence
FROM cleaned c JOIN f ON c.clarity = f.clarity
WHERE c.price < f.lower_fence OR c.price > f.upper_fence""",
    "scatter_points": _with() + "SELECT carat, price FROM cleaned",
    "ecdf_price_values": _ecdf_values("price"),
    "ecdf_retail_values": _ecdf_values("p_retailprice", "part"),
    "price_quartiles": _quantiles("price"),
    "retail_quartiles": _quantiles("p_retailprice", "part"),
    "box_spiked_by_clarity": _box(src="spiked", ctes=(SPIKED,)),
    "box_outliers_spiked": _with(SPIKED, _quartiles(src="spiked")) + """SELECT c.*, f.lower_fence, f.upper_fence
FROM spiked c JOIN f ON c.clarity = f.clarity
WHERE c.price < f.lower_fence OR c.price > f.upper_fence""",
    "scatter_density": _with(*_bins("carat", 30, prefix="x"), *_bins("price", 50, prefix="y")) + """SELECT
  CAST(floor(round((carat - x_p.origin) / x_p.step, 9)) AS INTEGER) AS carat_bin,
  CAST(floor(round((price - y_p.origin) / y_p.step, 9)) AS INTEGER) AS price_bin,
  round(x_p.origin + CAST(floor(round((carat - x_p.origin) / x_p.step, 9)) AS INTEGER) * x_p.step, 6) AS carat_start,
  round(y_p.origin + CAST(floor(round((price - y_p.origin) / y_p.step, 9)) AS INTEGER) * y_p.step, 6) AS price_start,
  count(*) AS n
FROM cleaned, x_p, y_p WHERE carat IS NOT NULL AND price IS NOT NULL
GROUP BY 1, 2, 3, 4""",
    "corr_matrix": _with("""m AS (SELECT
  corr(price, carat) AS pc, corr(price, color_numeric) AS pcol, corr(price, clarity_numeric) AS pcl,
  corr(carat, color_numeric) AS ccol, corr(carat, clarity_numeric) AS ccl,
  corr(color_numeric, clarity_numeric) AS colcl,
  var_samp(price) AS vp, var_samp(carat) AS vc, var_samp(color_numeric) AS vcol,
  var_samp(clarity_numeric) AS vcl FROM cleaned)""",
        """cells AS (
  SELECT 'price' AS var_x, 'price' AS var_y, CASE WHEN vp > 0 THEN 1.0 END AS r FROM m
  UNION ALL SELECT 'price', 'carat', pc FROM m UNION ALL SELECT 'carat', 'price', pc FROM m
  UNION ALL SELECT 'price', 'color_numeric', pcol FROM m UNION ALL SELECT 'color_numeric', 'price', pcol FROM m
  UNION ALL SELECT 'price', 'clarity_numeric', pcl FROM m UNION ALL SELECT 'clarity_numeric', 'price', pcl FROM m
  UNION ALL SELECT 'carat', 'carat', CASE WHEN vc > 0 THEN 1.0 END FROM m
  UNION ALL SELECT 'carat', 'color_numeric', ccol FROM m UNION ALL SELECT 'color_numeric', 'carat', ccol FROM m
  UNION ALL SELECT 'carat', 'clarity_numeric', ccl FROM m UNION ALL SELECT 'clarity_numeric', 'carat', ccl FROM m
  UNION ALL SELECT 'color_numeric', 'color_numeric', CASE WHEN vcol > 0 THEN 1.0 END FROM m
  UNION ALL SELECT 'color_numeric', 'clarity_numeric', colcl FROM m
  UNION ALL SELECT 'clarity_numeric', 'color_numeric', colcl FROM m
  UNION ALL SELECT 'clarity_numeric', 'clarity_numeric', CASE WHEN vcl > 0 THEN 1.0 END FROM m)""")
    + """SELECT var_x, var_y, round(CASE WHEN isnan(CAST(r AS DOUBLE)) THEN NULL ELSE CAST(r AS DOUBLE) END, 6) AS r
FROM cells""",
    "corr_flags": _with(f"""m AS (SELECT {_corr('price', 'carat')} AS pc, {_corr('price', 'color_numeric')} AS pcol,
  {_corr('price', 'clarity_numeric')} AS pcl FROM cleaned)""") + """SELECT round(pc, 6) AS price_carat_corr,
  round(pcol, 6) AS price_color_corr, round(pcl, 6) AS price_clarity_corr,
  coalesce(abs(pc) > 0.8, false) AS carat_dominates_pricing,
  coalesce(abs(pcol) < 0.3, false) AS color_weak_correlation FROM m""",
    "corr_labels": _with(f"""m AS (SELECT {_corr('price', 'carat')} AS pc, {_corr('price', 'color_numeric')} AS pcol,
  {_corr('price', 'clarity_numeric')} AS pcl FROM cleaned)""",
        """l AS (
  SELECT 'carat' AS variable, 'Carat vs Price correlation' AS title, 'Very Strong' AS label, pc AS r FROM m
  UNION ALL SELECT 'color_numeric', 'Color vs Price correlation', 'Weak', pcol FROM m
  UNION ALL SELECT 'clarity_numeric', 'Clarity vs Price correlation', 'Moderate', pcl FROM m)""")
    + """SELECT variable,
  title || ': ' || coalesce(format('{:.3f}', r), 'nan') || ' (' || label || ')' AS line, label,
  CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.3 THEN 'Moderate'
       WHEN r IS NOT NULL THEN 'Weak' END AS strength
FROM l""",
    "inv_add_selected": _with(_LISTED) + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'select' AS op, {ITEM_COLS}
FROM listed WHERE pos IN (1, 2, 5, 10, 50, 100)""",
    "inv_add_filtered": _with() + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS}
FROM cleaned WHERE {ALL_P}""",
    "inv_add_manual": _with() + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS}
FROM cleaned WHERE {PRICE_P}
UNION ALL SELECT CAST(2 AS BIGINT), 'manual', * FROM (SELECT {MANUAL_ROW})""",
    "inv_validate": f"""WITH {RAW_SQL}
SELECT carat, cut, color, clarity, price,
  coalesce(carat BETWEEN 0.1 AND 10.0, false) AND coalesce(price BETWEEN 100 AND 100000, false)
    AND coalesce(cut IN ('Ideal', 'Premium', 'Very Good', 'Good', 'Fair'), false)
    AND coalesce(color IN ('D', 'E', 'F', 'G', 'H', 'I', 'J'), false)
    AND coalesce(clarity IN ('IF', 'VVS1', 'VVS2', 'VS1', 'VS2', 'SI1', 'SI2', 'I1'), false) AS valid,
  nullif(concat_ws('; ',
    CASE WHEN NOT coalesce(carat BETWEEN 0.1 AND 10.0, false) THEN 'carat out of range' END,
    CASE WHEN NOT coalesce(price BETWEEN 100 AND 100000, false) THEN 'price out of range' END,
    CASE WHEN NOT coalesce(cut IN ('Ideal', 'Premium', 'Very Good', 'Good', 'Fair'), false) THEN 'unknown cut' END,
    CASE WHEN NOT coalesce(color IN ('D', 'E', 'F', 'G', 'H', 'I', 'J'), false) THEN 'unknown color' END,
    CASE WHEN NOT coalesce(clarity IN ('IF', 'VVS1', 'VVS2', 'VS1', 'VS2', 'SI1', 'SI2', 'I1'), false)
         THEN 'unknown clarity' END), '') AS reason
FROM raw""",
    "inv_bag": _with() + f"""SELECT CAST(1 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS} FROM cleaned WHERE {MEMBER_P}
UNION ALL
SELECT CAST(2 AS BIGINT) AS batch_id, 'all' AS op, {ITEM_COLS} FROM cleaned WHERE {MEMBER_P}""",
    "inv_totals": _with(_LISTED, f"cur AS ({_CURRENT_SESSION})") + """SELECT count(*) AS items,
  CAST(sum(price) AS BIGINT) AS total_value, round(avg(price), 6) AS avg_price FROM cur""",
    "part_brand_profile": """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS avg_p_retailprice
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""",
    "part_price_hist": _hist("p_retailprice", 30, "part"),
    "part_price_box_by_type": _box("p_type", "p_retailprice", "part"),
    "inv_current": _with(_LISTED, f"cur AS ({_CURRENT_SESSION})") + """SELECT CAST(batch_id AS BIGINT) AS batch_id,
  op, carat, cut, color, clarity, price, x, y, z, color_numeric, clarity_numeric, cut_gia FROM cur""",
}
# the same checks over listings whose prices and carats go out of range
ORACLE["inv_validate_ranges"] = (ORACLE["inv_validate"].replace("FROM raw", "FROM odd")
                                 .replace(RAW_SQL, f"{RAW_SQL},\n{OUT_OF_RANGE}"))

ORACLE["corr_matrix_offset"] = (ORACLE["corr_matrix"].replace("m AS (SELECT", f"{OFFSET},\nm AS (SELECT", 1)
                                .replace("vcl FROM cleaned", "vcl FROM shifted"))

ORACLE["inv_numbered"] = _with(_LISTED) + f"""SELECT row_number() OVER (ORDER BY batch_id, seq) - 1 AS no, {ITEM_COLS} FROM (
  SELECT 5 AS batch_id, rn AS seq, {ITEM_COLS} FROM ordered WHERE {ALL_P}
  UNION ALL SELECT 6, pos, {ITEM_COLS} FROM listed WHERE pos IN (1, 2, 3)
  UNION ALL SELECT 7, 0, * FROM (SELECT {MANUAL_ROW}))"""
ORACLE["inv_stored_numbered"] = ORACLE["inv_numbered"]
ORACLE["inv_stored_totals"] = ORACLE["inv_totals"]
ORACLE["sketch_quantiles"] = _with() + """SELECT clarity, CAST(p AS DOUBLE) AS p, count(*) AS n, true AS within
FROM cleaned, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) AS t(p) GROUP BY 1, 2"""
ORACLE["corr_skipped"] = _with() + "SELECT color AS var_x, color AS var_y, CAST(price AS DOUBLE) AS r FROM cleaned WHERE false"
ORACLE["filter_counts_cube"] = ORACLE["filter_counts"]
