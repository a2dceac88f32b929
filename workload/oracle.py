"""The registered queries as SQL over the given tables.

Written apart from the library: no text here is built from its column lists or word lists, so a
slip there does not repeat itself here.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

FACT = """
fact AS (
  SELECT p_brand AS brand, p_type AS segment, p_name AS model,
    CASE month(l_shipdate) WHEN 1 THEN 'jan' WHEN 2 THEN 'feb' WHEN 3 THEN 'mar'
      WHEN 4 THEN 'apr' WHEN 5 THEN 'may' WHEN 6 THEN 'jun' WHEN 7 THEN 'jul'
      WHEN 8 THEN 'aug' WHEN 9 THEN 'sep' WHEN 10 THEN 'oct' WHEN 11 THEN 'nov'
      ELSE 'dec' END AS month,
    CASE WHEN l_returnflag = 'A' THEN 'wholesales' WHEN l_returnflag = 'N' THEN 'retail_sales'
      WHEN l_linestatus = 'F' THEN 'production_ckd' ELSE 'import_cbu' END AS sales_type,
    CAST(sum(l_quantity) AS BIGINT) AS sales,
    CAST(year(l_shipdate) AS INT) AS year,
    false AS is_summary,
    CAST(-1 AS BIGINT) AS row_index,
    concat('VR', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS vr_id,
    CAST(1000 + p_size * 100 AS VARCHAR) AS cc,
    CASE p_partkey % 3 WHEN 0 THEN 'Manual' WHEN 1 THEN 'Automatic' ELSE 'AMT' END AS transmission,
    CASE p_partkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Petrol' WHEN 2 THEN 'Hybrid'
      ELSE 'Electric' END AS fuel,
    concat(CAST(p_size AS VARCHAR), 'T') AS gvw,
    concat(CAST(60 + p_size * 5 AS VARCHAR), 'HP') AS ps_hp,
    concat(CAST(3000 + p_size * 50 AS VARCHAR), 'x', CAST(1500 + p_size * 10 AS VARCHAR), 'x',
      CAST(1400 + p_size * 20 AS VARCHAR)) AS dimension,
    CASE p_partkey % 6 WHEN 0 THEN '2 Seater' WHEN 1 THEN '7 Seater' WHEN 2 THEN '20+ Seater'
      ELSE '5 Seater' END AS seater,
    CASE p_partkey % 5 WHEN 0 THEN '4x4' WHEN 1 THEN '6x4' ELSE '4x2' END AS wheel,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(20 + p_size AS VARCHAR) END AS tank,
    CASE WHEN p_partkey % 11 = 0 THEN ''
      ELSE concat(CAST(4 + p_partkey % 5 AS VARCHAR), '-speed') END AS gear,
    CASE p_partkey % 2 WHEN 0 THEN 'FF' ELSE 'FR' END AS system,
    CAST(90 + p_size AS VARCHAR) AS speed,
    CASE p_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '5' END AS door,
    p_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY p_brand, p_type, p_name, p_partkey, p_size, year(l_shipdate), month(l_shipdate),
    CASE WHEN l_returnflag = 'A' THEN 'wholesales' WHEN l_returnflag = 'N' THEN 'retail_sales'
      WHEN l_linestatus = 'F' THEN 'production_ckd' ELSE 'import_cbu' END
)"""

TOTALS = """
total AS (
  SELECT brand, concat('TOTAL ', brand) AS segment, concat('TOTAL ', brand) AS model,
    'all' AS month, sales_type, CAST(sum(sales) AS BIGINT) AS sales, year, true AS is_summary,
    CAST(-1 AS BIGINT) AS row_index,
    concat('TOTAL_', brand, '_', CAST(year AS VARCHAR), '_', sales_type) AS vr_id,
    '' AS cc, '' AS transmission, '' AS fuel, '' AS gvw, '' AS ps_hp, '' AS dimension,
    '' AS seater, '' AS wheel, CAST(NULL AS VARCHAR) AS tank, CAST(NULL AS VARCHAR) AS gear,
    CAST(NULL AS VARCHAR) AS system, CAST(NULL AS VARCHAR) AS speed, CAST(NULL AS VARCHAR) AS door
  FROM fact GROUP BY brand, year, sales_type
),
master AS (
  SELECT * EXCLUDE (p_partkey) FROM fact UNION ALL BY NAME SELECT * FROM total
)"""


def on_fact(name: str, sql: str) -> None:
    ORACLE[name] = f"WITH {FACT}\n{sql.strip()}"


def on_master(name: str, sql: str) -> None:
    ORACLE[name] = f"WITH {FACT},{TOTALS}\n{sql.strip()}"


# --- totals and views ---------------------------------------------------------------------
on_master("summary_totals", "SELECT * FROM total")
on_master("master_with_totals", "SELECT * FROM master")
on_master("view_summary", "SELECT * EXCLUDE (is_summary, row_index) FROM total")
on_master("view_detailed",
          "SELECT * EXCLUDE (is_summary, row_index) FROM master WHERE NOT is_summary")
_MONTHLY = """
SELECT brand, segment, month, sales_type, year, CAST(sum(sales) AS BIGINT) AS sales,
  month = 'all' AS is_total
FROM master GROUP BY brand, segment, month, sales_type, year"""
on_master("view_monthly", _MONTHLY)
on_master("master_grouping_sets", _MONTHLY)
on_fact("view_brand_comparison", """
SELECT brand, sales_type, year, CAST(sum(sales) AS BIGINT) AS sales
FROM fact GROUP BY brand, sales_type, year""")
on_master("view_brand_comparison_compat", """
SELECT brand, sales_type, year, CAST(sum(sales) AS BIGINT) AS sales
FROM master GROUP BY brand, sales_type, year""")
on_master("view_specs_only", """
SELECT DISTINCT brand, segment, model, year, month, vr_id, cc, transmission, fuel, gvw, wheel,
  ps_hp, dimension, seater FROM master""")
on_master("view_sales_only", """
SELECT brand, segment, model, year, month, sales_type, sales, is_summary, vr_id FROM master""")
on_master("integrity_record", """
, specs AS (SELECT DISTINCT brand, segment, model, year, month, vr_id, cc, transmission, fuel, gvw,
    wheel, ps_hp, dimension, seater FROM master)
SELECT '2025-01-01T00:00:00' AS created_at,
  (SELECT count(*) FROM specs) AS specs_records,
  count(*) AS sales_records, count(*) AS master_records,
  sum(sales) FILTER (WHERE is_summary) = sum(sales) FILTER (WHERE NOT is_summary)
    AS data_integrity_check,
  round(CAST((SELECT count(*) FROM specs) AS DOUBLE) / count(*) * 100, 6) AS specs_coverage,
  string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands_covered,
  string_agg(DISTINCT sales_type, ',' ORDER BY sales_type) AS sales_types
FROM master""")
on_fact("processing_summary", """
SELECT count(*) AS total_records, count(DISTINCT brand) AS brands,
  count(DISTINCT model) AS unique_models,
  string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years
FROM fact""")
on_fact("processing_by_brand", """
SELECT brand, count(sales) AS record_count, CAST(sum(sales) AS BIGINT) AS total_sales,
  count(DISTINCT model) AS unique_models FROM fact GROUP BY brand""")
on_master("sink_roundtrip", """
SELECT brand, sales_type, year, CAST(sum(sales) AS BIGINT) AS sales
FROM fact GROUP BY brand, sales_type, year
UNION ALL
SELECT 'recorded', 'rows', CAST(NULL AS INT), count(*) FROM master""")

on_master("export_roundtrip", f"""
, monthly AS ({_MONTHLY}),
comparison AS (SELECT brand, sales_type, year, sum(sales) AS sales FROM fact GROUP BY ALL),
specs AS (SELECT DISTINCT brand, segment, model, year, month, vr_id, cc, transmission, fuel, gvw,
  wheel, ps_hp, dimension, seater FROM master),
listed AS (
  SELECT 'master' AS table_name, brand, sales FROM master
  UNION ALL SELECT 'sales_only', brand, sales FROM master
  UNION ALL SELECT 'summary', brand, sales FROM total
  UNION ALL SELECT 'detailed', brand, sales FROM fact
  UNION ALL SELECT 'monthly', brand, sales FROM monthly
  UNION ALL SELECT 'brand_comparison', brand, sales FROM comparison
  UNION ALL SELECT 'specs_only', brand, NULL FROM specs
)
SELECT table_name, count(*) AS n_rows, count(DISTINCT brand) AS brands,
  CAST(sum(sales) AS BIGINT) AS sales FROM listed GROUP BY table_name""")
_AGGREGATES = "\n  UNION ALL\n  ".join(
    f"""SELECT '{name}' AS question, brand, sales_type, month, CAST({name}(sales) AS DOUBLE) AS sales FROM figures
  WHERE month IN ('jan', 'jul') AND segment IN ('ECONOMY', 'PROMO') GROUP BY ALL"""
    for name in ("sum", "avg", "count", "min", "max"))
on_fact("stored_aggregates", f"""
, figures AS (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN concat('00', CAST(p_partkey % 3 AS VARCHAR)) ELSE brand END
      AS brand, CASE WHEN p_partkey % 7 > 0 THEN segment END AS segment,
    CASE WHEN p_partkey % 11 > 0 THEN month END AS month, sales_type,
    CASE WHEN p_partkey % 13 > 0 THEN sales END AS sales FROM fact
),
asked AS (
  {_AGGREGATES}
)
SELECT source, question, brand, sales_type, month, round(sales, 6) AS sales
FROM asked CROSS JOIN (VALUES ('stored'), ('derived')) AS s(source)""")
on_fact("stored_equals_derived", """
, odd AS (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN concat('00', CAST(p_partkey % 3 AS VARCHAR)) ELSE brand END
      AS brand, CASE WHEN p_partkey % 7 > 0 THEN segment END AS segment,
    CASE WHEN p_partkey % 11 > 0 THEN month END AS month, sales_type, year, sales FROM fact
),
asked AS (
  SELECT 'trend' AS question, brand, sales_type, month, sum(sales) AS sales FROM (
    SELECT brand, concat('TOTAL ', brand) AS segment, month, sales_type, sales FROM odd)
  WHERE month IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'default', brand, sales_type, month, sum(sales) FROM odd
  WHERE month IN ('jan', 'jul') GROUP BY ALL
  UNION ALL
  SELECT 'years', brand, sales_type, month, sum(sales) FROM odd
  WHERE year = 1997 AND segment = 'ECONOMY' AND month IS NOT NULL GROUP BY ALL
)
SELECT source, question, brand, sales_type, month, CAST(sales AS BIGINT) AS sales
FROM asked CROSS JOIN (VALUES ('stored'), ('derived')) AS s(source)""")

# --- filters ------------------------------------------------------------------------------
_BY_BRAND = "SELECT brand, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS sales FROM"
on_fact("filter_in", f"""{_BY_BRAND} fact
WHERE brand IN ('Brand#11', 'Brand#22', 'Brand#5') AND sales_type IN ('wholesales', 'import_cbu')
GROUP BY brand""")
on_fact("filter_month", f"""{_BY_BRAND} fact
WHERE month IN ('jan', 'jun', 'dec') GROUP BY brand""")
on_fact("filter_segment", f"""{_BY_BRAND} fact
WHERE segment IN ('ECONOMY', 'PROMO') GROUP BY brand""")
on_fact("filter_year", f"{_BY_BRAND} fact WHERE year IN (1996, 1999) GROUP BY brand")
on_fact("filter_model_regex", f"""{_BY_BRAND} fact
WHERE starts_with(lower(model), 'red') OR lower(model) LIKE '%widget' GROUP BY brand""")
on_fact("filter_tech_exact", f"""{_BY_BRAND} fact
WHERE fuel IN ('Diesel', 'Hybrid') AND system = 'FF' GROUP BY brand""")
on_fact("filter_tech_contains", f"""{_BY_BRAND} fact
WHERE (ps_hp ILIKE '%10hp%' OR ps_hp LIKE '%85%') AND regexp_matches(dimension, 'x1[57]')
GROUP BY brand""")
on_master("filter_total", f"""{_BY_BRAND} master
WHERE upper(segment) LIKE '%TOTAL%' GROUP BY brand""")
on_fact("filter_all", """
SELECT brand, sales_type, month, CAST(sum(sales) AS BIGINT) AS sales FROM fact
WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')
  AND sales_type IN ('wholesales', 'retail_sales') AND month IN ('jan', 'feb', 'mar')
  AND segment IN ('ECONOMY', 'STANDARD', 'LARGE') AND year IN (1996, 1997, 1998)
  AND regexp_matches(lower(model), 'red|new|old') AND fuel = 'Diesel' AND cc LIKE '%00%'
GROUP BY brand, sales_type, month""")

# --- structured queries -------------------------------------------------------------------
_BEST = """
SELECT CAST(row_number() OVER (ORDER BY sales DESC, model) AS INT) AS rank, model, brand, segment,
  vr_id, cc, transmission, fuel, tank, sales
FROM (
  SELECT model, min_by(brand, vr_id) AS brand, min_by(segment, vr_id) AS segment,
    min(vr_id) AS vr_id, min_by(cc, vr_id) AS cc, min_by(transmission, vr_id) AS transmission,
    min_by(fuel, vr_id) AS fuel, min_by(tank, vr_id) FILTER (WHERE tank IS NOT NULL) AS tank,
    CAST(sum(sales) AS BIGINT) AS sales
  FROM {source} GROUP BY model
) ORDER BY sales DESC, model LIMIT 10"""
on_fact("route_ranking", _BEST.format(source="fact"))
on_fact("query_model_ranking", _BEST.format(source="fact WHERE year = 1997"))
on_master("query_model_ranking_compat", _BEST.format(source="master"))

_DEFAULT = """
SELECT brand, sales_type, month, CAST(sum(sales) AS BIGINT) AS sales FROM {source}
GROUP BY brand, sales_type, month"""
on_fact("route_detailed", _DEFAULT.format(source="fact WHERE month = 'may'"))
on_master("route_summary", _DEFAULT.format(source="total"))
on_fact("route_summary_month", _DEFAULT.format(source="fact WHERE month = 'may'"))
on_master("route_summary_month_compat",
          _DEFAULT.format(source="total WHERE month = 'all' AND year = 1998"))
on_master("query_default", _DEFAULT.format(
    source="total WHERE brand IN ('Brand#11', 'Brand#22') AND year IN (1996, 1997)"))
for _fn, _expr in {
    "sum": "CAST(sum(sales) AS BIGINT)", "avg": "round(avg(sales), 6)", "count": "count(sales)",
    "min": "min(sales)", "max": "max(sales)",
}.items():
    on_fact(f"agg_{_fn}", f"""SELECT brand, sales_type, month, {_expr} AS sales FROM fact
GROUP BY brand, sales_type, month""")
on_master("query_comparison", """
SELECT brand, sales_type, year, CAST(sum(sales) AS BIGINT) AS sales FROM total
WHERE sales_type = 'retail_sales' GROUP BY brand, sales_type, year""")
on_fact("query_trend", """
SELECT month, brand, sales_type, CAST(sum(sales) AS BIGINT) AS sales FROM fact
WHERE brand = 'Brand#11' GROUP BY month, brand, sales_type""")
on_master("query_trend_compat", """
SELECT month, brand, sales_type, CAST(sum(sales) AS BIGINT) AS sales FROM total
GROUP BY month, brand, sales_type""")
on_fact("query_technical_analysis", """
SELECT brand, fuel, system AS ff_fr, vr_id, cc, tank, CAST(sum(sales) AS BIGINT) AS sales,
  count(model) AS model_count FROM fact WHERE fuel = 'Diesel' AND system = 'FF'
GROUP BY brand, fuel, system, vr_id, cc, tank""")
on_fact("query_technical_defaults", """
SELECT brand, fuel, transmission, vr_id, cc, tank, CAST(sum(sales) AS BIGINT) AS sales,
  count(model) AS model_count FROM fact WHERE year = 1997
GROUP BY brand, fuel, transmission, vr_id, cc, tank""")
on_fact("query_technical_specs", """
SELECT brand, segment, fuel, transmission, wheel, seater, system AS ff_fr, vr_id, cc, tank,
  CAST(sum(sales) AS BIGINT) AS total_sales, count(model) AS record_count,
  count(DISTINCT model) AS unique_models FROM fact
GROUP BY brand, segment, fuel, transmission, wheel, seater, system, vr_id, cc, tank""")
on_fact("query_brand_segment", """
SELECT brand, segment, CAST(sum(sales) AS BIGINT) AS sales FROM fact GROUP BY brand, segment""")

# --- profiles -----------------------------------------------------------------------------
on_fact("distinct_counts", """
SELECT count(DISTINCT brand) AS brand, count(DISTINCT model) AS model,
  count(DISTINCT sales_type) AS sales_type, count(DISTINCT vr_id) AS vr_id,
  count(DISTINCT tank) AS tank FROM fact""")
on_fact("distinct_counts_stored", " UNION ALL ".join(
    f"SELECT '{question}' AS question, '{c}' AS dimension, count(DISTINCT {c}) AS n, true AS is_close FROM fact {kept}"
    for question, kept in (("all", ""), ("two years", "WHERE year IN (1996, 1997)"))
    for c in ("segment", "model", "month", "sales_type", "vr_id", "cc", "tank")))
on_fact("top_values", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS dimension, {c} AS value, count(*) AS n_rows FROM fact GROUP BY {c} ORDER BY n_rows DESC, value LIMIT 10)"
    for c in ("model", "cc", "vr_id")))
on_fact("spec_distribution", " UNION ALL ".join(
    f"SELECT '{label}' AS dimension, {column} AS value, count(*) AS n_rows FROM fact "
    f"WHERE {column} IS NOT NULL GROUP BY {column}"
    for label, column in [("fuel", "fuel"), ("transmission", "transmission"), ("wheel", "wheel"),
                          ("seater", "seater"), ("ff_fr", "system"), ("cc", "cc"),
                          ("model", "model")]))
on_fact("result_stats", """
, result AS (SELECT brand, sales_type, year, sum(sales) AS sales FROM fact
  GROUP BY brand, sales_type, year)
SELECT CAST(sum(sales) AS DOUBLE) AS total_sales, count(*) AS record_count,
  round(CAST(sum(sales) AS DOUBLE) / count(*), 6) AS avg_sales,
  CAST(max(sales) AS DOUBLE) AS max_sales,
  string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands,
  string_agg(DISTINCT sales_type, ',' ORDER BY sales_type) AS sales_types FROM result""")
on_master("headline", """
SELECT count(DISTINCT brand) AS brands, count(*) AS total_records,
  count(DISTINCT sales_type) AS sales_types,
  concat(CAST(min(year) AS VARCHAR), '-', CAST(max(year) AS VARCHAR)) AS time_period FROM total""")
on_master("brand_summary", """
SELECT brand, count(sales) AS count, CAST(sum(sales) AS BIGINT) AS sum,
  round(avg(sales), 2) AS mean FROM total GROUP BY brand""")
on_fact("brand_type_crosstab", """
SELECT brand,
  CAST(coalesce(sum(sales) FILTER (WHERE sales_type = 'wholesales'), 0) AS BIGINT) AS wholesales,
  CAST(coalesce(sum(sales) FILTER (WHERE sales_type = 'retail_sales'), 0) AS BIGINT) AS retail_sales,
  CAST(coalesce(sum(sales) FILTER (WHERE sales_type = 'production_ckd'), 0) AS BIGINT)
    AS production_ckd,
  CAST(coalesce(sum(sales) FILTER (WHERE sales_type = 'import_cbu'), 0) AS BIGINT) AS import_cbu
FROM fact GROUP BY brand""")
on_master("catalogue", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value FROM master"
    for c in ["brand", "sales_type", "month", "segment", "year"]))
on_master("quality_null_share", """
SELECT round(avg(CASE WHEN tank IS NULL THEN 1 ELSE 0 END) * 5 / 21, 6) AS null_share FROM total""")
on_master("sample_rows", """
SELECT vr_id, brand, year, sales_type, sales FROM total
ORDER BY md5(concat('7', '|', vr_id, '|', brand, '|', CAST(year AS VARCHAR), '|', sales_type, '|',
  CAST(sales AS VARCHAR))) LIMIT 20""")

# --- lookups, shares, shapes --------------------------------------------------------------
_MONTH_NO = """CASE month WHEN 'jan' THEN 1 WHEN 'feb' THEN 2 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4
  WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'jul' THEN 7 WHEN 'aug' THEN 8 WHEN 'sep' THEN 9
  WHEN 'oct' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END"""
on_fact("month_names", f"""
SELECT month, brand, CAST(sum(sales) AS BIGINT) AS sales, CAST({_MONTH_NO} AS INT) AS month_no,
  CASE month WHEN 'jan' THEN 'Januari' WHEN 'feb' THEN 'Februari' WHEN 'mar' THEN 'Maret'
    WHEN 'apr' THEN 'April' WHEN 'may' THEN 'Mei' WHEN 'jun' THEN 'Juni' WHEN 'jul' THEN 'Juli'
    WHEN 'aug' THEN 'Agustus' WHEN 'sep' THEN 'September' WHEN 'oct' THEN 'Oktober'
    WHEN 'nov' THEN 'November' WHEN 'dec' THEN 'Desember' END AS name_id,
  month AS again FROM fact GROUP BY month, brand""")
_SHARE = """
SELECT {name}, sales, round(CAST(sales AS DOUBLE) / CAST(sum(sales) OVER () AS DOUBLE), {digits})
  AS share
FROM (SELECT {name}, CAST(sum(sales) AS BIGINT) AS sales FROM fact GROUP BY {name})"""
on_fact("market_share", _SHARE.format(name="brand", digits=6))
on_fact("market_share_by_vehicle", _SHARE.format(name="vr_id", digits=9))
on_fact("shape_bar", """
SELECT brand, sales_type, CAST(sum(sales) AS BIGINT) AS sales FROM fact
GROUP BY brand, sales_type""")
on_fact("shape_line", f"""
SELECT month, brand, CAST(sum(sales) AS BIGINT) AS sales, CAST({_MONTH_NO} AS INT) AS month_no
FROM fact GROUP BY month, brand""")
on_fact("shape_heatmap", "SELECT brand, " + ", ".join(
    f"CAST(sum(sales) FILTER (WHERE month = '{m}') AS BIGINT) AS {m}"
    for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()
) + " FROM fact GROUP BY brand")
on_fact("shape_default",
        "SELECT month, CAST(sum(sales) AS BIGINT) AS sales FROM fact GROUP BY month")

ORACLE["scalar_suite"] = """
WITH t AS (
  SELECT *, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size + 0.75 WHEN 2 THEN 1000
    ELSE p_size END AS raw FROM part
)
SELECT p_partkey, p_name AS trimmed, upper(p_name) AS upper_name, lower(p_type) AS lower_type,
  array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS title_name,
  p_name LIKE '%red%' OR p_name LIKE '%widget%' AS has_any,
  CAST(p_name LIKE '%red%' AS INT) + CAST(p_name LIKE '%widget%' AS INT)
    + CAST(p_name LIKE '%e%' AS INT) AS n_present,
  p_name LIKE '%plate' AS ends_plate,
  concat(lower(p_type), '_ckd') AS snake,
  string_split(p_name, ' ')[2] AS second_word,
  string_split(p_name, ' ')[9] AS ninth_word,
  regexp_matches(p_brand, '[0-9]') AS has_digit,
  true AS all_digits,
  p_name[1:3] AS prefix, CAST(length(p_name) AS INT) AS name_length,
  CASE WHEN p_type = 'PROMO' THEN 'none' ELSE p_type END AS defaulted,
  CAST(raw AS DOUBLE) AS number, CAST(trunc(raw) AS BIGINT) AS whole,
  concat('TOTAL_', p_brand, '_', CAST(p_partkey AS VARCHAR)) AS total_key,
  round(p_retailprice / 7, 2) AS rounded,
  CAST(least(abs(p_size - 25), 10) AS INT) AS capped_distance,
  CAST(CASE WHEN p_size > 10 THEN 4 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END
    AS INT) AS points,
  concat('{"k":', CAST(p_partkey AS VARCHAR), ',"t":"', p_type, '"}') AS record,
  p_type AS decoded, '2025-01-31T10:11:12.500000' AS stamp,
  ['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'][p_partkey % 12 + 1]
    AS month,
  CAST(p_partkey % 12 + 1 AS INT) AS month_no,
  p_name LIKE '%red%' OR p_name LIKE '%gear' AS matches,
  lower(p_name) LIKE '%d p%' AS matches_literal
FROM t"""

# --- sheets -------------------------------------------------------------------------------
WIDE = """
slot AS (
  SELECT p_brand AS brand, p_type AS segment, p_name AS model, p_partkey, p_size,
    concat('VR', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS vr_id,
    CAST(year(l_shipdate) AS INT) AS year, month(l_shipdate) AS month_no,
    CASE WHEN l_returnflag = 'A' THEN 'wholesales' WHEN l_returnflag = 'N' THEN 'retail_sales'
      WHEN l_linestatus = 'F' THEN 'production_ckd' ELSE 'import_cbu' END AS sales_type,
    CAST(sum(l_quantity) AS BIGINT) AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
),
vehicle AS (
  SELECT DISTINCT brand, segment, model, p_partkey, p_size, vr_id, year FROM slot
),
grid AS (
  SELECT v.*, t.sales_type, m.month, m.month_no, s.units
  FROM vehicle v
  CROSS JOIN (VALUES ('wholesales'), ('retail_sales'), ('production_ckd'), ('import_cbu'))
    AS t(sales_type)
  CROSS JOIN (VALUES (1, 'jan'), (2, 'feb'), (3, 'mar'), (4, 'apr'), (5, 'may'), (6, 'jun'),
    (7, 'jul'), (8, 'aug'), (9, 'sep'), (10, 'oct'), (11, 'nov'), (12, 'dec'))
    AS m(month_no, month)
  LEFT JOIN slot s ON s.p_partkey = v.p_partkey AND s.year = v.year
    AND s.sales_type = t.sales_type AND s.month_no = m.month_no
),
cell AS (
  SELECT *, CASE
    WHEN p_partkey % 9 = 0 THEN CASE WHEN units > 25 THEN '-' WHEN units > 0 THEN '0' END
    WHEN sales_type = 'wholesales' AND month = 'jan' AND p_partkey % 13 = 1 THEN 'n/a'
    WHEN sales_type = 'wholesales' AND month = 'jan' AND p_partkey % 13 = 2
      THEN CASE WHEN units IS NULL THEN NULL ELSE concat(CAST(units AS VARCHAR), '.5') END
    WHEN sales_type = 'retail_sales' AND month = 'feb' AND p_partkey % 13 = 3 THEN '1,000'
    WHEN sales_type = 'retail_sales' AND month = 'feb' AND p_partkey % 13 = 4 THEN '0.5'
    WHEN sales_type = 'retail_sales' AND month = 'feb' AND p_partkey % 13 = 5 THEN '-3'
    WHEN sales_type = 'wholesales' AND month = 'jan' AND p_partkey % 13 = 6
      THEN CASE WHEN units IS NULL THEN NULL
        ELSE concat(chr(9), chr(160), CAST(units AS VARCHAR), ' ', chr(13), chr(10)) END
    ELSE CAST(units AS VARCHAR) END AS value
  FROM grid
),
sold AS (
  SELECT *, CASE WHEN TRY_CAST(trim(value, concat(chr(9), chr(160), ' ', chr(13), chr(10))) AS DOUBLE) > 0
    THEN CAST(trunc(TRY_CAST(trim(value, concat(chr(9), chr(160), ' ', chr(13), chr(10))) AS DOUBLE)) AS BIGINT) END AS sales FROM cell
),
filled AS (
  SELECT * EXCLUDE (sales), coalesce(sales, 0) AS sales FROM sold
  QUALIFY sales IS NOT NULL OR count(sales) OVER (PARTITION BY p_partkey, year) = 0
),
sheet AS (
  SELECT *, upper(replace(brand, '#', '_')) AS file_brand,
    concat(CAST(year AS VARCHAR), '/', upper(replace(brand, '#', '_')), '.xlsx') AS path
  FROM vehicle
)"""


def on_wide(name: str, sql: str) -> None:
    ORACLE[name] = f"WITH {WIDE}\n{sql.strip()}"


_SPECS = """
  CAST(1000 + p_size * 100 AS VARCHAR) AS cc,
  CASE p_partkey % 3 WHEN 0 THEN 'Manual' WHEN 1 THEN 'Automatic' ELSE 'AMT' END AS transmission,
  CASE p_partkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Petrol' WHEN 2 THEN 'Hybrid'
    ELSE 'Electric' END AS fuel,
  concat(CAST(p_size AS VARCHAR), 'T') AS gvw,
  concat(CAST(60 + p_size * 5 AS VARCHAR), 'HP') AS ps_hp,
  concat(CAST(3000 + p_size * 50 AS VARCHAR), 'x', CAST(1500 + p_size * 10 AS VARCHAR), 'x',
    CAST(1400 + p_size * 20 AS VARCHAR)) AS dimension,
  CASE p_partkey % 6 WHEN 0 THEN '2 Seater' WHEN 1 THEN '7 Seater' WHEN 2 THEN '20+ Seater'
    ELSE '5 Seater' END AS seater,
  CASE p_partkey % 5 WHEN 0 THEN '4x4' WHEN 1 THEN '6x4' ELSE '4x2' END AS wheel,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(20 + p_size AS VARCHAR) END AS tank,
  CASE WHEN p_partkey % 11 = 0 THEN ''
    ELSE concat(CAST(4 + p_partkey % 5 AS VARCHAR), '-speed') END AS gear,
  CASE p_partkey % 2 WHEN 0 THEN 'FF' ELSE 'FR' END AS system,
  CAST(90 + p_size AS VARCHAR) AS speed,
  CASE p_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '5' END AS door"""

ORACLE["ingest_path_keys"] = """
WITH f AS (
  SELECT p_partkey AS file_id, lower(replace(p_brand, '#', '_')) AS b,
    concat('20', lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0')) AS y, p_brand FROM part
)
SELECT file_id, concat(y, '/', b, CASE file_id % 6 WHEN 2 THEN '.xlsx/old' ELSE '.xlsx' END) AS path,
  CAST(y AS INT) AS year, upper(b) AS brand
FROM f WHERE file_id % 6 NOT IN (0, 1) AND NOT p_brand LIKE '%7'"""
on_wide("ingest_header_row", """
SELECT DISTINCT path, CAST(4 + year % 5 AS BIGINT) AS header_row, true AS has_mark FROM sheet""")
on_wide("ingest_month_columns", """
SELECT DISTINCT s.path, t.sales_type, m.month, CAST(t.start + m.month_no - 1 AS INT) AS position
FROM (SELECT DISTINCT path FROM sheet) s
CROSS JOIN (VALUES ('wholesales', 22), ('retail_sales', 35), ('production_ckd', 48),
  ('import_cbu', 61)) AS t(sales_type, start)
CROSS JOIN (VALUES (1, 'jan'), (2, 'feb'), (3, 'mar'), (4, 'apr'), (5, 'may'), (6, 'jun'),
  (7, 'jul'), (8, 'aug'), (9, 'sep'), (10, 'oct'), (11, 'nov'), (12, 'dec')) AS m(month_no, month)""")
on_wide("ingest_vehicle_rows",
        "SELECT path, CAST(20 + p_partkey AS BIGINT) AS row_idx, vr_id FROM sheet")
_MONTH_COLUMNS = ", ".join(
    f"max(value) FILTER (WHERE sales_type = '{t}' AND month = '{m}') AS {prefix}_{m}"
    for t, prefix in [("wholesales", "wholesale"), ("retail_sales", "retail"),
                      ("production_ckd", "ckd"), ("import_cbu", "cbu")]
    for m in "jan feb mar apr may jun jul aug sep oct nov dec".split())
on_wide("ingest_project", f"""
, months AS (SELECT p_partkey, year, {_MONTH_COLUMNS} FROM cell GROUP BY p_partkey, year)
SELECT path, CAST(20 + p_partkey AS BIGINT) AS row_idx,
  CAST(15 + p_partkey - year % 5 AS BIGINT) AS row_index, vr_id, segment, model, {_SPECS},
  CAST(p_partkey % 97 AS VARCHAR) AS no, concat(CAST(p_partkey % 20 AS VARCHAR), '.5') AS fc_kml,
  CASE WHEN p_partkey % 8 > 0 THEN CAST(100 + p_partkey % 8 AS VARCHAR) ELSE '' END AS co2,
  CAST(13 + p_partkey % 6 AS VARCHAR) AS tyre_size,
  months.* EXCLUDE (p_partkey, year)
FROM sheet JOIN months USING (p_partkey, year)""")
on_wide("unpivot_sales",
        "SELECT vr_id, year, sales_type, month, value FROM cell")
on_wide("clean_sales",
        "SELECT vr_id, year, sales_type, month, sales FROM sold WHERE sales IS NOT NULL")
on_wide("zero_fill", "SELECT vr_id, model, year, sales_type, month, sales FROM filled")
on_wide("ingest_rejects", """
SELECT vr_id, year, sales_type, month, value FROM cell
WHERE value IS NOT NULL AND TRY_CAST(trim(value, concat(chr(9), chr(160), ' ', chr(13), chr(10))) AS DOUBLE) IS NULL""")
for _name in ("ingest_detail", "ingest_folder"):
    on_wide(_name, f"""
SELECT upper(replace(brand, '#', '_')) AS brand, segment, model, month, sales_type, sales, year,
  false AS is_summary, CAST(15 + p_partkey - year % 5 AS BIGINT) AS row_index, vr_id, {_SPECS}
FROM filled""")
for _name in ("ingest_workbooks", "ingest_csv"):
    on_wide(_name, f"""
SELECT upper(replace(brand, '#', '_')) AS brand, segment, model, month, sales_type, sales, year,
  false AS is_summary, CAST(p_partkey % 7 AS BIGINT) AS row_index, vr_id, {_SPECS}
FROM filled WHERE p_partkey % 97 <> 0""")
on_wide("ingest_problems", """
SELECT concat(path, '/', CAST(p_partkey AS VARCHAR)) AS path, true AS has_reason
FROM sheet WHERE p_partkey % 97 = 0""")
on_wide("run_metadata", """
, summary AS (SELECT DISTINCT brand, year, sales_type FROM filled)
SELECT (SELECT string_agg(DISTINCT file_brand, ',' ORDER BY file_brand) FROM sheet)
    AS brands_processed,
  (SELECT count(*) FROM filled) + (SELECT count(*) FROM summary) AS total_records,
  (SELECT count(*) FROM filled) AS detailed_records,
  (SELECT count(*) FROM summary) AS summary_records,
  '2025-01-01T00:00:00' AS processing_date,
  (SELECT count(DISTINCT path) FROM sheet) + (SELECT count(*) FROM part WHERE p_partkey % 50 = 0)
    AS files_processed,
  (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS unreadable_files,
  (SELECT string_agg(concat(p, ' BadZipFile: File is not a zip file'), ',' ORDER BY p) FROM (
    SELECT concat('1999/', CAST(p_partkey AS VARCHAR), '.xlsx') AS p FROM part
    WHERE p_partkey % 50 = 0 ORDER BY p LIMIT 5)) AS problems,
  (SELECT count(*) FROM cell WHERE value IS NOT NULL AND TRY_CAST(trim(value, concat(chr(9), chr(160), ' ', chr(13), chr(10))) AS DOUBLE) IS NULL)
    AS rejected_cells""")
_UPDATED = """
, fact AS (SELECT upper(replace(brand, '#', '_')) AS brand, year, sales_type, sales FROM filled"""
_CURRENT = """
WHERE NOT (brand LIKE '%3' AND year = 1997) AND NOT (brand LIKE '%4' AND year = 1999))"""
for _name, _left in (("incremental_update", _CURRENT), ("incremental_workbooks", _CURRENT),
                     ("incremental_update_stream", ")")):
    on_wide(_name, _UPDATED + _left + "," + TOTALS.split("master AS")[0].rstrip().rstrip(",")
            + "\nSELECT * FROM total")

# --- texts --------------------------------------------------------------------------------
QUESTIONS = """
question AS (
  SELECT p_partkey AS query_id, p_size,
    concat(CASE p_partkey % 20
      WHEN 0 THEN 'Berapa total penjualan' WHEN 1 THEN 'Bandingkan penjualan retail'
      WHEN 2 THEN 'Tampilkan spesifikasi model' WHEN 3 THEN 'Compare wholesale sales of'
      WHEN 4 THEN 'What is the fuel and transmission of'
      WHEN 5 THEN 'Which model is the best selling of' WHEN 6 THEN 'Show the forecast for'
      WHEN 7 THEN 'Where does this come from:' WHEN 8 THEN 'Model forecast sales of'
      WHEN 9 THEN 'いくつ売れた' WHEN 10 THEN '販売の分析'
      WHEN 11 THEN 'Wie viele wurden verkauft von' WHEN 12 THEN 'Diagramm der Modelle von'
      WHEN 13 THEN '¿Cuántos vende' WHEN 14 THEN 'Gráfico de'
      WHEN 15 THEN 'Will national demand grow for'
      WHEN 16 THEN 'HOW MANY seater and wheel options has' WHEN 17 THEN 'Market share trend of'
      WHEN 18 THEN 'Maps and photos of' ELSE 'Tell me about' END, ' ', p_brand, ' ', p_type) AS text,
    CASE p_partkey % 5 WHEN 0 THEN 'specification' WHEN 2 THEN 'general' WHEN 3 THEN 'prediction'
      ELSE 'sales' END AS submitted_intent,
    CASE p_partkey % 3 WHEN 1 THEN 'id' ELSE 'en' END AS picked,
    concat(CASE p_partkey % 7 WHEN 0 THEN 'No fuel data found for'
      WHEN 1 THEN 'Unusually high sales of' WHEN 2 THEN 'Negative sales of'
      WHEN 3 THEN 'missing specs of' WHEN 4 THEN 'Empty model names of'
      WHEN 5 THEN 'Separate data files not found for' ELSE 'Odd spelling of' END,
      ' ', p_brand) AS issue_1,
    concat(CASE p_size % 7 WHEN 0 THEN 'No fuel data found for'
      WHEN 1 THEN 'Unusually high sales of' WHEN 2 THEN 'Negative sales of'
      WHEN 3 THEN 'missing specs of' WHEN 4 THEN 'Empty model names of'
      WHEN 5 THEN 'Separate data files not found for' ELSE 'Odd spelling of' END,
      ' ', p_type) AS issue_2,
    concat('2025-', lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0'), '-',
      lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0')) AS timestamp
  FROM part
)"""


def _hits(text: str, words: str) -> str:
    return "(" + " + ".join(
        f"CAST(contains({text}, '{w.strip()}') AS INT)" for w in words.split(",")) + ")"


_SPEC_WORDS = ("model,spesifikasi,specification,cc,transmission,fuel,wheel,seater,gvw,ps,hp,"
               "dimension,tank,gear,system,ff,fr,speed,paling laris,terlaris,terjual,popular,"
               "best selling,top model,most sold")
_SALES_WORDS = ("penjualan,sales,retail,wholesale,total,sum,average,trend,growth,market share,"
                "revenue,profit,comparison,bandingkan,compare,vs,versus,berapa,how many")
_PREDICTION_WORDS = ("prediksi,prediction,forecast,future,akan,will,projected,expected,nasional,"
                     "national,global")


def _texts(source: str) -> str:
    """CTEs from ``source`` (which has ``text``) to language, scores and both intents."""
    return f"""
lowered AS (SELECT *, lower(text) AS low FROM {source}),
scored AS (
  SELECT *, {_hits('low', _SPEC_WORDS)} AS specification_score,
    {_hits('low', _SALES_WORDS)} AS sales_score,
    {_hits('low', _PREDICTION_WORDS)} AS prediction_score,
    {_hits('low', 'sales,penjualan,retail,wholesale,total,berapa')} AS sales_2,
    {_hits('low', 'model,spesifikasi,cc,transmission,fuel,wheel')} AS spec_2
  FROM lowered
),
judged AS (
  SELECT *,
    CASE WHEN regexp_matches(low, 'berapa|bandingkan|buatkan|tampilkan|analisis|grafik') THEN 'id'
      WHEN regexp_matches(low, 'いくつ|比較|グラフ|分析') THEN 'ja'
      WHEN regexp_matches(low, 'wie viele|vergleichen|diagramm|analyse') THEN 'de'
      WHEN regexp_matches(low, 'cuántos|comparar|gráfico|análisis') THEN 'es'
      ELSE 'en' END AS language,
    CASE WHEN specification_score > sales_score AND specification_score > prediction_score
        THEN 'specification'
      WHEN sales_score > specification_score AND sales_score > prediction_score THEN 'sales'
      WHEN prediction_score > 0 THEN 'prediction' ELSE 'general' END AS intent,
    CASE WHEN sales_2 > spec_2 THEN 'sales' WHEN spec_2 > 0 THEN 'specification'
      ELSE 'general' END AS expected_intent
  FROM scored
)"""


ORACLE["detect_language"] = f"""WITH {QUESTIONS}, {_texts('question')}
SELECT query_id, language, CASE WHEN picked <> 'en' THEN picked ELSE language END AS final_language
FROM judged"""
ORACLE["classify_intent"] = f"""WITH {QUESTIONS}, {_texts('question')}
SELECT query_id, specification_score, sales_score, prediction_score, intent FROM judged"""
ORACLE["classify_documents"] = f"""WITH {_texts('documents')}
SELECT doc_id, language, intent FROM judged"""
ORACLE["classify_conversations"] = f"""WITH {_texts('conversations')}
SELECT conv_id, turn, specification_score, sales_score, prediction_score, intent, language
FROM judged"""

# --- quality ------------------------------------------------------------------------------
_CHECKED = f"""{QUESTIONS}, {_texts('question')},
checked AS (
  SELECT *, submitted_intent = intent AS passed,
    CASE WHEN submitted_intent = intent AND submitted_intent = expected_intent THEN 1.0
      WHEN submitted_intent = intent THEN 0.7 ELSE 0.3 END AS score
  FROM judged
)"""
# What the answers' checks come to: ranking, comparison, an empty trend and a foreign result.
_CHECKS = f"""{FACT},{TOTALS},
counted AS (
  SELECT abs((SELECT count(*) FROM master) - count(*)) <= 0.05 * count(*) AS near FROM lineitem
),
verdict AS (
  SELECT 'ranking' AS answer, 'data_source_consistency' AS check_type, 1.0 AS score, true AS passed
  UNION ALL SELECT 'comparison', 'data_source_consistency', 1.0, true
  UNION ALL SELECT 'empty', 'data_source_consistency', 1.0, true
  UNION ALL SELECT 'foreign', 'data_source_consistency', 1.0, true
  UNION ALL SELECT answer, 'cross_reference', CASE WHEN near THEN 1.0 ELSE 0.8 END, near
    FROM counted CROSS JOIN (VALUES ('ranking'), ('comparison'), ('empty')) AS v(answer)
  UNION ALL SELECT 'foreign', 'cross_reference', CASE WHEN near THEN 0.6 ELSE 0.4 END, false FROM counted
  UNION ALL SELECT 'ranking', 'result_completeness', 1.0, true
  UNION ALL SELECT 'comparison', 'result_completeness', 1.0, true
  UNION ALL SELECT 'empty', 'result_completeness', 0.0, false
  UNION ALL SELECT 'foreign', 'result_completeness', 1.0, true
)"""
_ANSWERED = _CHECKS + "," + _CHECKED + """,
each AS (
  SELECT query_id, submitted_intent AS intent, timestamp, issue_1, issue_2, passed AS intent_ok,
    score AS intent_score, CASE query_id % 4 WHEN 0 THEN 'ranking' WHEN 1 THEN 'comparison'
      WHEN 2 THEN 'empty' ELSE 'foreign' END AS answer
  FROM checked
),
answer AS (
  SELECT query_id, intent, timestamp, issue_1, issue_2, intent_ok,
    bool_and(passed) FILTER (WHERE check_type = 'data_source_consistency') AS source_ok,
    bool_and(passed) FILTER (WHERE check_type = 'cross_reference') AS reference_ok,
    bool_and(passed) FILTER (WHERE check_type = 'result_completeness') AS complete_ok,
    round(CAST((sum(CAST(round(score * 10) AS INT)) + max(CAST(round(intent_score * 10) AS INT))) AS DOUBLE) / 40, 9)
      AS accuracy_score
  FROM each JOIN verdict USING (answer)
  GROUP BY ALL
),
advice AS (
  SELECT query_id, accuracy_score, 'Consider reviewing data source selection logic for better accuracy'
    AS recommendation FROM answer WHERE NOT source_ok
  UNION ALL SELECT query_id, accuracy_score,
    'Implement stronger cross-referencing between sales and specifications data'
    FROM answer WHERE NOT reference_ok
  UNION ALL SELECT query_id, accuracy_score,
    'Improve query intent classification with additional training examples'
    FROM answer WHERE NOT intent_ok
  UNION ALL SELECT query_id, accuracy_score,
    'Add data validation checks to ensure result completeness' FROM answer WHERE NOT complete_ok
  UNION ALL SELECT query_id, accuracy_score,
    'Consider implementing additional validation layers for critical queries'
    FROM answer WHERE accuracy_score < 0.7
  UNION ALL SELECT query_id, accuracy_score,
    'Minor accuracy improvements recommended for optimal performance'
    FROM answer WHERE accuracy_score >= 0.7 AND accuracy_score < 0.9
)"""

ORACLE["quality_intent"] = f"""WITH {_CHECKED}
SELECT query_id, submitted_intent, intent AS reclassified_intent, expected_intent,
  CAST(score AS DOUBLE) AS score, passed FROM checked"""
ORACLE["validate_answers"] = f"""WITH {_CHECKS}
SELECT answer, check_type, CAST(score AS DOUBLE) AS score, passed FROM verdict"""
ORACLE["quality_source"] = f"""WITH {_ANSWERED}
SELECT intent, 'data_source_consistency' AS check_type, CAST(1.0 AS DOUBLE) AS score,
  source_ok AS passed, count(*) AS n_queries FROM answer GROUP BY intent, source_ok"""
on_fact("quality_brand_subset", """
SELECT DISTINCT b AS brand FROM (
  SELECT CASE WHEN p_partkey % 50 = 0 THEN concat(p_brand, 'X') ELSE p_brand END AS b FROM part)
WHERE b NOT IN (SELECT brand FROM fact)""")
on_master("quality_cross_reference", """
, counted AS (
  SELECT (SELECT count(*) FROM master) AS sales_records,
    (SELECT count(*) FROM (SELECT DISTINCT brand, segment, model, year, month, vr_id, cc,
      transmission, fuel, gvw, wheel, ps_hp, dimension, seater FROM master)) AS specs_records,
    (SELECT count(*) FROM lineitem) AS recorded
)
SELECT 'cross_reference' AS check_type, true AS brand_consistency,
  abs(sales_records - recorded) <= recorded * 0.05 AS record_integrity,
  sales_records, specs_records,
  CAST(CASE WHEN abs(sales_records - recorded) <= recorded * 0.05 THEN 1.0 ELSE 0.8 END AS DOUBLE)
    AS score,
  abs(sales_records - recorded) <= recorded * 0.05 AS passed
FROM counted""")
on_master("quality_completeness", """
SELECT 'result_completeness' AS check_type, count(*) AS record_count,
  true AS has_required_columns,
  round(1 - CAST(5 * count(*) FILTER (WHERE tank IS NULL) AS DOUBLE) / (23 * count(*)), 6)
    AS data_quality_score,
  true AS has_numeric_data, CAST(1.0 AS DOUBLE) AS score, true AS passed
FROM master""")
on_fact("response_style", """
, result AS (SELECT DISTINCT brand, segment, fuel, transmission, wheel, seater, system, vr_id, cc,
  tank FROM fact)
SELECT count(*) AS record_count,
  CASE WHEN count(*) > 50 THEN 'comprehensive_business_analysis'
    ELSE 'technical_deep_dive' END AS response_style
FROM result""")
ORACLE["quality_score"] = f"""WITH {_ANSWERED}
SELECT query_id, CAST(4 AS INT) AS n_checks, round(accuracy_score, 6) AS accuracy_score FROM answer"""
ORACLE["quality_recommend"] = f"""WITH {_ANSWERED} SELECT query_id, recommendation FROM advice"""
_RULE = """CASE WHEN {i} LIKE '%No%' AND {i} LIKE '%data found%'
    THEN 'Consider expanding technical specification extraction rules'
  WHEN {i} LIKE '%Unusually high%' THEN 'Review sales data for outliers and anomalies'
  WHEN {i} LIKE '%Negative sales%'
    THEN 'Implement data validation to prevent negative sales values'
  WHEN {i} LIKE '%missing specs%'
    THEN 'Ensure all brands have corresponding specification data'
  WHEN {i} LIKE '%Empty model%' THEN 'Improve model name extraction from Excel files'
  WHEN {i} LIKE '%Separate data files not found%'
    THEN 'Run the data separation process to enable full validation' END"""
ORACLE["quality_issue_rules"] = f"""WITH {QUESTIONS},
ruled AS (SELECT query_id, {_RULE.format(i='issue_1')} AS a, {_RULE.format(i='issue_2')} AS b
  FROM question)
SELECT query_id, CASE WHEN a IS NULL AND b IS NULL
    THEN 'Data accuracy is within acceptable parameters'
  ELSE concat_ws(' | ', a, b) END AS advice FROM ruled"""
ORACLE["report_summary"] = f"""WITH {_ANSWERED}
SELECT count(*) AS total_queries, round(avg(accuracy_score), 6) AS average_score,
  min(timestamp) AS first_time, max(timestamp) AS last_time FROM answer"""
ORACLE["report_by_intent"] = f"""WITH {_ANSWERED}
SELECT concat(upper(intent[1]), intent[2:]) AS intent, count(*) AS n_queries,
  round(avg(accuracy_score), 6) AS average_score FROM answer GROUP BY intent"""
ORACLE["report_recommendations"] = f"""WITH {_ANSWERED}
SELECT recommendation AS message, count(*) AS n_queries FROM advice WHERE accuracy_score < 0.9
GROUP BY recommendation ORDER BY n_queries DESC, message LIMIT 10"""
ORACLE["report_issues"] = f"""WITH {_ANSWERED}
SELECT message, count(*) AS n_queries FROM (
  SELECT issue_1 AS message, accuracy_score FROM answer
  UNION ALL SELECT issue_2, accuracy_score FROM answer) WHERE accuracy_score < 0.9
GROUP BY message ORDER BY n_queries DESC, message LIMIT 10"""
ORACLE["report_bands"] = f"""WITH {_ANSWERED}
SELECT count(*) FILTER (WHERE accuracy_score >= 0.9) AS high,
  count(*) FILTER (WHERE accuracy_score >= 0.7 AND accuracy_score < 0.9) AS medium,
  count(*) FILTER (WHERE accuracy_score < 0.7) AS low FROM answer"""
