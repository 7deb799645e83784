"""Registered queries of the data-quality, reference, parsing and key-balance operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.key_chunks import chunked_aggregate, heavy_keys
from quernel.operators.orphans import orphan_report, orphan_rows
from quernel.operators.quality import KeptStates, Rule, control_limits, frequency_metrics, merge_profile_states, profile_metrics, profile_states, with_previous_load
from quernel.plans.scratch import materialize, new_path
from quernel.sources.delimited import Field, parse_lines
from quernel.sources.parquet import read_parquet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


SALES_RULES = (Rule("units_sold", low=0, high=20000), Rule("promotion_flag", allowed=(0, 1)))
BRAND_RULES = (Rule("launch_year", low=1950, high=2024),)


def _load_metrics(spark: SparkSession, sf_dir: str, states: str | None = None) -> DataFrame:
    """Metrics from the states kept in the folder ``states``, to which loads that it lacks are added first."""
    folder, parts = states or new_path(spark, "load-states"), []
    for name, rules in (("fmcg_sales", SALES_RULES), ("brands", BRAND_RULES)):
        kept = KeptStates(spark, f"{folder}/{name}", "load_id", rules)
        kept.update(_table(spark, sf_dir, name))
        metrics = frequency_metrics(kept.states(), "load_id", rules)
        parts.append(with_previous_load(metrics, _table(spark, sf_dir, "loads")).withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str, states: str | None = None) -> DataFrame:
    m = _load_metrics(spark, sf_dir, states)
    now, before = F.col("valid_median"), F.col("prev_valid_median")
    shift = (
        F.when(F.col("column_name") == "units_sold", (now > 2 * before) | (before > 2 * now))
        .when(F.col("column_name") == "promotion_flag", F.abs(F.col("valid_mean") - F.col("prev_valid_mean")) > 0.253)
        .when(F.col("column_name") == "launch_year", F.abs(now - before) > 8)
    )
    checks = {"nulls": F.abs(F.col("null_share") - F.col("prev_null_share")) > 0.153, "violation": F.col("invalid_share") > 0.053, "shift": shift}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return m.select("table_name", "column_name", "load_id", F.explode(names).alias("check_name"))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _load_metrics(spark, sf_dir)
    return m.select("table_name", "column_name", "load_id", "n_rows", "n_nulls", "n_invalid", "n_distinct", "min_value", "max_value", "valid_median", "prev_valid_median")


#: Metrics whose history is tested.
CONTROLLED = ("null_share", "invalid_share", "valid_mean", "valid_median")


def p2_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _load_metrics(spark, sf_dir)
    return control_limits(m, CONTROLLED, by=("table_name", "column_name")).select("table_name", "column_name", "load_id", "metric", F.round("value", 9).alias("value"))


#: Besides those of the loads, patterns of whole values.
PATTERN_RULES = (Rule("sku", pattern="[A-Z]{2}-([0-9]{3}|[0-9]{7})"), Rule("region", pattern="[A-Z]{2}-[A-Za-z]+"), Rule("pack_type", pattern="[A-Z][a-z]+"))


def p2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the table, from the merged states of its months."""
    sales = _table(spark, sf_dir, "fmcg_sales")
    monthly = profile_states(sales.withColumn("_month", F.trunc("date", "month")), ("_month",), SALES_RULES + PATTERN_RULES)
    return profile_metrics(merge_profile_states(monthly)).select("column_name", "n_rows", "n_nulls", "n_invalid", "min_value", "max_value")


def _brand_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ref = lambda name, row_id: _table(spark, sf_dir, name).select(F.lit(name).alias("ref"), F.col(row_id).alias("row_id"), F.col("brand").alias("key"), "date")
    parents = _table(spark, sf_dir, "brands").select(F.col("brand").alias("key"), F.col("added_on").alias("valid_from"), F.col("removed_on").alias("valid_to"))
    return ref("fmcg_sales", "sale_id").unionByName(ref("sales", "sale_no")), parents


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle, of the orphans: repeated rows of a sale with another brand or date count once too."""
    return orphan_rows(*_brand_references(spark, sf_dir), distinct_by=("ref", "row_id")).select(F.col("ref").alias("table_name"), "row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = orphan_report(orphan_rows(*_brand_references(spark, sf_dir)))
    return report.select(F.col("ref").alias("table_name"), F.date_format("month", "yyyy-MM").alias("month"), "n_rows", "n_keys")


BRAND_FIELDS = (Field("brand"), Field("category"), Field("manufacturer", name_like=True), Field("launch_year", "int", 1900, 2024))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_table(spark, sf_dir, "brand_lines"), BRAND_FIELDS).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_table(spark, sf_dir, "brand_lines"), BRAND_FIELDS).where(F.col("reason").isNull()).drop("reason")


KEY_COLUMNS = ("sku", "category")
CHUNK_ROWS = 262_144


def _key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "fmcg_sales")
    keyed = sales.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("key_value")) for c in KEY_COLUMNS])).alias("k"), "units_sold").select("k.*", "units_sold")
    return chunked_aggregate(
        keyed,
        ("column_name", "key_value"),
        {"n": F.count(F.lit(1)), "u": F.sum("units_sold")},
        {"n_rows": F.sum("n"), "units": F.sum("u")},
        CHUNK_ROWS,
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = materialize(_key_totals(spark, sf_dir), "key-totals")
    return heavy_keys(totals, ("column_name",), "n_rows", 3).where(F.col("key_value").isNotNull()).select("column_name", "key_value")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_totals(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_control, p2_columns, p4_found, p4_report, p5_found, p5_valid, p6_found, p6_totals)}

_METRICS = """
WITH v AS (
  SELECT 'fmcg_sales' AS table_name, 'units_sold' AS column_name, load_id, units_sold AS x, units_sold BETWEEN 0 AND 20000 AS ok FROM fmcg_sales
  UNION ALL SELECT 'fmcg_sales', 'promotion_flag', load_id, promotion_flag, promotion_flag IN (0, 1) FROM fmcg_sales
  UNION ALL SELECT 'brands', 'launch_year', load_id, launch_year, launch_year BETWEEN 1950 AND 2024 FROM brands),
m AS (
  SELECT table_name, column_name, load_id, COUNT(*) AS n_rows, COUNT(*) - COUNT(x) AS n_nulls, COUNT(x) - COUNT(x) FILTER (WHERE ok) AS n_invalid,
    COUNT(DISTINCT x) AS n_distinct, MIN(x) AS min_value, MAX(x) AS max_value, MEDIAN(x) FILTER (WHERE ok) AS valid_median, AVG(x) FILTER (WHERE ok) AS valid_mean
  FROM v GROUP BY table_name, column_name, load_id),
f AS (SELECT load_id, feed, load_no, LAG(load_id) OVER (PARTITION BY feed ORDER BY load_no) AS before_id FROM loads),
c AS (
  SELECT m.*, f.feed, f.load_no, m.n_nulls / m.n_rows AS null_share, b.n_nulls / b.n_rows AS prev_null_share, b.valid_median AS prev_valid_median, b.valid_mean AS prev_valid_mean
  FROM m LEFT JOIN f ON m.load_id = f.load_id LEFT JOIN m b ON b.load_id = f.before_id AND b.table_name = m.table_name AND b.column_name = m.column_name)
"""
_FIELD = r'''("(?:[^"]|"")*"|[^",]*)'''
_RECORDS = rf"""
WITH r AS (SELECT line_id, raw, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') AS quoted, regexp_full_match(raw, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}') AS four
  FROM brand_lines WHERE line_no <> 1 AND length(raw) > 0),
f AS (SELECT line_id, quoted, four, regexp_extract(raw, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', ['a', 'b', 'c', 'd']) AS p FROM r),
u AS (SELECT line_id, quoted, four, CASE WHEN p.a LIKE '"%' THEN replace(substr(p.a, 2, length(p.a) - 2), '""', '"') ELSE p.a END AS brand,
  CASE WHEN p.b LIKE '"%' THEN replace(substr(p.b, 2, length(p.b) - 2), '""', '"') ELSE p.b END AS category,
  CASE WHEN p.c LIKE '"%' THEN replace(substr(p.c, 2, length(p.c) - 2), '""', '"') ELSE p.c END AS manufacturer,
  trim(CASE WHEN p.d LIKE '"%' THEN replace(substr(p.d, 2, length(p.d) - 2), '""', '"') ELSE p.d END, ' ') AS launch_year FROM f),
x AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT four THEN 'columns'
  WHEN launch_year <> '' AND NOT (regexp_full_match(launch_year, '[+-]?[0-9]+') AND COALESCE(TRY_CAST(launch_year AS HUGEINT) BETWEEN 1900 AND 2024, FALSE)) THEN 'value'
  WHEN manufacturer <> '' AND (NOT regexp_matches(manufacturer, '\p{{L}}') OR regexp_matches(manufacturer, '[\x{{0}}-\x{{1f}}\x{{7f}}\x{{fffd}}]')) THEN 'value' END AS reason FROM u)
"""
_ORPHANS = """
WITH r AS (SELECT 'fmcg_sales' AS table_name, sale_id AS row_id, brand, date FROM fmcg_sales UNION ALL SELECT 'sales', sale_no, brand, date FROM sales),
o AS (SELECT DISTINCT table_name, row_id, brand, date FROM r WHERE brand IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM brands b WHERE b.brand = r.brand AND (r.date IS NULL OR (b.added_on <= r.date AND (b.removed_on IS NULL OR r.date < b.removed_on)))))
"""
_TOTALS = """
WITH k AS (SELECT 'sku' AS column_name, sku AS key_value, units_sold FROM fmcg_sales UNION ALL SELECT 'category', category, units_sold FROM fmcg_sales),
t AS (SELECT column_name, key_value, COUNT(*) AS n_rows, CAST(SUM(units_sold) AS BIGINT) AS units FROM k GROUP BY column_name, key_value)
"""
_SALES_COLUMNS = ("sale_id load_id date sku brand category segment channel region pack_type price_unit promotion_flag delivery_days stock_available delivered_qty units_sold").split()
_INVALID = {"units_sold": "units_sold NOT BETWEEN 0 AND 20000", "promotion_flag": "promotion_flag NOT IN (0, 1)"} | {r.column: f"NOT regexp_full_match({r.column}, '{r.pattern}')" for r in PATTERN_RULES}

SQL = {
    "p2_found": _METRICS + """
SELECT table_name, column_name, load_id, 'nulls' AS check_name FROM c WHERE ABS(null_share - prev_null_share) > 0.153
UNION ALL SELECT table_name, column_name, load_id, 'violation' FROM c WHERE n_rows > n_nulls AND n_invalid / (n_rows - n_nulls) > 0.053
UNION ALL SELECT table_name, column_name, load_id, 'shift' FROM c WHERE CASE column_name
  WHEN 'units_sold' THEN valid_median > 2 * prev_valid_median OR prev_valid_median > 2 * valid_median
  WHEN 'promotion_flag' THEN ABS(valid_mean - prev_valid_mean) > 0.253 ELSE ABS(valid_median - prev_valid_median) > 8 END""",
    "p2_profile": _METRICS + "SELECT table_name, column_name, load_id, n_rows, n_nulls, n_invalid, n_distinct, min_value, max_value, valid_median, prev_valid_median FROM c",
    "p2_control": _METRICS + """, l AS (
  SELECT table_name, column_name, load_id, feed, load_no, UNNEST([{'metric': 'null_share', 'value': null_share}, {'metric': 'invalid_share', 'value': n_invalid / NULLIF(n_rows - n_nulls, 0)},
    {'metric': 'valid_mean', 'value': valid_mean}, {'metric': 'valid_median', 'value': valid_median}], recursive := true) FROM c WHERE feed IS NOT NULL), w AS (
  SELECT *, AVG(value) OVER h AS mean, STDDEV_SAMP(value) OVER h AS sd, COUNT(value) OVER h AS known
  FROM l WINDOW h AS (PARTITION BY table_name, column_name, metric, feed ORDER BY load_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT table_name, column_name, load_id, metric, ROUND(value, 9) AS value FROM w WHERE known >= 4 AND ABS(value - mean) > 3 * sd + 1e-9 * GREATEST(1, ABS(mean))""",
    "p2_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_nulls, COUNT({c}) FILTER (WHERE {_INVALID.get(c, 'FALSE')}) AS n_invalid, "
        f"CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM fmcg_sales"
        for c in _SALES_COLUMNS
    ),
    "p4_found": _ORPHANS + "SELECT DISTINCT table_name, row_id FROM o",
    "p4_report": _ORPHANS + "SELECT table_name, strftime(date, '%Y-%m') AS month, COUNT(*) AS n_rows, COUNT(DISTINCT brand) AS n_keys FROM o GROUP BY 1, 2",
    "p5_found": _RECORDS + "SELECT line_id, reason FROM x WHERE reason IS NOT NULL",
    "p5_valid": _RECORDS + "SELECT line_id, nullif(brand, '') AS brand, nullif(category, '') AS category, nullif(manufacturer, '') AS manufacturer, TRY_CAST(nullif(launch_year, '') AS BIGINT) AS launch_year FROM x WHERE reason IS NULL",
    "p6_found": _TOTALS + "SELECT column_name, key_value FROM t WHERE key_value IS NOT NULL AND n_rows * 100 >= 3 * (SELECT COUNT(*) FROM fmcg_sales)",
    "p6_totals": _TOTALS + "SELECT column_name, key_value, n_rows, units FROM t",
}
