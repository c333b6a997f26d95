"""Catalogue: ingest, quality, scalar functions, reshaping and key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import (classify, classify_detail, combine_date_time, convert_units, day_of_year,
                              mask_unless_in, month_abbr, round_half_even, standardised_unit, strip_suffix,
                              strip_thousands, suppression_to_null, to_day, to_number, to_ts_strict, year_key)
from limnos.functions.calendar import MONTH_KEYS
from limnos.functions.rules import UnitRule
from limnos.operators.joins import join_on_keys, key_overlap, semi_join
from limnos.operators.quality import (blank_to_null, drop_if_present, drop_sparse_columns, keep_in,
                                      missing_report, normalize_columns, prefix_columns, profile, range_counts,
                                      select_available, with_constant)
from limnos.operators.reshape import (dataset_summary, dedup_first, describe_numeric, distinct_count,
                                      keep_top_categories,
                                      latest_per_entity, pivot_first, preview, top_categories, value_counts)
from limnos.plans.registry import iso_date, iso_ts, pseudo_lat, pseudo_lon, r6, register, sql_lat, sql_lon
from limnos.session import scratch_path, table
from limnos.sources.files import (read_geojson_points, read_optional, read_table_csv, write_geojson_points,
                                  write_table)

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


# ------------------------------------------------------------ match rate
def match_rate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A11 + A14: samples (orders on a January calendar) left-joined to
    daily per-station totals of the event feed, summarised in one row."""
    samples = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 150).alias("station"),
        F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("o_orderdate")).alias("o_day"))
    daily = (table(spark, sf_dir, "events").groupBy("user_id", to_day("ts").alias("day"))
             .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")))
    joined = join_on_keys(samples, daily, ["station", "o_day"], ["user_id", "day"], how="left")
    s = dataset_summary(joined, "o_orderkey", "o_day", matched_col="total")
    return s.select("n_rows", "distinct_ids", iso_date("first_date").alias("first_date"),
                    iso_date("last_date").alias("last_date"), "matched_rows", r6("match_pct", 4).alias("match_pct"))


register("match_rate", sql="""
WITH o AS (SELECT o_orderkey, o_custkey % 150 AS station,
                  make_date(2024, 1, CAST(day(o_orderdate) AS INTEGER)) AS o_day FROM orders),
w AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2),
j AS (SELECT o.*, w.total FROM o LEFT JOIN w ON o.station = w.user_id AND o.o_day = w.day)
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS distinct_ids,
       CAST(min(o_day) AS VARCHAR) AS first_date, CAST(max(o_day) AS VARCHAR) AS last_date,
       count(total) AS matched_rows,
       round(avg(CASE WHEN total IS NOT NULL THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS match_pct
FROM j
""")(match_rate_query)


# ----------------------------------------------------------- csv round trip
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1 + IO2 + IO5: orders exported as CSV (with planted missing tokens, a
    token in blanks, quotes and line feeds) and read back as text, then typed leniently."""
    o = table(spark, sf_dir, "orders")
    export = o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("NA")).when(F.col("o_orderkey") % 13 == 0, F.lit("<NA>"))
        .when(F.col("o_orderkey") % 17 == 0, F.lit(" NA ")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit('first "line",\nsecond')).otherwise(F.lit("one line")).alias("note"))
    path = write_table(export, scratch_path(spark, "orders-csv"), fmt="csv")
    back = read_table_csv(spark, path, types={"o_orderkey": "bigint", "o_custkey": "bigint",
                                              "o_totalprice": "double"}, timestamps=["o_orderdate"], multiline=True)
    return back.withColumn("o_orderdate", iso_ts("o_orderdate"))


register("csv_roundtrip", sql="""
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN ' NA ' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 5 = 0 THEN 'first "line",' || chr(10) || 'second' ELSE 'one line' END AS note
FROM orders
""")(csv_roundtrip)


# ------------------------------------------------------------ geojson points
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO3 + IO4 + J10: weather-station features derived from ``supplier``,
    written as GeoJSON, read back, plus an optional (absent) extra file,
    kept only for stations that occur in the measurements."""
    sup = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("s_name"),
        pseudo_lat("s_suppkey").alias("lat"), pseudo_lon("s_suppkey").alias("lon"))
    path = write_geojson_points(sup, scratch_path(spark, "stations-geojson"), "s_suppkey", "s_name", "lat", "lon")
    pts = read_geojson_points(spark, path, collection=False)
    extra = read_optional(spark, scratch_path(spark, "absent"), pts.schema, fmt="json")
    pts = pts.unionByName(extra)
    used = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("sid"))
    return semi_join(pts, used, ["id"], ["sid"])


register("geojson_points", sql=f"""
SELECT CAST(s_suppkey AS VARCHAR) AS id,
       CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS name,
       {sql_lat('s_suppkey')} AS lat, {sql_lon('s_suppkey')} AS lon
FROM supplier WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)
""")(geojson_points)


# ------------------------------------------------------------ clean strings
def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2 + S4 + S5 + S6 on ``part`` with planted messy names, blanks,
    suppression codes, thousands separators and unit suffixes."""
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        k.alias(" Part Key "),
        F.when(k % 5 == 0, F.concat("p_name", F.lit(", MEASURED IN $"))).otherwise(F.col("p_name")).alias("Part Name"),
        F.when(k % 11 == 0, F.lit("   ")).otherwise(F.col("p_type")).alias("Part Type"),
        F.when(k % 13 == 0, F.lit("(D)")).when(k % 17 == 0, F.lit(" (Z) ")).otherwise(F.col("p_brand")).alias("Brand "),
        F.when(k >= 1000, F.concat((k / 1000).cast("bigint").cast("string"), F.lit(","),
                                   F.lpad((k % 1000).cast("string"), 3, "0")))
        .otherwise(k.cast("string")).alias("Key Text"))
    df = blank_to_null(normalize_columns(raw))
    return df.select("Part_Key", strip_suffix("Part_Name").alias("Part_Name"), "Part_Type",
                     suppression_to_null("Brand").alias("Brand"),
                     to_number(strip_thousands("Key_Text")).alias("Key_Num"))


register("clean_strings", sql=r"""
WITH raw AS (
  SELECT p_partkey AS k,
         CASE WHEN p_partkey % 5 = 0 THEN p_name || ', MEASURED IN $' ELSE p_name END AS nm,
         CASE WHEN p_partkey % 11 = 0 THEN '   ' ELSE p_type END AS ty,
         CASE WHEN p_partkey % 13 = 0 THEN '(D)' WHEN p_partkey % 17 = 0 THEN ' (Z) ' ELSE p_brand END AS br,
         CASE WHEN p_partkey >= 1000
              THEN CAST(p_partkey // 1000 AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')
              ELSE CAST(p_partkey AS VARCHAR) END AS kt
  FROM part)
SELECT k AS Part_Key,
       regexp_replace(nm, ', MEASURED IN .*$', '') AS Part_Name,
       CASE WHEN regexp_full_match(ty, '\s*') THEN NULL ELSE ty END AS Part_Type,
       CASE WHEN trim(br) IN ('(D)', '(H)', '(Z)', '(NA)') THEN NULL ELSE br END AS Brand,
       TRY_CAST(replace(kt, ',', '') AS DOUBLE) AS Key_Num
FROM raw
""")(clean_strings)


# --------------------------------------------------- sparse columns / report
def _planted_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.when(k % 100 < 5, F.col("c_acctbal")).alias("fill_5"),
        F.when(k % 100 < 20, F.col("c_nationkey")).alias("fill_20"),
        F.when(k % 100 < 50, F.col("c_mktsegment")).alias("fill_50"),
        F.lit(None).cast("string").alias("helper"))


def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + P5/P6 + P8 + P9 + P13: drop columns under 10% filled, project,
    add a constant and round half-to-even."""
    df = drop_sparse_columns(_planted_customer(spark, sf_dir), 0.10)
    df = select_available(df, ["c_custkey", "c_name", "fill_20", "fill_50", "fill_5", "helper", "c_acctbal",
                               "not_a_column"])
    df = with_constant(drop_if_present(df, "c_name", "also_absent"), "state", "IOWA")
    return (df.withColumn("acctbal_third", round_half_even(F.col("c_acctbal") / 3.0, 4))
            .withColumn("fill_20", F.col("fill_20").cast("double")))


register("sparse_columns", sql="""
SELECT c_custkey,
       CAST(CASE WHEN c_custkey % 100 < 20 THEN c_nationkey END AS DOUBLE) AS fill_20,
       CASE WHEN c_custkey % 100 < 50 THEN c_mktsegment END AS fill_50,
       c_acctbal, 'IOWA' AS state, round_even(c_acctbal / CAST(3 AS DOUBLE), 4) AS acctbal_third
FROM customer
""")(sparse_columns)


def missing_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P11: per-column null counts and percent of the planted customer table."""
    rep = missing_report(_planted_customer(spark, sf_dir))
    return rep.select("column_name", "position", "null_count", r6("percent_missing", 4).alias("percent_missing"))


_MR_COLS = [("c_custkey", "c_custkey"), ("c_name", "c_name"), ("c_nationkey", "c_nationkey"),
            ("c_acctbal", "c_acctbal"), ("c_mktsegment", "c_mktsegment"),
            ("fill_5", "CASE WHEN c_custkey % 100 < 5 THEN c_acctbal END"),
            ("fill_20", "CASE WHEN c_custkey % 100 < 20 THEN c_nationkey END"),
            ("fill_50", "CASE WHEN c_custkey % 100 < 50 THEN c_mktsegment END"),
            ("helper", "CAST(NULL AS VARCHAR)")]
register("missing_report", sql="\nUNION ALL\n".join(
    f"SELECT '{name}' AS column_name, {i} AS position, count(*) FILTER (WHERE ({expr}) IS NULL) AS null_count, "
    f"round(CAST(count(*) FILTER (WHERE ({expr}) IS NULL) AS DOUBLE) * 100 / count(*), 4) AS percent_missing "
    f"FROM customer" for i, (name, expr) in enumerate(_MR_COLS)))(missing_report_query)


def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column of the planted customer table: type, non-null and null counts."""
    return profile(_planted_customer(spark, sf_dir))


_PROFILE_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                  "c_mktsegment": "string", "fill_5": "double", "fill_20": "int", "fill_50": "string",
                  "helper": "string"}
register("profile_customer", sql="\nUNION ALL\n".join(
    f"SELECT '{name}' AS column_name, {i} AS position, '{_PROFILE_TYPES[name]}' AS data_type, "
    f"count({expr}) AS non_null, count(*) - count({expr}) AS null_count, count(*) AS rows FROM customer"
    for i, (name, expr) in enumerate(_MR_COLS)))(profile_customer)


# ---------------------------------------------------------------- describe
_DESC_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + A12: count, mean, std, min, quartiles, max, 2nd and 98th percentile."""
    d = describe_numeric(table(spark, sf_dir, "lineitem"), _DESC_COLS, extra_percentiles=(0.02, 0.98))
    return d.select("column_name", "count", *[r6(c).alias(c) for c in
                                                ("mean", "std", "min", "q25", "q50", "q75", "max", "p02", "p98")])


register("describe_lineitem", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max, "
    f"round(quantile_cont({c}, 0.02), 6) AS p02, round(quantile_cont({c}, 0.98), 6) AS p98 FROM lineitem"
    for c in _DESC_COLS))(describe_lineitem)


# ------------------------------------------------------------ lenient casts
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2 + S2b + S3: numbers from text with planted junk; date and time
    text rejoined and parsed leniently (bad date, missing time -> NULL);
    strict parse of the always-valid date text."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    digits = F.regexp_replace("props", "[^0-9]", "")
    k_text = F.when(eid % 10 == 0, F.concat(F.lit("x"), digits)).otherwise(digits)
    d_text = F.date_format("ts", "yyyy-MM-dd")
    d_bad = F.when(eid % 13 == 0, F.lit("2024-02-30")).otherwise(d_text)
    t_text = F.when(eid % 9 == 0, F.lit(None)).otherwise(F.date_format("ts", "HH:mm:ss"))
    return e.select("event_id", to_number(k_text).alias("k_num"),
                    iso_ts(combine_date_time(d_bad, t_text)).alias("ts_joined"),
                    iso_ts(to_ts_strict(d_text)).alias("day_strict"))


register("lenient_casts", sql="""
SELECT event_id,
       CASE WHEN event_id % 10 = 0 THEN NULL
            ELSE TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE) END AS k_num,
       strftime(try_strptime(CASE WHEN event_id % 13 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END
                             || ' ' || CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%H:%M:%S') END,
                             '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts_joined,
       strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS day_strict
FROM events
""")(lenient_casts)


# ------------------------------------------------------------ calendar keys
def calendar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, ISO key, year, month abbreviation, day of year, masked period."""
    o = table(spark, sf_dir, "orders")
    period = F.when(F.col("o_orderstatus") == "P", F.lit("YEAR")).otherwise(month_abbr("o_orderdate"))
    return o.select("o_orderkey", iso_date(to_day("o_orderdate")).alias("day"),
                    F.date_format(to_day("o_orderdate"), "yyyy-MM-dd").alias("day_key"),
                    year_key("o_orderdate").alias("year"), month_abbr("o_orderdate").alias("mon"),
                    day_of_year("o_orderdate").alias("doy"), mask_unless_in(period, MONTH_KEYS).alias("month"))


register("calendar_keys", sql="""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m-%d') AS day_key,
       CAST(year(o_orderdate) AS INTEGER) AS year, upper(strftime(o_orderdate, '%b')) AS mon,
       CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE upper(strftime(o_orderdate, '%b')) END AS month
FROM orders
""")(calendar_keys)


# --------------------------------------------------------- unit standardise
_RULES = (UnitRule("Temperature, water", "deg F", "deg C", 5.0 / 9.0, -32.0),
          UnitRule("Temperature, air", "deg F", "deg C", 5.0 / 9.0, -32.0))


def unit_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fahrenheit -> Celsius for the temperature characteristics; their
    unit becomes ``deg C`` on every row (parity); strict mode nulls unknown units."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    name = (F.when(F.col("event_type") == "view", F.lit("Temperature, water"))
            .when(F.col("event_type") == "click", F.lit("Temperature, air")).otherwise(F.col("event_type")))
    unit = (F.when(eid % 7 == 0, F.lit(None)).when(eid % 3 == 0, F.lit("deg F"))
            .when(eid % 3 == 1, F.lit("deg C")).otherwise(F.lit("K")))
    src = e.select("event_id", name.alias("characteristic"), "value", unit.alias("unit"))
    return src.select("event_id", "characteristic",
                      r6(convert_units("characteristic", "value", "unit", _RULES)).alias("value"),
                      r6(convert_units("characteristic", "value", "unit", _RULES, strict_units=True))
                      .alias("value_strict"),
                      standardised_unit("characteristic", "unit", _RULES).alias("unit"))


register("unit_standardise", sql="""
WITH src AS (
  SELECT event_id,
         CASE WHEN event_type = 'view' THEN 'Temperature, water'
              WHEN event_type = 'click' THEN 'Temperature, air' ELSE event_type END AS characteristic,
         value,
         CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'deg F'
              WHEN event_id % 3 = 1 THEN 'deg C' ELSE 'K' END AS unit
  FROM events)
SELECT event_id, characteristic,
       round(CASE WHEN characteristic IN ('Temperature, water', 'Temperature, air') AND unit = 'deg F'
                  THEN (value + CAST(-32 AS DOUBLE)) * (CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE)) ELSE value END, 6) AS value,
       round(CASE WHEN characteristic IN ('Temperature, water', 'Temperature, air')
                  THEN CASE WHEN unit = 'deg F' THEN (value + CAST(-32 AS DOUBLE)) * (CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE))
                            WHEN unit = 'deg C' THEN value END
                  ELSE value END, 6) AS value_strict,
       CASE WHEN characteristic IN ('Temperature, water', 'Temperature, air') THEN 'deg C' ELSE unit END AS unit
FROM src
""")(unit_standardise)


# ---------------------------------------------------------- classify values
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + F3: interpretation labels of scaled quantities under the four
    target rule sets (bounds hit exactly), plus an unruled target."""
    li = table(spark, sf_dir, "lineitem")
    q = F.when(F.col("l_orderkey") % 50 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
    return li.select(
        "l_orderkey", "l_linenumber", q.alias("q")).select(
        "l_orderkey", "l_linenumber", "q",
        classify(F.col("q") * 0.25, "pH").alias("ph_label"),
        classify_detail(F.col("q") * 0.25, "pH").alias("ph_detail"),
        classify(F.col("q"), "Water Temperature").alias("temp_label"),
        classify(F.col("q") * 0.5, "Dissolved Oxygen").alias("do_label"),
        classify(F.col("q") * 0.25, "Nitrate").alias("nitrate_label"),
        classify(F.col("q"), "Conductivity").alias("other_label"))


register("classify_values", sql="""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, q,
  CASE WHEN q IS NULL THEN 'Unknown' WHEN q * 0.25 < 6.5 THEN 'Acidic' WHEN q * 0.25 <= 8.5 THEN 'Balanced' ELSE 'Basic' END AS ph_label,
  CASE WHEN q IS NULL THEN 'No interpretation available.'
       WHEN q * 0.25 < 6.5 THEN 'Below the common neutral-to-healthy range for many freshwater systems.'
       WHEN q * 0.25 <= 8.5 THEN 'Within a common freshwater range and generally suitable for aquatic life.'
       ELSE 'Above the common freshwater range and more alkaline than neutral.' END AS ph_detail,
  CASE WHEN q IS NULL THEN 'Unknown' WHEN q < 5 THEN 'Very Cold' WHEN q <= 20 THEN 'Moderate'
       WHEN q <= 28 THEN 'Warm' ELSE 'Very Warm' END AS temp_label,
  CASE WHEN q IS NULL THEN 'Unknown' WHEN q * 0.5 < 5 THEN 'Low Oxygen' WHEN q * 0.5 < 7 THEN 'Fair'
       WHEN q * 0.5 <= 19 THEN 'Healthy' ELSE 'Very High' END AS do_label,
  CASE WHEN q IS NULL THEN 'Unknown' WHEN q * 0.25 < 1 THEN 'Low' WHEN q * 0.25 < 3 THEN 'Moderate'
       WHEN q * 0.25 < 10 THEN 'Elevated' ELSE 'High Concern' END AS nitrate_label,
  CASE WHEN q IS NULL THEN 'Unknown' ELSE 'Measured' END AS other_label
FROM s
""")(classify_values)


# ------------------------------------------------------ range filter counts
def range_filter_counts(spark: SparkSession, sf_dir: str, min_rows: int = 15_000) -> DataFrame:
    """F2 + F4 + F5 + J14: per target (return flag) rows before and after its
    physical-range filter, and whether the target passes the row gate."""
    li = keep_in(table(spark, sf_dir, "lineitem"), "l_linestatus", ["O", "F"])
    flag = F.col("l_returnflag")
    lo = F.when(flag == "A", 5.0).when(flag == "N", 0.0).otherwise(10.0)
    hi = F.when(flag == "A", 45.0).when(flag == "N", 30.0).otherwise(50.0)
    counts = range_counts(li, "l_quantity", lo, hi, by=["l_returnflag"])
    return counts.select(F.col("l_returnflag").alias("target"), "rows_before_filter", "rows_used",
                         (F.col("rows_used") >= F.lit(min_rows)).alias("passes_gate"))


register("range_filter_counts", sql="""
WITH li AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 5.0 WHEN 'N' THEN 0.0 ELSE 10.0 END AS lo,
                      CASE l_returnflag WHEN 'A' THEN 45.0 WHEN 'N' THEN 30.0 ELSE 50.0 END AS hi
            FROM lineitem WHERE l_linestatus IN ('O', 'F'))
SELECT l_returnflag AS target, count(*) AS rows_before_filter,
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_quantity >= lo AND l_quantity <= hi) AS rows_used,
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_quantity >= lo AND l_quantity <= hi) >= 15000 AS passes_gate
FROM li GROUP BY l_returnflag
""")(range_filter_counts)


# ------------------------------------------------- counts and top categories
register("value_counts", sql="""
SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type
""")(lambda spark, sf_dir: value_counts(table(spark, sf_dir, "events"), "event_type"))

register("top_brands", sql="""
SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10
""")(lambda spark, sf_dir: top_categories(table(spark, sf_dir, "part"), "p_brand", 10))


def top_brand_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of parts whose brand is among the ten most common."""
    parts = keep_top_categories(table(spark, sf_dir, "part"), "p_brand", 10).select("p_partkey", "p_brand")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    j = li.join(parts, li.l_partkey == parts.p_partkey, "inner")
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("sum_qty"),
                                    r6(F.sum("l_extendedprice"), 2).alias("sum_price"))


register("top_brand_items", sql="""
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p.p_brand, count(*) AS n_items, sum(l.l_quantity) AS sum_qty, round(sum(l.l_extendedprice), 2) AS sum_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p.p_brand IN (SELECT p_brand FROM top) GROUP BY p.p_brand
""")(top_brand_items)


# --------------------------------------------------------- distinct counts
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + A7 + A10: distinct keys, distinct rows, date range, mean — one aggregate."""
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count(F.lit(1)).alias("n_rows"), distinct_count("o_custkey").alias("distinct_customers"),
                  iso_date(F.min(to_day("o_orderdate"))).alias("first_day"),
                  iso_date(F.max(to_day("o_orderdate"))).alias("last_day"),
                  r6(F.avg("o_totalprice"), 4).alias("mean_price"),
                  # DISTINCT-row semantics: a struct with NULL fields is itself non-NULL.
                  F.count_distinct(F.struct("o_custkey", "o_orderstatus")).alias("distinct_pairs"))


register("distinct_counts", sql="""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS distinct_customers,
       CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day,
       CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day,
       round(avg(o_totalprice), 4) AS mean_price,
       (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS distinct_pairs
FROM orders
""")(distinct_counts)


register("key_overlap", sql="""
WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL),
     r AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT NULL)
SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys,
       (SELECT count(*) FROM (SELECT k FROM l INTERSECT SELECT k FROM r)) AS both_keys,
       (SELECT count(*) FROM (SELECT k FROM l EXCEPT SELECT k FROM r)) AS left_only_keys,
       (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM l)) AS right_only_keys
""")(lambda spark, sf_dir: key_overlap(table(spark, sf_dir, "orders"),
                                       table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0),
                                       "o_custkey", "c_custkey"))


# --------------------------------------------------------- first and latest
def dedup_first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event per (user, type) by (ts, event_id)."""
    d = dedup_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return d.withColumn("ts", iso_ts("ts"))


register("dedup_first", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1
""")(dedup_first_query)


def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + W1: per user, the last non-null value of every column in time order."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    src = e.select("user_id", "ts", "event_id",
                   F.when(eid % 5 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                   F.when(eid % 4 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"), "props")
    last = latest_per_entity(src, "user_id", "ts", tie="event_id")
    return last.withColumn("ts", iso_ts("ts"))


register("latest_per_user", sql="""
WITH src AS (SELECT user_id, ts, event_id,
                    CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
                    CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, props FROM events)
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts,
       arg_max(event_id, struct_pack(ts, event_id)) AS event_id,
       arg_max(event_type, struct_pack(ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type,
       arg_max(value, struct_pack(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value,
       arg_max(props, struct_pack(ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props
FROM src WHERE ts IS NOT NULL GROUP BY user_id
""")(latest_per_user)


# ---------------------------------------------------------- null-safe join
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J4: right side deduplicated once, then joined with SQL and with
    pandas (NULL matches NULL) key semantics in one chain."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("k"))
    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_custkey")).alias("ck"), "c_name")
    first = dedup_first(c, ["ck"], ["c_name"])
    sql_sem = join_on_keys(o, first.withColumnRenamed("c_name", "c_name_sql"), ["k"], ["ck"], how="left")
    both = join_on_keys(sql_sem, first.withColumnRenamed("c_name", "c_name_ns"), ["k"], ["ck"], how="left",
                        null_safe=True)
    return both.withColumn("k", F.col("k").cast("double"))


register("null_safe_join", sql="""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders),
c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS ck, c_name FROM customer),
cd AS (SELECT ck, min(c_name) AS c_name FROM c GROUP BY ck)
SELECT o.o_orderkey, CAST(o.k AS DOUBLE) AS k, a.c_name AS c_name_sql, b.c_name AS c_name_ns
FROM o LEFT JOIN cd a ON o.k = a.ck LEFT JOIN cd b ON o.k IS NOT DISTINCT FROM b.ck
""")(null_safe_join)


# -------------------------------------------------------- year/month joins
def year_month_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + S6 + P7 + P9 + J5 + J6: an agriculture-style long table (orders)
    pivoted to first non-null value per item, yearly and monthly, prefixed,
    and left-joined to a monthly roll-up of line items."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    long = o.select(
        year_key("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "P", F.lit("YEAR")).otherwise(month_abbr("o_orderdate")).alias("period"),
        F.lit("IOWA").alias("state"),
        strip_suffix(F.when(k % 4 == 0, F.concat("o_orderpriority", F.lit(", MEASURED IN $")))
                     .otherwise(F.col("o_orderpriority"))).alias("data_item"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("value"), "o_orderkey")
    # One pivot over (year, period, state) feeds both tables (one scan, one shuffle).
    cells = pivot_first(long.filter(F.col("period").isin([*MONTH_KEYS, "YEAR"])), ["year", "period", "state"],
                        "data_item", "value", PRIORITIES, ["o_orderkey"])
    monthly = prefix_columns(cells.filter(F.col("period") != "YEAR"), "AG_MONTH_",
                             except_=["year", "period", "state"]).withColumnRenamed("period", "month")
    yearly = prefix_columns(cells.filter(F.col("period") == "YEAR").drop("period"), "AG_YEAR_",
                            except_=["year", "state"])
    li = (table(spark, sf_dir, "lineitem")
          .groupBy(year_key("l_shipdate").alias("year"), month_abbr("l_shipdate").alias("month"))
          .agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("sum_qty")))
    li = with_constant(li, "state", "IOWA")
    out = join_on_keys(li, yearly, ["year", "state"], how="left")
    return join_on_keys(out, monthly, ["year", "month", "state"], how="left")


def _ag_cols(prefix: str) -> str:
    return ",\n       ".join(
        f"arg_min(value, o_orderkey) FILTER (WHERE data_item = '{p}') AS \"{prefix}{p}\"" for p in PRIORITIES)


register("year_month_joins", sql=f"""
WITH long AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN o_orderstatus = 'P' THEN 'YEAR' ELSE upper(strftime(o_orderdate, '%b')) END AS period,
         'IOWA' AS state,
         regexp_replace(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || ', MEASURED IN $'
                             ELSE o_orderpriority END, ', MEASURED IN .*$', '') AS data_item,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderkey
  FROM orders),
monthly AS (
  SELECT year, period AS month, state, {_ag_cols('AG_MONTH_')}
  FROM long WHERE value IS NOT NULL AND period IN ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC')
  GROUP BY year, period, state),
yearly AS (
  SELECT year, state, {_ag_cols('AG_YEAR_')}
  FROM long WHERE value IS NOT NULL AND period = 'YEAR' GROUP BY year, state),
li AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, upper(strftime(l_shipdate, '%b')) AS month,
         count(*) AS n_items, sum(l_quantity) AS sum_qty, 'IOWA' AS state
  FROM lineitem GROUP BY 1, 2)
SELECT li.*, y.* EXCLUDE (year, state), m.* EXCLUDE (year, month, state)
FROM li LEFT JOIN yearly y ON li.year = y.year AND li.state = y.state
        LEFT JOIN monthly m ON li.year = m.year AND li.month = m.month AND li.state = m.state
""")(year_month_joins)


# ------------------------------------------------------------------ preview
def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten orders by key."""
    p = preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 10)
    return p.select("o_orderkey", "o_custkey", "o_totalprice", iso_date(to_day("o_orderdate")).alias("day"))


register("preview", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
FROM orders ORDER BY o_orderkey LIMIT 10
""")(preview_query)

