"""Query catalogue: each entry maps driver tables through library operators.

Every query reads whole tables (no id subsets or row caps); the matching
DuckDB SQL is the correctness oracle.  Computed doubles are rounded on both
sides so engine-specific last-ulp differences do not count as mismatches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import to_day
from limnos.operators.joins import join_on_keys
from limnos.operators.quality import drop_null_rows, fill_constants
from limnos.operators.reshape import keep_top_categories, pivot_value_unit
from limnos.plans.registry import ORACLE, QUERIES, iso_date, register
from limnos.session import table

__all__ = ["ORACLE", "QUERIES", "flagship_wide"]

# Declared characteristic list of the event feed (pivot columns are fixed
# up front so the pivot needs no discovery job and the schema is stable).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _pivot_sql(types, value, unit, order) -> str:
    parts = []
    for t in types:
        parts.append(f"arg_min({value}, {order}) FILTER (WHERE event_type = '{t}') AS {t}_value")
        parts.append(f"arg_min({unit}, {order}) FILTER (WHERE event_type = '{t}') AS {t}_unit")
    return ",\n       ".join(parts)


# --------------------------------------------------------------- flagship
def flagship_wide(spark: SparkSession, sf_dir: str, top_n: int = 4) -> DataFrame:
    """Entry 1 in miniature: top characteristics -> clean -> first per cell ->
    wide pivot per (station, day) -> left join to the station dimension."""
    events = table(spark, sf_dir, "events")
    # Top-n characteristics are counted before rows with missing values go.
    kept = keep_top_categories(events, "event_type", top_n)
    long = (kept.select("user_id", to_day("ts").alias("day"), "ts", "event_id", "event_type", "value",
                        F.col("props").alias("unit"))
            .transform(lambda d: drop_null_rows(d, ["user_id", "event_type", "value", "ts"])))
    wide = pivot_value_unit(long, ["user_id", "day"], "event_type", "value", "unit", EVENT_TYPES,
                            order=["ts", "event_id"])
    stations = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    joined = join_on_keys(wide, stations, ["user_id"], ["c_custkey"], how="left")
    out = fill_constants(joined, {"c_name": "Unknown station"})
    return out.withColumn("day", iso_date("day"))


register("flagship_wide_join", sql=f"""
WITH top AS (
  SELECT event_type FROM events WHERE event_type IS NOT NULL
  GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 4),
src AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type, value, props AS unit
  FROM events
  WHERE event_type IN (SELECT event_type FROM top)
    AND user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
wide AS (
  SELECT user_id, day,
       {_pivot_sql(EVENT_TYPES, 'value', 'unit', 'struct_pack(ts, event_id)')}
  FROM src GROUP BY user_id, day)
SELECT w.* REPLACE (CAST(w.day AS VARCHAR) AS day), coalesce(c.c_name, 'Unknown station') AS c_name, c.c_mktsegment, c.c_acctbal
FROM wide w LEFT JOIN customer c ON w.user_id = c.c_custkey
""")(flagship_wide)


# Importing the query modules registers their queries.
from limnos.plans import q_clean, q_flow, q_grid, q_ml, q_model, q_more, q_spatial  # noqa: E402,F401
