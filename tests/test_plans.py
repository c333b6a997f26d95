"""Physical-plan properties of the catalogue: no cross products, no
row-at-a-time Python, pruned and filtered scans."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

LAZY = ["flagship_wide_join", "match_rate", "clean_strings", "describe_lineitem", "lenient_casts", "calendar_keys",
        "unit_standardise", "classify_values", "range_filter_counts", "top_brand_items", "distinct_counts",
        "key_overlap", "dedup_first", "latest_per_user", "null_safe_join", "year_month_joins", "seasonal_features",
        "imputed_matrix", "ols_moments", "ols_simple", "metrics_by_group", "score_dates", "score_calendar",
        "nearest_supplier", "grid_idw", "enriched_points", "merged_samples", "cleaning_report", "exact_split_sizes",
        "calendar_summary", "profile_customer", "geojson_points", "csv_roundtrip"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products_or_row_udfs(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(entry.queries()["top_brand_items"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert any(s == "struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" for s in schemas)
    assert "PushedFilters: [IsNotNull(l_partkey)]" in plan
    plan = _plan(entry.queries()["key_overlap"](spark, SF_SMALL))
    assert "GreaterThan(c_acctbal,0.0)" in plan


def test_pivot_is_one_exchange(spark):
    plan = _plan(entry.queries()["latest_per_user"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "partial_max_by" in plan               # map-side partial aggregation
