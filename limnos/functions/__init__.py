"""Column-expression builders (scalar functions S1-S16, P13).

All return ``pyspark.sql.Column`` built from JVM-side functions so they stay
inside whole-stage codegen; none of them is a Python UDF.
"""

from limnos.functions.calendar import day_of_year, day_key, mask_unless_in, month_abbr, to_day, year_key
from limnos.functions.numeric import clip, log1p_nonneg, nonneg, round_half_even
from limnos.functions.parse import (NULL_TOKENS, combine_date_time, null_tokens_to_null, strip_suffix,
                                    strip_thousands, suppression_to_null, to_number, to_ts, to_ts_strict)
from limnos.functions.rules import (TARGET_RULES, UnitRule, bucket5, classify, classify_detail,
                                    convert_units, standardised_unit)

__all__ = [
    "NULL_TOKENS", "TARGET_RULES", "UnitRule", "bucket5", "classify", "classify_detail", "clip",
    "combine_date_time", "convert_units", "day_key", "day_of_year", "log1p_nonneg", "mask_unless_in",
    "month_abbr", "nonneg", "null_tokens_to_null", "round_half_even", "standardised_unit", "strip_suffix",
    "strip_thousands", "suppression_to_null", "to_day", "to_number", "to_ts", "to_ts_strict", "year_key",
]
