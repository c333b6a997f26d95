"""Rule-driven column expressions: unit conversion (S12), classes (S13), levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@dataclass(frozen=True)
class UnitRule:
    """``value -> (value + offset) * scale`` when the unit is ``from_unit``."""

    characteristic: str
    from_unit: str
    to_unit: str
    scale: float
    offset: float


# The temperature characteristics converted to Celsius.
DEFAULT_UNIT_RULES = (
    UnitRule("Temperature, water", "deg F", "deg C", 5.0 / 9.0, -32.0),
    UnitRule("Temperature, air", "deg F", "deg C", 5.0 / 9.0, -32.0),
)


def convert_units(name_col, value_col, unit_col, rules: Sequence[UnitRule] = DEFAULT_UNIT_RULES,
                  strict_units: bool = False) -> Column:
    """S12 value part: converted value for rows whose characteristic has a rule.

    Rows in ``from_unit`` are converted, rows already in ``to_unit`` kept.  Any
    other unit is kept unchanged (parity) or nulled with ``strict_units``.
    """
    name, value, unit = _c(name_col), _c(value_col), _c(unit_col)
    out = value
    for r in reversed(list(rules)):
        converted = (value + F.lit(r.offset)) * F.lit(r.scale)
        other = F.when(unit == r.to_unit, value).otherwise(F.lit(None).cast("double")) if strict_units else value
        out = F.when(name == r.characteristic,
                     F.when(unit == r.from_unit, converted).otherwise(other)).otherwise(out)
    return out


def standardised_unit(name_col, unit_col, rules: Sequence[UnitRule] = DEFAULT_UNIT_RULES) -> Column:
    """S12 unit part: every row of a ruled characteristic is labelled ``to_unit``."""
    name, unit = _c(name_col), _c(unit_col)
    out = unit
    for r in reversed(list(rules)):
        out = F.when(name == r.characteristic, F.lit(r.to_unit)).otherwise(out)
    return out


# Interpretation bands per target, in order.  Each band is
# (comparison, bound, label, detail); the last entry of a target is its
# catch-all (comparison None).
TARGET_RULES = {
    "pH": [
        ("<", 6.5, "Acidic", "Below the common neutral-to-healthy range for many freshwater systems."),
        ("<=", 8.5, "Balanced", "Within a common freshwater range and generally suitable for aquatic life."),
        (None, None, "Basic", "Above the common freshwater range and more alkaline than neutral."),
    ],
    "Water Temperature": [
        ("<", 5.0, "Very Cold", "Cold-water conditions; fine for some species but stressful for others."),
        ("<=", 20.0, "Moderate", "A generally favorable temperature range for many freshwater ecosystems."),
        ("<=", 28.0, "Warm", "Warmer water can begin reducing oxygen availability and increase stress."),
        (None, None, "Very Warm", "Potentially stressful for aquatic life, especially when oxygen is limited."),
    ],
    "Dissolved Oxygen": [
        ("<", 5.0, "Low Oxygen", "Below 5 mg/L and often stressful for aquatic life."),
        ("<", 7.0, "Fair", "Above the minimum stress threshold, but not yet in the healthier range."),
        ("<=", 19.0, "Healthy", "Within the 7-19 mg/L range, which is generally healthy for freshwater habitats."),
        (None, None, "Very High",
         "Above 19 mg/L; oxygen is abundant, though extremely high values can reflect unusual conditions."),
    ],
    "Nitrate": [
        ("<", 1.0, "Low", "Low nitrate concentration and generally not a nutrient concern."),
        ("<", 3.0, "Moderate", "Some nutrient presence, but not unusually elevated."),
        ("<", 10.0, "Elevated", "Higher nitrate levels that may indicate runoff or nutrient loading."),
        (None, None, "High Concern", "Strongly elevated nitrate and a clearer water-quality concern."),
    ],
}
UNKNOWN_LABEL = ("Unknown", "No interpretation available.")

# Display unit per target.
TARGET_UNITS = {"Water Temperature": "°C", "pH": "pH", "Dissolved Oxygen": "mg/L", "Nitrate": "mg/L"}
MEASURED_LABEL = ("Measured", "Predicted value available.")


def _band_chain(value: Column, bands, field: int) -> Column:
    out = None
    for cmp, bound, *texts in bands:
        text = F.lit(texts[field])
        if cmp is None:
            out = text if out is None else out.otherwise(text)
            break
        cond = value < F.lit(bound) if cmp == "<" else value <= F.lit(bound)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def _classify(value_col, target, field: int, rules) -> Column:
    value = _c(value_col)
    missing = value.isNull() | F.isnan(value)
    unknown = F.lit(UNKNOWN_LABEL[field])
    if isinstance(target, str) or target is None:
        if target not in rules:
            body = F.lit(MEASURED_LABEL[field])
        else:
            body = _band_chain(value, rules[target], field)
        return F.when(missing | F.lit(target is None), unknown).otherwise(body)
    tcol = _c(target)
    body = F.lit(MEASURED_LABEL[field])
    for name in reversed(list(rules)):
        body = F.when(tcol == name, _band_chain(value, rules[name], field)).otherwise(body)
    return F.when(missing | tcol.isNull(), unknown).otherwise(body)


def classify(value_col, target, rules=TARGET_RULES) -> Column:
    """Interpretation label of a value for a target (literal name or column)."""
    return _classify(value_col, target, 0, rules)


def classify_detail(value_col, target, rules=TARGET_RULES) -> Column:
    """The explanatory text that goes with ``classify``."""
    return _classify(value_col, target, 1, rules)


def bucket5(value_col, lo_col, hi_col) -> Column:
    """Level 0..4 at 0.2/0.4/0.6/0.8 of [lo, hi]; 2 when ``hi <= lo``."""
    value, lo, hi = _c(value_col), _c(lo_col), _c(hi_col)
    scaled = (value - lo) / (hi - lo)
    return (F.when(hi <= lo, F.lit(2))
            .when(scaled < 0.2, F.lit(0))
            .when(scaled < 0.4, F.lit(1))
            .when(scaled < 0.6, F.lit(2))
            .when(scaled < 0.8, F.lit(3))
            .otherwise(F.lit(4)))
