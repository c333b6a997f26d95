"""Key joins, set comparisons and date fan-out.

Join strategy is left to Catalyst + AQE: a side is broadcast at runtime
only when its measured size is under the threshold; no hint is given here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.reshape import dedup_first
from limnos.session import qcol


def _key_cond(left: DataFrame, right: DataFrame, lkeys: Sequence[str], rkeys: Sequence[str],
              null_safe: bool) -> Column:
    conds = []
    for lk, rk in zip(lkeys, rkeys, strict=True):
        lc, rc = left[lk], right[rk]
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    return reduce(lambda a, b: a & b, conds)


def join_on_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None,
                 how: str = "left", null_safe: bool = False, drop_right_keys: bool = True) -> DataFrame:
    """Equi-join with possibly different key names on each side.

    ``null_safe=True`` gives pandas ``merge`` semantics (NULL matches NULL,
    via ``<=>``, still a hash/sort-merge join); the default is SQL semantics.
    """
    right_keys = list(right_keys or left_keys)
    if not null_safe and list(left_keys) == right_keys:
        out = left.join(right, on=list(left_keys), how=how)
        return out
    r = right
    clash = [k for k in right_keys if k in left.columns]
    renamed = {k: f"__r_{k}" for k in clash}
    r = r.withColumnsRenamed(renamed)
    rk = [renamed.get(k, k) for k in right_keys]
    out = left.join(r, _key_cond(left, r, left_keys, rk, null_safe), how)
    if drop_right_keys:
        out = out.drop(*rk)
    return out


def left_join_dedup(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                    order: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Dedup the right side to its first row per key, then left join (no fan-out)."""
    return join_on_keys(left, dedup_first(right, right_keys, order), left_keys, right_keys,
                        how="left", null_safe=null_safe)


def attach_map(df: DataFrame, mapping: DataFrame, keys: Sequence[str], one_per_id: str | None = None,
               order: Sequence[str] = ()) -> DataFrame:
    """Left join a lookup map (e.g. nearest-station map).

    The map may hold several rows per id (one per coordinate pair), which
    fans out like the reference; ``one_per_id='<id col>'`` keeps the first
    per id by ``order`` and joins on that id only.
    """
    if one_per_id:
        first = dedup_first(mapping, [one_per_id], list(order) or [c for c in mapping.columns if c != one_per_id])
        return df.join(first, on=[one_per_id], how="left")
    return df.join(mapping, on=list(keys), how="left")


def semi_join(df: DataFrame, other: DataFrame, keys: Sequence[str], other_keys: Sequence[str] | None = None,
              anti: bool = False) -> DataFrame:
    """Keep (or, with ``anti``, drop) rows whose key occurs in ``other``.

    ``other`` is reduced to its distinct keys first (a partial aggregate), so
    the join's build side is the key set, not every row of a large table.
    """
    other_keys = list(other_keys or keys)
    o = other.select(*[qcol(k).alias(f"__s{i}") for i, k in enumerate(other_keys)]).distinct()
    cond = reduce(lambda a, b: a & b, [df[k] == o[f"__s{i}"] for i, k in enumerate(keys)])
    return df.join(o, cond, "left_anti" if anti else "left_semi")


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Distinct key counts — left, right, both, left-only, right-only — in one job.

    Distinct keys are tagged per side, full-outer-joined, then one aggregate.
    """
    right_key = right_key or left_key
    lk = left.select(qcol(left_key).alias("__k")).filter(F.col("__k").isNotNull()).distinct() \
        .withColumn("__l", F.lit(True))
    rk = right.select(qcol(right_key).alias("__k")).filter(F.col("__k").isNotNull()).distinct() \
        .withColumn("__r", F.lit(True))
    both = lk.join(rk, on="__k", how="full")
    return both.agg(
        F.count_if(F.col("__l")).alias("left_keys"),
        F.count_if(F.col("__r")).alias("right_keys"),
        F.count_if(F.col("__l") & F.col("__r")).alias("both_keys"),
        F.count_if(F.col("__l") & F.col("__r").isNull()).alias("left_only_keys"),
        F.count_if(F.col("__r") & F.col("__l").isNull()).alias("right_only_keys"),
    )


def with_dates(df: DataFrame, start: dt.date | str | Column, end: dt.date | str | Column,
               name: str = "date") -> DataFrame:
    """One row per entity per date in ``[start, end]``.

    A generator (``explode(sequence)``) rather than a join: each input row
    expands in place inside its own task, no shuffle and no join.
    """
    s = start if isinstance(start, Column) else F.lit(str(start)).cast("date")
    e = end if isinstance(end, Column) else F.lit(str(end)).cast("date")
    return df.withColumn(name, F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY"))))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack result frames by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
