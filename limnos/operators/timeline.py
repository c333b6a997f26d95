"""Scoring over dates and the recent-score calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.rules import bucket5
from limnos.operators.features import impute_median
from limnos.session import qcol

Scorer = Callable[[DataFrame], DataFrame]  # adds a ``predicted`` column

CALENDAR_WEEKS = 14  # fixed value: weeks shown in the calendar
# Weekday labels, the calendar's columns start on Sunday.
WEEKDAY_LABELS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def _as_date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def score_entities(snapshot: DataFrame, scorer: Scorer, when, features: Sequence[str], doy_col: str = "doy"
                   ) -> DataFrame:
    """Every entity scored for one date; all snapshot columns kept plus ``predicted``.

    ``doy`` comes from the date, other inputs are median-filled from the snapshot (E11).
    """
    day = _as_date(when)
    frame = snapshot.withColumn(doy_col, F.lit(float(day.timetuple().tm_yday)))
    frame = impute_median(frame, [f for f in features if f != doy_col])
    return scorer(frame)


def score_dates(snapshot: DataFrame, scorer: Scorer, dates: Sequence, features: Sequence[str],
                doy_col: str = "doy") -> DataFrame:
    """M14 + A13 + J13: mean prediction over all entities for each date.

    Every entity is expanded in place (a generator, no join) to the distinct
    days of year among ``dates`` — scores only depend on ``doy`` — scored
    once per (entity, doy) and averaged per doy with a partial aggregate.
    """
    days = [_as_date(d) for d in dates]
    doys = sorted({d.timetuple().tm_yday for d in days})
    base = impute_median(snapshot, [f for f in features if f != doy_col])
    expanded = base.withColumn(doy_col, F.explode(F.array(*[F.lit(float(x)) for x in doys])))
    means = scorer(expanded).groupBy(doy_col).agg(F.avg("predicted").alias("mean_prediction"))
    frame = snapshot.sparkSession.createDataFrame([(d, float(d.timetuple().tm_yday)) for d in days],
                                                  f"date date, {doy_col} double")
    return frame.join(means, on=doy_col, how="left").select("date", doy_col, "mean_prediction")


def calendar_window(end_date, weeks: int = CALENDAR_WEEKS) -> tuple[dt.date, dt.date]:
    """Sunday..Saturday span of ``weeks`` weeks ending on the Saturday on/after ``end_date``."""
    end = _as_date(end_date)
    grid_end = end + dt.timedelta(days=(5 - end.weekday()) % 7)
    return grid_end - dt.timedelta(days=weeks * 7 - 1), grid_end


def score_calendar(daily: DataFrame, end_date, weeks: int = CALENDAR_WEEKS, date_col: str = "date",
                   value_col: str = "mean_prediction") -> DataFrame:
    """W4 + W5 + S14: one row per calendar day with week, weekday, level and month label.

    Levels 0-4 scale each past day's value to the min/max of the past days in
    the window; future days are level 0.  The month label shows on a week
    only when its first day's month differs from the previous week's.
    """
    end = _as_date(end_date)
    start, stop = calendar_window(end, weeks)
    spine = daily.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(stop), F.expr("INTERVAL 1 DAY"))).alias(date_col))
    vals = daily.select(qcol(date_col), qcol(value_col).alias("value"))
    cal = spine.join(vals, on=date_col, how="left")
    offset = F.datediff(qcol(date_col), F.lit(start))
    cal = cal.withColumns({"week": (offset / 7).cast("int"), "weekday_idx": (offset % 7).cast("int"),
                           "is_future": qcol(date_col) > F.lit(end)})
    past = Window.partitionBy(F.lit(0))  # the window is 7*weeks rows, bounded by the parameter
    hist = F.when(~F.col("is_future"), F.col("value"))
    cal = cal.withColumns({"window_low": F.min(hist).over(past), "window_high": F.max(hist).over(past)})
    week_start = F.date_sub(qcol(date_col), F.col("weekday_idx"))
    month = F.date_format(week_start, "MMM")
    prev = F.date_format(F.date_sub(week_start, 7), "MMM")
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return cal.select(
        qcol(date_col), "week", F.element_at(labels, F.col("weekday_idx") + 1).alias("weekday"),
        F.when(~F.col("is_future"), F.col("value")).alias("value"), "is_future",
        F.when(F.col("is_future"), F.lit(0)).otherwise(bucket5("value", "window_low", "window_high")).alias("level"),
        F.when((F.col("week") == 0) | (month != prev), month).otherwise(F.lit("")).alias("month_label"))


def calendar_summary(cal: DataFrame, end_date, date_col: str = "date") -> DataFrame:
    """Current value, mean and peak over the past days of the calendar window."""
    end = _as_date(end_date)
    past = cal.filter(~F.col("is_future"))
    return past.agg(F.max_by("value", qcol(date_col)).alias("current_value"), F.avg("value").alias("window_mean"),
                    F.max("value").alias("peak_value"), F.min("value").alias("window_low"),
                    F.count(F.lit(1)).alias("days")).withColumn("end_date", F.lit(end))
