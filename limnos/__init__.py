"""limnos — Spark-native operators for environmental-monitoring analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function whose column
names are arguments, so they chain with ``df.transform``.  Heavy work stays in
Catalyst / Tungsten (built-in expressions, joins, aggregates, windows); Python
only touches tiny per-group solves and driver-side plan choices.
"""

from limnos.session import get_session, qcol, scratch_path, table

__all__ = ["get_session", "qcol", "scratch_path", "table"]
