"""Sources and sinks (IO1-IO5); model persistence (IO6) lives in ``limnos.operators.learners``."""

from limnos.sources.files import read_geojson_points, read_optional, read_table_csv, write_geojson_points, write_table

__all__ = ["read_geojson_points", "read_optional", "read_table_csv", "write_geojson_points", "write_table"]
