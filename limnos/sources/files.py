"""File sources and sinks.

CSV feeds are read as text first and typed afterwards, so the pandas notion
of "missing" (a set of tokens) and lenient casts apply uniformly; Parquet is
the format for every intermediate table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.parse import NULL_TOKENS, null_tokens_to_null, to_number, to_ts
from limnos.session import qcol


def read_table_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
                   timestamps: Sequence[str] = (), na_tokens: Sequence[str] = NULL_TOKENS,
                   ts_formats: Sequence[str] | None = None, multiline: bool = False) -> DataFrame:
    """IO1/IO2: CSV with a header; missing tokens -> NULL; typed leniently.

    ``types`` maps column name -> ``double``/``bigint``/``int``/``date``/
    ``timestamp``/``string``; unlisted columns stay strings.  Columns in
    ``timestamps`` are parsed as TIMESTAMP_NTZ.  Reading everything as text
    avoids schema inference (a full extra scan at scale).  ``multiline`` reads
    quoted fields that hold line feeds; such a file is one task's work, so leave
    it off for feeds without them.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("multiLine", multiline).option("escape", '"').csv(path))
    types = dict(types or {})
    for c in timestamps:
        types[c] = "timestamp"
    cols = []
    for name in raw.columns:
        c = null_tokens_to_null(qcol(name), na_tokens)
        kind = types.get(name, "string")
        if kind == "double":
            c = to_number(c)
        elif kind in ("bigint", "int", "long", "integer"):
            c = to_number(c).try_cast("bigint" if kind in ("bigint", "long") else "int")
        elif kind == "timestamp":
            c = to_ts(c) if ts_formats is None else to_ts(c, ts_formats)
        elif kind == "date":
            c = F.to_date(to_ts(c) if ts_formats is None else to_ts(c, ts_formats))
        cols.append(c.alias(name))
    return raw.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """IO5: write a result (directories are created; existing output replaced)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        writer.format(fmt).save(path)
    return path


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """IO4: the table at ``path``, or an empty table of ``schema`` if it does not exist."""
    try:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True)
        if fmt != "parquet":
            reader = reader.schema(schema)
        return reader.load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err) and "does not exist" not in str(err):
            raise
        return spark.createDataFrame([], schema)


_GEOJSON_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("properties", T.StructType([T.StructField("sname", T.StringType())])),
])


def read_geojson_points(spark: SparkSession, path: str, collection: bool = True,
                        name_field: str = "sname") -> DataFrame:
    """IO3: point features -> ``(id, name, lat, lon)``.

    ``collection=True`` reads a FeatureCollection document (one per file);
    ``collection=False`` reads newline-delimited features, which splits
    across tasks and is the layout to use for large station sets.  GeoJSON
    coordinates are ``[lon, lat]``; a missing name becomes ``''``.
    """
    feature = _GEOJSON_FEATURE
    if name_field != "sname":
        feature = T.StructType([f if f.name != "properties" else T.StructField(
            "properties", T.StructType([T.StructField(name_field, T.StringType())])) for f in feature.fields])
    if collection:
        doc = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])) \
            .option("multiLine", True).json(path)
        feats = doc.select(F.explode("features").alias("f")).select("f.*")
    else:
        feats = spark.read.schema(feature).json(path)
    return feats.select(
        F.col("id"),
        F.coalesce(F.col(f"properties.{name_field}"), F.lit("")).alias("name"),
        F.col("geometry.coordinates")[1].alias("lat"),
        F.col("geometry.coordinates")[0].alias("lon"),
    )


def write_geojson_points(df: DataFrame, path: str, id_col: str, name_col: str, lat_col: str, lon_col: str,
                         name_field: str = "sname") -> str:
    """Write points as newline-delimited GeoJSON features (one feature per line)."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col(id_col).cast("string").alias("id"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon_col).cast("double"), F.col(lat_col).cast("double")).alias("coordinates"))
        .alias("geometry"),
        F.struct(F.col(name_col).cast("string").alias(name_field)).alias("properties"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
    return path
