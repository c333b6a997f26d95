"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import scratch_path


def ship_with_tasks(module: str) -> None:
    """Send the functions of ``module`` inside the tasks, so executors need numpy and pyarrow but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_with_tasks(__name__)

# The separators of the two word definitions in use.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
NON_WORD_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: str | Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change accented letters)."""
    c = _col(c)
    return F.when(c.rlike("[A-Z]"), F.translate(c, UPPER, UPPER.lower())).otherwise(c)


def split_words(text: str | Column, sep_class: str = SPACE_CLASS, sep_chars: str = SPACE_CHARS) -> Column:
    """Maximal runs of characters outside ``sep_class``, in order; NULL text gives an empty array.

    Trimming first means ``split`` leaves no empty strings at the ends.
    """
    trimmed = F.btrim(_col(text), F.lit(sep_chars))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, sep_class + "+"))


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those of least hash of ``keys``.

    Rows beyond four times the hash range that should hold ``n`` go first, so what
    the tasks hand on for the final cut does not grow with their number.  Where rows
    share keys, that range may hold fewer than ``n``: then all rows are ordered.
    """
    h, total = F.xxhash64(*keys), df.count()
    if total > 8 * n:
        near = df.where(h < F.lit(int(-(2.0 ** 63) + 2.0 ** 64 * 4 * n / total)))
        if near.limit(n).count() == n:
            df = near
    return df.orderBy(h).limit(n)


ROW_KEY = ["k1", "k2"]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two hashes, k1 and k2, that name a row by its id and text, both of which may be NULL or repeated."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, id_col, F.lit(1)).alias("k2")]


def keyed_join(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join ``docs`` with a table of row keys (k1, k2), which arrive as _k1, _k2 beside columns of any name."""
    keys = keys.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    k1, k2 = row_key(id_col, text_col)
    return docs.join(keys, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), how)


class WordHashes(dict):
    """Memo of the 64-bit hashes of words or lines (bytes), emptied when it grows past ``limit`` entries."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def uniform(*cols: Column | str) -> Column:
    """Deterministic number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*[_col(c) for c in cols]), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared scratch folder and read it back (cuts the lineage)."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
