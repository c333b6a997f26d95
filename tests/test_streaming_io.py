from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions import to_number
from limnos.sources.files import read_optional, read_table_csv, write_table
from limnos.streaming import ingest_new_files


def test_csv_tokens_and_optional(spark, tmp_path):
    df = spark.createDataFrame([("1", "NA", "2024-01-02 03:04:05"), ("x", "5.5", "bad"), ("3", "", None)],
                               "a string, b string, t string")
    path = write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = read_table_csv(spark, path, types={"a": "bigint", "b": "double"}, timestamps=["t"]).orderBy("b").collect()
    assert [(r.a, r.b) for r in back] == [(1, None), (3, None), (None, 5.5)]
    assert back[0].t is not None and back[2].t is None
    empty = read_optional(spark, str(tmp_path / "missing"), "a long, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_incremental_ingest_processes_each_file_once(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    clean = lambda d: d.select("id", to_number("v").alias("v"))
    (src / "a.csv").write_text("id,v\n1,10\n2,x\n")
    ingest_new_files(spark, str(src), schema, str(sink), clean, name=f"t{tmp_path.name}")
    (src / "b.csv").write_text("id,v\n3,30\n")
    ingest_new_files(spark, str(src), schema, str(sink), clean, name=f"t{tmp_path.name}")
    out = spark.read.parquet(str(sink))
    assert sorted((r.id, r.v) for r in out.collect()) == [("1", 10.0), ("2", None), ("3", 30.0)]
    assert out.filter(F.col("id") == "1").count() == 1
