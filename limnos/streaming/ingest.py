"""File-arrival ingest: new CSV files -> batch cleaning -> Parquet, one folder a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limnos.session import ensure_checkpoint_dir


def ingest_new_files(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                     clean: Callable[[DataFrame], DataFrame], name: str, max_files_per_trigger: int = 1000,
                     partition_by: tuple[str, ...] = ()) -> None:
    """Process every CSV file not yet seen under ``source_dir`` and stop.

    ``clean`` is any batch transform from this library (e.g. the water
    quality cleaning of ``limnos.plans.flows``); it runs per micro-batch via
    ``foreachBatch``.  The streaming checkpoint lives under
    ``spark.checkpoint.dir`` so the set of processed files survives driver
    and executor loss.  Each batch has a folder of its own under ``sink_dir``
    (partition column ``batch``), which a repeated batch overwrites.
    """
    checkpoint = ensure_checkpoint_dir(spark).rstrip("/") + f"/limnos-streams/{name}"
    stream = (spark.readStream.schema(schema).option("header", True)
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # A batch that died before its commit runs again and replaces its own folder.
        writer = clean(batch).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{sink_dir}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
