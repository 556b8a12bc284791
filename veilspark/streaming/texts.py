"""Streams of texts through the batch operators: they are plans over columns, so they run on streams as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.gates import should_scan


def read_files(spark: SparkSession, path: str, schema: str | StructType, per_trigger: int = 100) -> DataFrame:
    """Parquet files as a stream, in the order of their arrival: those of a folder, or a single one."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    # A stream reads folders only, so a single file is its folder's one file of that name.
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", own.getName()).parquet(str(own.getParent().toString()))


def write_batches(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], text_col: str = "text") -> StreamingQuery:
    """Each micro-batch, gated and transformed, appended to a Parquet folder; a batch that is run again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        transform(batch.filter(should_scan(batch[text_col]))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
