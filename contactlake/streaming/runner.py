"""Run a stream over what is available now and read its sink as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.firsts import last_per_key
from contactlake.operators.stored import Folder
from contactlake.session import shared_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table of a folder, one file or a folder of part files, as a file stream with its stored schema."""
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if Folder(spark, folder).is_folder(f"{table}.parquet"):
        return stream.parquet(path)
    # A stream reads folders only: a single file is picked out of its own.
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Append-mode stream into parquet; returns the sink."""
    spark = stream.sparkSession
    out = folder or _folder(spark)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_update(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Update-mode stream as snapshots per batch; returns the newest row per key."""
    spark = stream.sparkSession
    out = folder or _folder(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch: a replayed batch overwrites itself.
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/data").drop("batch")
    return last_per_key(rows, keys, ["batch_id"]).drop("batch_id")
