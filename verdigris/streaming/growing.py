"""Result rows as a stream: counts kept up to date, and appends that survive a restart without repeating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import terminal_counts, true_negative, true_positive


def result_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Result rows from a folder of JSON lines that other jobs add files to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_counts(cases: DataFrame, by: str) -> DataFrame:
    """Penalized counts by group over all rows so far; state is one row a group."""
    return cases.groupBy(by).agg(F.count("*").alias("total_cases"), F.count_if(F.col("truth") == "positive").alias("positive_cases"), F.count_if(F.col("truth") == "negative").alias("negative_cases"), F.count_if(true_positive()).alias("tp"), F.count_if(true_negative()).alias("tn"), *terminal_counts())


def once_per_key(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of every key; keys are remembered for as long as rows may be late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; started again it goes on where it stopped, and every row is written once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
