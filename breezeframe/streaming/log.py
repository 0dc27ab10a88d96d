"""Append-only logs as a sink of streams: a batch counts once, however often it is delivered.

A log is a folder of batches, one folder each, `batch=<number>`. The writer of a batch first
looks for the mark that a finished write leaves; a batch that has it is not written again,
so a stream that repeats its last batch after a restart leaves the log as it is. A write that
broke off has no mark and is overwritten. Rows are lines of JSON with sorted names, or Parquet.

Nulls and ties: null fields are kept in Parquet and read back as null from JSON; an empty batch is a folder without
rows; a log that was never written to reads as an empty frame. Repeated rows stay repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

MARK = "_SUCCESS"


@dataclass(frozen=True)
class AppendLog:
    folder: str
    schema: StructType | str
    kind: str = "json"

    def _path(self, spark: SparkSession, name: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def has(self, spark: SparkSession, batch: int) -> bool:
        files, path = self._path(spark, f"batch={batch}/{MARK}")
        return files.exists(path)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch, unless it is there already; whether it was written."""
        if self.has(rows.sparkSession, batch):
            return False
        rows = rows.select(*sorted(rows.columns)) if self.kind == "json" else rows
        rows.write.format(self.kind).mode("overwrite").save(f"{self.folder}/batch={batch}")
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows and the batch that each came with."""
        schema = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        files, path = self._path(spark, "")
        if not files.exists(path):
            return spark.createDataFrame([], StructType(list(schema.fields)).add("batch", IntegerType()))
        return spark.read.format(self.kind).schema(StructType(list(schema.fields)).add("batch", IntegerType())).load(self.folder)


def write_into(stream: DataFrame, logs: dict[AppendLog, object], checkpoint: str) -> StreamingQuery:
    """Start a stream into one or more logs, each with the rows that its condition (a column, or None for all) lets through."""

    def put(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for log, condition in logs.items():
                log.append(rows if condition is None else rows.where(condition), batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
