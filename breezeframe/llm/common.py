"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word: a run of characters other than the space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set and all run on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.breezeframe.ownFolder", None)
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="breezeframe-")
            spark.conf.set("spark.breezeframe.ownFolder", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None, **options: object) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them back.

    The write's shuffle files go as soon as it is done; nothing reads them again.
    by: a column whose values get a folder each, so that `discard` can delete them one at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a stored table that nothing reads any more; part (`column=value`): those of one folder."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f"/{part}" in f}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_or_shuffled(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast a side whose row count was checked; a larger one is left to an ordinary shuffled join."""
    checked = df.limit(max_rows + 1).count()
    return F.broadcast(df) if checked <= max_rows else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def local_threads() -> None:
    """Keep native libraries in a task on that task's own core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
