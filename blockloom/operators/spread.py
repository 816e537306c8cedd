"""Documents dealt out to all cores where their files are too few to do so."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(docs: DataFrame) -> DataFrame:
    """An input of less than a scan partition for each core is dealt out evenly; a larger one stays where it is read, without a shuffle."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(4 * cores) if size < cores * (128 << 20) else docs
