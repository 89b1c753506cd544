"""The size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one batch of whole texts; a longer text is a batch by itself.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the batches that Python functions get by bytes, since their rows hold whole texts.

    The setting stays for the session: plans run later than they are made, and read it then.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan dealt evenly if its files give fewer partitions than there are cores: for heavy work on each row of few files. Large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows
