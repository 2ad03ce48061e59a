"""Session settings the library reads, and nothing else."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHUNK_ROWS = "spark.tidemark.chunkRows"


def prepare(spark: SparkSession) -> SparkSession:
    """Times are UTC everywhere; AQE coalesces small shuffles and splits skewed joins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def chunk_rows(spark: SparkSession) -> int:
    """Rows of one key that one task may hold while it runs a window."""
    return int(spark.conf.get(CHUNK_ROWS, "16384"))


def durable(df):
    """Cut a long lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` must point at shared storage; without it the plan is kept as it is.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=False)
