"""Tables written to the shared checkpoint folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that all executors share: cuts
    lineage, survives lost executors, and later passes read single columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
