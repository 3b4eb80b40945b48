"""Stored tables that are replaced or updated safely.

A table is a folder of versions, each a Parquet folder. A version counts once
its writer has committed it (Spark's ``_SUCCESS`` marker, written last), so the
marker is the pointer: readers take the newest committed version, and a job
that fails half-way, or an executor that is lost, leaves the old rows in place.
All file access goes through the session's file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _listed(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
    done = [n for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return jvm, fs, names, done


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest committed version; null if there is none."""
    done = _listed(spark, root)[3]
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def publish(df: DataFrame, root: str, keep: int = 2) -> DataFrame:
    """Write ``df`` as the next version and return it as read back. ``df`` may
    read the version it replaces. The ``keep`` newest committed versions stay
    for readers that began before."""
    spark = df.sparkSession
    names = _listed(spark, root)[2]
    number = max([int(n[2:12]) for n in names if n.startswith("v-")], default=0) + 1
    path = f"{root}/v-{number:010d}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    jvm, fs, _, done = _listed(spark, root)
    for old in done[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return spark.read.parquet(path)


def with_defaults(df: DataFrame, defaults: dict, created: str | None = "created_at") -> DataFrame:
    """Absent or null columns take their default; ``created`` is the load time."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    if created:
        now = F.current_timestamp()
        df = df.withColumn(created, F.coalesce(F.col(created), now) if created in df.columns else now)
    return df


def keyed_update(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """B16 ``UPDATE .. SET columns WHERE key``: the whole table with the given
    columns of the rows that ``updates`` names (one row a key; the rest of the
    table and its other columns stay; keys that the table lacks do nothing).
    An update may set null."""
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_set"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    of = {c: F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c) if c in table.columns else F.lit(None)) for c in columns}
    return joined.select(*[of.get(c, F.col(c)).alias(c) for c in table.columns],
                         *[of[c].alias(c) for c in columns if c not in table.columns])
