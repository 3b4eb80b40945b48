"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import schemas


def read_address_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A1: address CSV with the declared 36 columns; a malformed row aborts.

    Files are split among tasks; ``multi_line`` is for feeds with line breaks
    inside quoted fields, which Spark reads with one task a file."""
    return (spark.read.schema(schemas.ADDRESS_FEED).option("header", True).option("mode", "FAILFAST")
            .option("escape", '"').option("multiLine", multi_line).option("encoding", "UTF-8").csv(path))


GEOMETRY_CANDIDATES = ("Shape", "shape", "WKT", "wkt", "geometry")


def read_boundaries(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """A2: boundary CSV with a WKT column under one of several names.

    Adds ``geom`` (parsed once at load) and ``geom_type`` (for assertions).
    Files are split among tasks; ``multi_line`` as in ``read_address_feed``.
    A malformed row aborts.
    """
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
         .option("mode", "FAILFAST").option("maxCharsPerColumn", -1))
    df = (r.schema(schema) if schema is not None else r).csv(path)
    cands = [c for c in GEOMETRY_CANDIDATES if c in df.columns]
    if not cands:
        raise ValueError("no geometry column among %s" % (GEOMETRY_CANDIDATES,))
    wkt = F.coalesce(*[F.col(c) for c in cands])
    return df.withColumn("geom", geo.geom_from_wkt(wkt)).withColumn("geom_type", geo.geometry_kind(wkt))


def read_locality_json(spark: SparkSession, path: str) -> DataFrame:
    """A4: nested region -> districts -> suburbs documents, one JSON array per
    file; returns one row per file with ``doc: array<region>``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", schemas.LOCALITY_JSON).alias("doc"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listing CSV (region, district, suburb) with a header; a malformed row aborts."""
    return (spark.read.schema(schemas.LISTINGS).option("header", True).option("escape", '"').option("mode", "FAILFAST")
            .csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: CSV sink with header row and quoting."""
    df.write.mode(mode).option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Parquet sink (append = insert-select, overwrite = truncate+load)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def literal_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """Small literal table supplied by the caller (seed lists)."""
    return spark.createDataFrame(rows, schema)
