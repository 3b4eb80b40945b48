"""Constraint validation (C17) and geometry type assertion (I20): what a
database would refuse, as rows with their keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


@dataclass
class Constraints:
    """Of one table: columns that must not be null, the key, and foreign keys
    (column, parent table name, parent column)."""

    key: list[str]
    not_null: list[str] = field(default_factory=list)
    foreign: list[tuple[str, str, str]] = field(default_factory=list)


def _key(cols: list[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in cols])


def violations(tables: dict[str, DataFrame], declared: dict[str, Constraints]) -> DataFrame:
    """(table_name, rule, key, rows): every key that breaks a rule and its
    number of rows. Rules are ``not_null:col``, ``unique:cols`` and
    ``foreign:col``; null foreign keys break none, as in SQL. Nulls are found
    in one pass per table; duplicates by an aggregate of the key alone; orphans
    by an anti join of the distinct values."""
    found = []
    for name, c in declared.items():
        df, key = tables[name], _key(c.key).alias("key")
        if c.not_null:
            rule = F.explode(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(f"not_null:{n}")) for n in c.not_null])))
            found.append(df.select(key, rule.alias("rule")).groupBy("rule", "key").agg(F.count("*").alias("rows"))
                         .select(F.lit(name).alias("table_name"), "rule", "key", "rows"))
        found.append(df.where(" and ".join(f"{k} is not null" for k in c.key)).groupBy(*c.key).agg(F.count("*").alias("rows"))
                     .where("rows > 1").select(F.lit(name).alias("table_name"), F.lit("unique:" + ",".join(c.key)).alias("rule"),
                                               key, "rows"))
        for col, parent, parent_col in c.foreign:
            values = df.where(F.col(col).isNotNull()).groupBy(*c.key, F.col(col).alias("_v")).agg(F.count("*").alias("rows"))
            known = tables[parent].select(F.col(parent_col).alias("_v")).distinct()
            found.append(values.join(known, "_v", "left_anti").groupBy(key).agg(F.sum("rows").alias("rows")).select(
                F.lit(name).alias("table_name"), F.lit(f"foreign:{col}").alias("rule"), "key", "rows"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_geometry_verdict(stage: DataFrame, wkt: str, allowed: tuple[str, ...]) -> DataFrame:
    """``stage`` with geom_type (upper case, null if there is none), accepted
    and reason (``no geometry``, ``not a geometry``, ``type X`` or null)."""
    text = F.trim(F.col(wkt))
    kind = F.when(F.length(text) > 0, F.nullif(geo.geometry_kind(wkt), F.lit("")))
    body = F.upper(text).rlike(r"^[A-Z]+\s*(Z|M|ZM)?\s*\(.*\)$")
    reason = (F.when(F.col(wkt).isNull() | (F.length(text) == 0), F.lit("no geometry"))
              .when(kind.isNull() | ~body, F.lit("not a geometry"))
              .when(~kind.isin(*allowed), F.concat(F.lit("type "), kind)))
    return stage.withColumn("geom_type", kind).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def split_by_geometry(stage: DataFrame, wkt: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rows set aside with their reason)."""
    judged = with_geometry_verdict(stage, wkt, allowed)
    return judged.where("accepted").drop("accepted", "reason"), judged.where("not accepted").drop("accepted")
