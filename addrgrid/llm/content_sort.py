"""Operator 9: exact dedup by content sort, with DataFrame operations only.

Texts are normalised (every run of blanks becomes one space) and sorted by
content: sampled splitters over (first characters, 64-bit hash) deal rows into
ranges of the normalised bytes, each range is sorted externally, and equal
texts stand next to each other, where the window compares whole neighbouring
texts. The splitters hold a short prefix and a hash, never whole texts, so
sampling stays small for any text length.

Texts with very many copies are found beforehand by a count of hashes (fewer
than ``1 / hot_share`` of them can exist). Their copies are sorted in ``salts``
independent runs; one row of each run goes into a second content sort. No task
holds a whole group of copies, and all other texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Each run of space, tab or line end as one space; null as empty. Runs
    that are one space already are not matched, which saves most of the work."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")),
                            r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sorted_runs(rows: DataFrame, norm: Column, keys: list[str], id_col: str) -> DataFrame:
    """Content sort within sampled ranges of ``keys``, then what neighbours
    with identical text say: smallest id, number of rows, place in the run."""
    rows = rows.repartitionByRange(*keys).withColumn("_norm", norm)
    run = Window.partitionBy(*keys, "_norm").orderBy(F.col(id_col).asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("*", F.first(id_col).over(whole).alias("_low"), F.count("*").over(whole).alias("_n"),
                       F.row_number().over(run).alias("_place"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                salts: int = 64, hot_share: float = 0.001, hot_rows: int = 256) -> DataFrame:
    """All rows of ``docs`` with the columns ``carry`` (default: all) and, for
    each row: keep_id (smallest id among the rows whose normalised text is
    identical), group_size, kept (this row stays) and text_sha256 (lowercase
    hex of the normalised text in UTF-8).

    Null texts count as empty and equal blank-free empties. Exactly one row of
    each group stays, also if the smallest id occurs twice. Null ids come last;
    a group with null ids only has keep_id null. Input columns that are named
    like a result column are replaced; the working names _head, _hash, _salt,
    _sha, _norm, _low, _n and _place must not be used by the caller.

    Rows and sort keys are written once to the shared folder, since sampling,
    counting and sorting all read them; the text is written normalised if the
    caller does not carry it."""
    own = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    norm = normalised(F.col(text_col))
    keep_text = text_col in own
    columns = [*dict.fromkeys([*own, id_col])]
    keyed = stored(docs.select(*columns, *([] if keep_text else [norm.alias("_text")]),
                               F.substring(norm, 1, 32).alias("_head"), F.xxhash64(norm).alias("_hash")))
    norm = norm if keep_text else F.col("_text")
    # the share bounds the number of hot texts, so they fit the driver and a literal list
    floor = max(hot_rows, hot_share * keyed.count())
    hot = [r._hash for r in keyed.groupBy("_hash").count().where(F.col("count") > floor).select("_hash").collect()]
    cold = keyed.where(~F.col("_hash").isin(hot)) if hot else keyed
    cold = _sorted_runs(cold, norm, ["_head", "_hash"], id_col).select(
        *own, F.col("_low").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_place") == 1).alias("kept"),
        F.sha2("_norm", 256).alias("text_sha256"))
    if not hot:
        return cold
    salted = keyed.where(F.col("_hash").isin(hot)).withColumn(
        "_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    runs = _sorted_runs(salted, norm, ["_head", "_hash", "_salt"], id_col).withColumn("_sha", F.sha2("_norm", 256))
    first = runs.where("_place = 1").select("_head", "_hash", "_salt", "_sha", F.col("_norm").alias("_whole"),
                                            F.col("_low").alias("_run_low"), F.col("_n").alias("_run_n"))
    first = first.repartitionByRange("_head", "_hash")
    group = Window.partitionBy("_head", "_hash", "_whole").orderBy(F.col("_run_low").asc_nulls_last(), "_salt")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = first.select("_hash", "_salt", "_sha", F.first("_run_low").over(whole).alias("keep_id"),
                          F.sum("_run_n").over(whole).alias("group_size"),
                          F.row_number().over(group).alias("_run_place"))
    # at most salts / hot_share rows of a few dozen bytes
    whole_runs = runs.join(F.broadcast(merged), ["_hash", "_salt", "_sha"]).select(
        *own, "keep_id", "group_size", ((F.col("_place") == 1) & (F.col("_run_place") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"))
    return cold.union(whole_runs)
