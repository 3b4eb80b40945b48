"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from . import (byte_bpe, content_sort, conversation_repair, decontaminate, language_id, secret_scan, simhash,
               spelling_variants, suffix_dedup, token_count, token_files, toxicity, url_filter)

#: The rules of the URL filter (host and path, verdict).
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


def op1_token_counts(spark, d):
    return token_count.count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_bpe(spark, d):
    return byte_bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def op3_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


def op4_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"), URL_RULES)


def op5_language_id(spark, d):
    return language_id.identify(table(spark, d, "documents"))


def op6_token_files(spark, d):
    path = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, d, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path, with_ids=False)


def op7_decontaminate(spark, d):
    return decontaminate.find_overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"), tolerant_words=5)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark, d):
    found = secret_scan.scan(table(spark, d, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"), "n_guess",
                        F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s["cost"])), ",").alias("guess_costs"),
                        F.array_join(F.transform("spans", lambda s: s["segments"]), ",").alias("segments"))


def op9_exact_dedup(spark, d):
    found = content_sort.exact_dedup(table(spark, d, "documents"), carry=["doc_id"])
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op10_toxicity(spark, d):
    docs = table(spark, d, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, d, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"),
                         F.col("tox_label").alias("predicted"), F.col("tox_evidence").alias("evidence"))


def op11_conversation_repair(spark, d):
    return conversation_repair.repair(conversation_repair.damaged(table(spark, d, "conversations")), present_col="present")


def op12_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents"))


def op13_spelling_variants(spark, d):
    return spelling_variants.group_variants(table(spark, d, "documents"), drop_every=199)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_byte_bpe, op3_simhash, op4_url_filter, op5_language_id, op6_token_files, op7_decontaminate,
    op8_secret_scan, op9_exact_dedup, op10_toxicity, op11_conversation_repair,
    op12_suffix_dedup, op13_spelling_variants)}

ORACLE = {
    "op9_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm)""",
}
