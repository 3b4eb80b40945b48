"""Operator 2: byte-level BPE encoding and decoding with a local rank file.

The tiktoken library encodes whole texts by the ranks of a file and a
pre-splitting pattern; long texts go in parts cut at safe boundaries, so one
call never holds more than a part. Decoding joins the raw bytes of the ids,
which need not be valid UTF-8 piecewise. Map-only, in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import byte_slices, id_and_text, parts, per_worker, schema_with


class RankFile:
    """Encoder and decoder for a rank file (base64 token, rank per line)."""

    def __init__(self, rank_file: str, pattern: str, max_chars: int = 1 << 16):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.max_chars = max_chars

    def ids(self, text: str) -> list[int]:
        found: list[int] = []
        for part in parts(text, self.max_chars):
            found += self.encoding.encode_ordinary(part)
        return found

    def raw(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, ids (array of int), n_tokens for each row; null texts: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("ranks", rank_file, pattern), lambda: RankFile(rank_file, pattern))
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                ids = [bpe.ids(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(list(map(len, ids)), pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, schema_with(docs, id_col, "ids array<int>, n_tokens long"))


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id and the raw bytes of each row's ids; null ids: no bytes. An id
    that the file lacks fails the job (the input is broken)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("ranks", rank_file, pattern), lambda: RankFile(rank_file, pattern))
        for batch in batches:
            raw = [bpe.raw(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())],
                                             names=["doc_id", "raw"])

    own = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return own.mapInArrow(run, schema_with(encoded, id_col, "raw binary"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               batch_bytes: int = 1 << 20) -> DataFrame:
    """Encode each text and decode its ids again, in one pass: doc_id, n_tokens,
    ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    decoded bytes), lossless (decoded bytes are the text's). Only digests leave
    the task. Null texts are empty: 0 tokens, digests of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("ranks", rank_file, pattern), lambda: RankFile(rank_file, pattern))
        decimal = list(map(str, range(max(bpe.ranks.values(), default=0) + 1)))
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                n, ids_sha, raw_sha, same = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.ids(text)
                    raw = bpe.raw(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == text.encode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(ids_sha, pa.string()),
                     pa.array(raw_sha, pa.string()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, schema_with(docs, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"))
