"""Operator 6: token-id files coded by a static range asymmetric numeral system.

Layout. Documents are dealt by ranges of their id and sorted, so the files of a
folder hold them in ascending order. A row of a file is a segment: whole
documents of about ``segment_tokens`` ids, their ids and lengths, one frequency
table that all blocks of the segment share, and the blocks. A block codes up to
BLOCK ids on LANES interleaved coders; it holds the words they gave off, their
final states, and a CRC-32 of its ids. Blocks do not depend on each other, and
each is a checkpoint: token and word offsets are in the block list, so any one
can be decoded alone. A segment also holds the number of ids before it in its
part, so the global start of every document needs only one sum per part.

Coder. 64-bit states in [2^31, 2^63), 32-bit words, frequencies scaled to 2^20;
all lanes of a step are one vector operation.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow_text import byte_slices, per_worker
from .token_count import PieceTable

BLOCK, LANES, SCALE = 1 << 18, 1024, 20
LOW = np.uint64(1 << 31)

SEGMENT = """part int, seq int, part_offset long, n_tokens long, doc_ids array<{id}>, doc_tokens array<long>,
symbols binary, freqs binary,
blocks array<struct<token_at: long, n: long, word_at: long, n_words: long, states: binary, crc: long>>, words binary"""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts (all positive) scaled to sum to 2**SCALE, each at least 1."""
    total = 1 << SCALE
    freqs = np.maximum(1, counts * total // counts.sum())
    spare = total - int(freqs.sum())
    if spare >= 0:
        freqs[np.argmax(freqs)] += spare
        return freqs
    for at in np.argsort(-freqs, kind="stable"):  # take what is too much from the most frequent
        take = min(-spare, int(freqs[at]) - 1)
        freqs[at] -= take
        spare += take
        if spare == 0:
            return freqs
    raise ValueError("more distinct ids than the table has places")


def encode_block(symbols: np.ndarray, freqs: np.ndarray, starts: np.ndarray, lanes: int = LANES):
    """(words, states) of the block's symbols, which index ``freqs``."""
    states = np.full(lanes, LOW, np.uint64)
    freq, start = freqs[symbols], starts[symbols]
    most, given = freq << np.uint64(63 - SCALE), []
    scale, half, low_word = np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
    for at in range((len(symbols) - 1) // lanes * lanes, -1, -lanes):
        f = freq[at:at + lanes]
        x = states[:len(f)]
        full = np.flatnonzero(x >= most[at:at + lanes])
        if len(full):
            over = x[full]
            given.append(over & low_word)
            x[full] = over >> half
        quotient = x // f
        x += ((quotient << scale) - quotient * f) + start[at:at + lanes]
    return (np.concatenate(given[::-1]).astype(np.uint32) if given else np.zeros(0, np.uint32)), states


def decode_block(words: np.ndarray, states: np.ndarray, n: int, slots: np.ndarray, freqs: np.ndarray,
                 starts: np.ndarray) -> np.ndarray:
    """The n symbols of a block; fails if words or states are left over."""
    states, lanes, at_word = states.copy(), len(states), 0
    out = np.empty(n, np.int64)
    low_bits = np.uint64((1 << SCALE) - 1)
    for at in range(0, n, lanes):
        x = states[:min(lanes, n - at)]
        slot = x & low_bits
        s = slots[slot.astype(np.int64)]
        x = freqs[s] * (x >> np.uint64(SCALE)) + slot - starts[s]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << np.uint64(32)) | words[at_word:at_word + k]
            at_word += k
        out[at:at + len(x)] = s
        states[:len(x)] = x
    if at_word != len(words) or (states != LOW).any():
        raise ValueError("broken block: words or states left over")
    return out


def encode_segment(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> dict:
    """Table, blocks and words of a segment's ids."""
    counts = np.bincount(ids)  # as long as the largest id: a vocabulary, not the data
    symbols = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int64)
    number[symbols] = np.arange(len(symbols))
    inverse, counts = number[ids], counts[symbols]
    freqs = scaled(counts.astype(np.int64)) if len(ids) else counts.astype(np.int64)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
    blocks, words, at_word = [], [], 0
    for at in range(0, len(ids), block):
        part = inverse[at:at + block]
        w, states = encode_block(part, freqs.astype(np.uint64), starts, lanes)
        blocks.append({"token_at": at, "n": len(part), "word_at": at_word, "n_words": len(w),
                       "states": states.astype("<u8").tobytes(),
                       "crc": zlib.crc32(ids[at:at + block].astype("<u4").tobytes())})
        words.append(w.astype("<u4").tobytes())
        at_word += len(w)
    return {"symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": blocks,
            "words": b"".join(words)}


def decode_segment(segment: dict) -> np.ndarray:
    """The ids of a segment; every block's checksum is compared."""
    symbols = np.frombuffer(segment["symbols"], "<u4")
    freqs = np.frombuffer(segment["freqs"], "<u4").astype(np.int64)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
    slots = np.repeat(np.arange(len(freqs)), freqs)
    words = np.frombuffer(segment["words"], "<u4").astype(np.uint64)
    out = [np.zeros(0, "<u4")]
    for b in segment["blocks"]:
        found = decode_block(words[b["word_at"]:b["word_at"] + b["n_words"]],
                             np.frombuffer(b["states"], "<u8").astype(np.uint64), b["n"], slots,
                             freqs.astype(np.uint64), starts)
        ids = symbols[found].astype("<u4")
        if zlib.crc32(ids.tobytes()) != b["crc"]:
            raise ValueError("broken block: checksum")
        out.append(ids)
    return np.concatenate(out)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text", segment_tokens: int = 1 << 20, batch_bytes: int = 1 << 20) -> None:
    """Write the ids of every row of ``docs`` (null text: none), each row
    followed by ``end_id``, as token files under ``path``, in ascending order
    of the id. Null ids come first; rows of the same id stay separate, in the
    order of a hash of their text. An empty table writes no segment."""
    kind = docs.schema[id_col].dataType
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(("bytes", tokenizer_file), lambda: PieceTable(
            tokenizer_file, lambda ids: array("I", ids).tobytes(), b"".join))
        end = array("I", [end_id]).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names, rows, held = [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, names, rows, held
            ids = np.frombuffer(b"".join(rows), np.uint32)
            row = {"part": part, "seq": seq, "part_offset": before, "n_tokens": len(ids), "doc_ids": names,
                   "doc_tokens": [len(r) // 4 for r in rows], **encode_segment(ids)}
            seq, before, names, rows, held = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for some in byte_slices(batch, "text", batch_bytes):
                found = table.batch(some.column("text").to_pylist())
                for name, ids in zip(some.column("doc_id").to_pylist(), found):
                    if held and held + len(ids) // 4 >= segment_tokens:
                        yield segment()
                    names.append(name)
                    rows.append(ids + end)
                    held += len(ids) // 4 + 1
        if names:
            yield segment()

    schema = StructType.fromDDL(SEGMENT.format(id=kind.simpleString()))
    arrow = to_arrow_schema(schema)
    own.select("doc_id", "text").mapInArrow(encode, schema).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32 (of its ids as
    little-endian 32-bit integers) and, if asked for, ids. Segments are decoded
    in parallel; the starts need one row per written part."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per write task, whatever the data size
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kind = files.schema["doc_ids"].dataType.elementType
    fields = "doc_id " + kind.simpleString() + ", start long, n_tokens long, ids_crc32 long" + (
        ", ids array<long>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = decode_segment(row)
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                each = [ids[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())]
                columns = [batch.column("doc_ids").slice(k, 1).flatten(),
                           pa.array(row["base"] + row["part_offset"] + ends - n), pa.array(n),
                           pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.drop("seq").join(F.broadcast(bases), "part").mapInArrow(decode, fields)
