"""Operator 13: spelling variant grouping by reduced-alphabet generation.

Counting. Each task counts the words of its texts in bounded tables; sums of
those partial counts give the vocabulary, so a very common word is a few rows.

Near words. A hash maps letters to a few symbols. Of every reduced word its
one-edit neighbourhood is generated (itself, every deletion, every replacement
by a symbol; an insertion is a deletion seen from the longer word), as 64-bit
polynomial hashes that follow from the word's own in one step each. Joined with
the hashes of the reduced vocabulary they give candidate pairs, which are
verified on the original strings; a collision of symbols or hashes costs a
comparison, never a result. More symbols mean more neighbours and fewer false
candidates; their number follows the sixth root of the vocabulary, so false
candidates per word stay level as it grows.

Strings over ``long_word`` letters do not travel with their neighbours, only
their hash does; they are looked up for the pairs that met.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import byte_slices, id_and_text
from .stored import stored

#: Fixed value: letters of a word; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
UNDO = pow(BASE, -1, 1 << 64)


def letter_symbols(symbols: int) -> np.ndarray:
    """Symbol of each Latin-1 letter."""
    return np.array([zlib.crc32(bytes([c, 17])) % symbols for c in range(256)], np.int64)


def symbol_values(symbols: int) -> np.ndarray:
    return np.random.default_rng(13).integers(1, 1 << 63, symbols, dtype=np.uint64)


def neighbourhood(words: list[str], symbols: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For words of one length: the hash of each reduced word, and the distinct
    hashes of its one-edit neighbourhood, its own included."""
    value, n = symbol_values(symbols), len(words[0])
    reduced = letter_symbols(symbols)[np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), n)]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE, np.uint64)]))
    terms = value[reduced] * power
    own = terms.sum(axis=1)
    before = np.cumsum(terms, axis=1) - terms
    deleted = before + (own[:, None] - before - terms) * np.uint64(UNDO)
    replaced = (own[:, None, None] - terms[:, :, None] + (value * power[:, None])[None, :, :]).reshape(len(words), -1)
    every = np.sort(np.concatenate([own[:, None], deleted, replaced], axis=1), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), every[:, 1:] != every[:, :-1]], axis=1)
    return own, [e[k] for e, k in zip(every, new)]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6,
                drop_every: int | None = None, max_words: int = 200_000, batch_bytes: int = 1 << 22) -> DataFrame:
    """(word, n) of every maximal run of letters with at least ``min_letters``.
    With ``drop_every``, runs whose crc32 of ``id:run`` it divides lose the
    letter at that crc modulo their length (a null id counts as empty)."""
    run = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                for name, text in zip(part.column("name").to_pylist(), part.column("text").to_pylist()):
                    own = Counter(run.findall(text.translate(LOWER)))
                    if drop_every:
                        start = zlib.crc32(f"{name}:".encode())
                        for word in [w for w in own if not zlib.crc32(w.encode(), start) % drop_every]:
                            at = zlib.crc32(word.encode(), start) % len(word)
                            n, shorter = own.pop(word), word[:at] + word[at + 1:]
                            if len(shorter) >= min_letters:
                                total[shorter] += n
                    total.update(own)
                    if len(total) > max_words:
                        yield out()
                        total.clear()
        if total:
            yield out()

    named = id_and_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame, symbols: int, long_word: int = 64, step: int = 1 << 20) -> DataFrame:
    """(word, n, near, near_n), once for each two rows of ``words`` (word, n;
    distinct words of Latin-1 letters) that differ by one edit."""

    def keys(only_own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by_length: dict[int, list] = {}
                for row in zip(batch.column("word").to_pylist(), batch.column("ref").to_pylist(), batch.column("n").to_pylist()):
                    by_length.setdefault(len(row[0]), []).append(row)
                for length, rows in by_length.items():
                    size = max(1, step // ((symbols + 1) * length))
                    for at in range(0, len(rows), size):
                        some = rows[at:at + size]
                        own, around = neighbourhood([w for w, _, _ in some], symbols)
                        around = [own[k:k + 1] for k in range(len(own))] if only_own else around
                        times = [len(a) for a in around]
                        which = pa.array(np.repeat(np.arange(len(some)), times))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(around).view(np.int64)),
                             *(pa.array(c, t).take(which) for c, t in (
                                 ([w if len(w) <= long_word else None for w, _, _ in some], pa.string()),
                                 ([r for _, r, _ in some], pa.int64()), ([n for _, _, n in some], pa.int64()))),
                             pa.array(np.full(sum(times), length, np.int32))], names=["key", "word", "ref", "n", "length"])
        return run

    schema = "key long, word string, ref long, n long, length int"
    own = words.select("word", F.xxhash64("word").alias("ref"), "n")
    probe = own.mapInArrow(keys(False), schema).alias("a")
    index = own.mapInArrow(keys(True), schema).alias("b")
    met = probe.join(index, "key").where("a.length - b.length in (0, 1) and a.ref <> b.ref").select(
        *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("word", "ref", "n", "length")))
    one_edit = (F.levenshtein("a_word", "b_word", 1) == 1) & ((F.col("a_length") > F.col("b_length")) | (F.col("a_word") < F.col("b_word")))
    result = [F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")]
    short = met.where("a_length <= {0} and b_length <= {0}".format(long_word)).where(one_edit).select(*result)
    whole = own.where(F.length("word") >= long_word).select("word", "ref")
    long = (met.where(f"a_length > {long_word}").drop("a_word", "b_word")
            .join(whole.select(F.col("word").alias("a_word"), F.col("ref").alias("a_ref")), "a_ref")
            .join(whole.select(F.col("word").alias("b_word"), F.col("ref").alias("b_ref")), "b_ref")
            .where((F.length("a_word") == F.col("a_length")) & (F.length("b_word") == F.col("b_length")))
            .where(one_edit).select(*result))
    return short.union(long)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6,
                   min_count: int = 5, ratio: int = 5, drop_every: int | None = None,
                   symbols: int | None = None) -> DataFrame:
    """One row per word of at least ``min_letters`` letters and ``min_count``
    occurrences: word, form (its near word of largest n, ties by code point, if
    that n is at least ``ratio`` times the word's; else null), root (the last of
    the forms of forms; the word itself without a form), n, n_near (words that
    differ by one inserted, deleted or replaced letter) and form_n.

    Null and empty texts hold no word; rows that repeat count again; rows and
    columns beside id and text are ignored; no word gives no row."""
    words = stored(count_words(docs, id_col, text_col, min_letters, drop_every).where(F.col("n") >= min_count))
    n_words, most = words.agg(F.count("*"), F.max("n")).first()
    symbols = symbols or max(4, int(np.ceil(n_words ** (1 / 6))))
    pairs = near_pairs(words, symbols)
    sides = pairs.select(F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )).alias("p")).select("p.*")
    found = (sides.union(words.select("word", "n", F.lit(None).cast("string"), F.lit(None).cast("long")))
             .groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"),
                                  F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("low"), "near"))).alias("best")))
    common = -F.col("best.low") >= ratio * F.col("n")
    found = stored(found.select("word", F.when(common, F.col("best.near")).alias("form"), "n", "n_near",
                                F.when(common, -F.col("best.low")).alias("form_n")))
    # a form occurs ``ratio`` times as often, so chains are short; each round doubles the steps made
    to = found.where("form is not null").select("word", F.col("form").alias("root"))
    steps, n = 1, max(ratio, 2) * min_count
    while n * max(ratio, 2) <= (most or 0):
        n, steps = n * max(ratio, 2), steps + 1
    for _ in range((steps - 1).bit_length()):
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = stored(to.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
