"""Operator 5: language identification by hyperdimensional profiles.

Every letter has a random +-1 vector. A trigram's vector binds (multiplies) the
vectors of its letters, each permuted (rolled) by its place; a text's vector
bundles (adds) its trigrams' vectors, and a language's prototype bundles the
texts of that language, each with the same weight. A text is given the language
whose prototype has the largest cosine with it.

Prototypes are learned from at most about ``train_rows`` labelled rows of each
language, chosen by a hash of the id (all rows of a rarer one); each task returns one partial sum per language, so what is
gathered has one row per language and task. Scoring is map-only: trigram counts
of TEXTS texts at a time are multiplied with the vectors of GRAMS trigrams at a
time, so memory follows neither the number of texts nor that of trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import byte_slices, id_and_text, per_worker, schema_with

CLASSES = 64  # 0: between words, 1-26: a-z, the rest: other letters by code point
DIMENSIONS = 512
TEXTS, GRAMS = 256, 4096


def _letter_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % (CLASSES - 27)
    return table


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))


def text_vectors(texts: list[str], letters: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bundled vector, has a letter) of each text."""
    if len(texts) > TEXTS:
        some = [text_vectors(texts[at:at + TEXTS], letters, classes) for at in range(0, len(texts), TEXTS)]
        return np.concatenate([v for v, _ in some]), np.concatenate([k for _, k in some])
    codes, owner, any_letter = [], [], np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        c = classes[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        any_letter[k] = c.any()
        if any_letter[k]:
            c = np.concatenate(([0], c, [0])).astype(np.int32)
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # one gap between words
            codes.append((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
            owner.append(np.full(len(c) - 2, k, np.int64))
    vectors = np.zeros((len(texts), letters.shape[1]), np.float32)
    if not codes:
        return vectors, any_letter
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    seen = np.nonzero(np.bincount(codes, minlength=CLASSES ** 3))[0]
    column = np.zeros(CLASSES ** 3, np.int64)
    column[seen] = np.arange(len(seen))
    columns = column[codes]
    second, third = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    for at in range(0, len(seen), GRAMS):  # sums of whole numbers: the same for any cut
        some = seen[at:at + GRAMS]
        here = (columns >= at) & (columns < at + GRAMS) if len(seen) > GRAMS else slice(None)
        counts = np.bincount(owner[here] * len(some) + columns[here] - at, minlength=len(texts) * len(some))
        grams = letters[some // CLASSES ** 2] * second[some // CLASSES % CLASSES] * third[some % CLASSES]
        vectors += counts.reshape(len(texts), len(some)).astype(np.float32) @ grams.astype(np.float32)
    return vectors, any_letter


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def learn_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, batch_bytes: int = 1 << 18) -> dict:
    """{language: prototype} from rows with lang and text."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, classes = letter_vectors(dimensions), per_worker(("letter classes",), _letter_classes)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                vectors, _ = text_vectors(part.column("text").to_pylist(), letters, classes)
                for lang, v in zip(part.column("lang").to_pylist(), _unit(vectors).astype(np.float64)):
                    sums[lang] = sums[lang] + v if lang in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "v"])

    partial = labelled.select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    total = (partial.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at")
             .agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")))
    return {r.lang: np.array([x.x for x in r.v]) for r in total.collect()}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_rows: int = 5_000, dimensions: int = DIMENSIONS, batch_bytes: int = 1 << 19) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id as text
    leaves 2 by 4; such rows are never learned from), lang_pred, score (cosine
    with the prototype, 0 to 1).

    Null texts and texts without a letter get ``und`` and score 0, and so does
    everything if no row can be learned from. Equal cosines: the first language
    in alphabetical order. A null id is not held out and is not learned from."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.col(lang_col).cast("string").alias("lang"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labelled = own.where(~held & F.col("lang").isNotNull())
    known = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    shares = [F.lit(x) for lang, n in known.items() for x in (lang, int(min(1.0, train_rows / n) * (1 << 30)))]
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.create_map(*shares)[F.col("lang")] if shares else F.lit(False)
    prototypes = learn_prototypes(labelled.where(chosen), dimensions, batch_bytes)
    names = sorted(prototypes)
    targets = _unit(np.array([prototypes[n] for n in names]).reshape(len(names), dimensions)).astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, classes = letter_vectors(dimensions), per_worker(("letter classes",), _letter_classes)
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                vectors, known = text_vectors(part.column("text").to_pylist(), letters, classes)
                known &= len(names) > 0
                cosines = _unit(vectors) @ targets.T if names else np.zeros((len(known), 1), np.float32)
                best = cosines.argmax(axis=1)
                pred = [names[b] if k else "und" for b, k in zip(best, known)]
                value = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(value)],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")).mapInArrow(
        score, schema_with(docs, id_col, "held_out boolean, lang_pred string, score double"))
