"""Operator 7: benchmark decontamination by spaced seeds, DataFrame operations only.

A seed is a hash of the words at selected places of a short stretch; masks
leave out fixed places, so a stretch with a replaced word there still gives the
same hash. The masks of each item length are chosen so that every overlap the
check below accepts (up to a fifth of the window's words replaced, anywhere)
leaves one of them whole; a test enumerates all of them. Seeds of the test items are joined with the seeds of every place of
every document. A hit fixes how item and document lie on each other (the
diagonal); there all words of the item are compared, and the overlap counts if
some window of WINDOW words agrees in MIN_SHARE of its places.

Places and masks are exploded inside one stage and meet the seed table of the
items in it, so nothing but hits is shuffled. The seed table is broadcast only
up to ``block_seeds`` rows, which is counted; a larger one is searched in
blocks of that size, each against all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, and the share of them that must agree; the masks below are made for these.
WINDOW, MIN_SHARE = 13, 0.8

#: Selected word places of the masks, by the words of an item (WINDOW: that many or more).
MASKS = {
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 4, 5)),
    7: ((0, 2, 3, 4, 5), (0, 1, 2, 4, 6), (0, 1, 2, 3, 6)),
    8: ((0, 1, 3, 4, 5), (0, 1, 2, 3, 4)),
    9: ((0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 5, 7)),
    10: ((0, 1, 2, 4, 5), (0, 1, 5, 6, 7), (0, 1, 3, 4, 8)),
    11: ((0, 1, 3, 5, 6), (0, 1, 4, 7, 8)),
    12: ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 8, 9), (0, 1, 2, 4, 7, 10)),
    WINDOW: ((0, 1, 3, 5, 6, 7), (0, 1, 4, 5, 8, 9)),
}


def masks_of(n_words: int) -> tuple[tuple[int, ...], ...]:
    """Masks of an item; under five words no word may be replaced."""
    return MASKS[min(n_words, WINDOW)] if n_words >= 5 else (tuple(range(n_words)),)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words (runs of letters and digits)."""
    return F.transform(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"),
                       lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, places: tuple[int, ...], kind: int) -> Column:
    return F.xxhash64(F.lit(kind), *[F.get(words, at + p) for p in places])


def _item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"),
                     lambda w: w != "")
    return benchmark.select(F.col(id_col).alias("item_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("item"),
                            ).distinct().withColumn("n_item", F.size("item"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_words: int = 5,
                  tolerant_words: int = 8, block_seeds: int = 500_000) -> DataFrame:
    """One row per document id and item that overlap: doc_id, item_id, start
    (word place in the document where the best window begins), n_window, n_same
    (equal words in it), n_item.

    A window is ``WINDOW`` words, or a shorter item whole; it overlaps if at
    least MIN_SHARE of its places agree. Items under ``tolerant_words``
    words (and any under five) must occur word for word; items under
    ``min_words`` words (null and empty ones too) are too common a phrase to
    tell and match nothing. Null and empty documents match nothing. Documents
    of the same id are one document here. Repeated items of one id give one row."""
    items = _item_words(benchmark, item_col, item_text_col).where(F.col("n_item") >= min_words)
    sized = F.least(F.col("n_item"), F.lit(WINDOW))
    kinds: dict[tuple[int, ...], list[int]] = {}  # masks in use, each with the lengths (13 at most) that it is for
    for n in sorted(r.n for r in items.select(sized.alias("n")).distinct().collect()):
        for places in masks_of(n):
            kinds.setdefault(places, []).append(n)
    if not kinds:
        kinds = dict.fromkeys(MASKS[WINDOW], [WINDOW])

    def seeds(words: str, at: Column) -> list[Column]:
        return [_seed(F.col(words), at, places, k) for k, places in enumerate(kinds)]

    places = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.col("n_item") - 1)))
    seeded = [F.when((F.col("item_at") + max(mask) < F.col("n_item")) & sized.isin(lengths), seed)
              for seed, (mask, lengths) in zip(seeds("item", F.col("item_at")), kinds.items())]
    table = (places.select("item_id", "item_at", F.explode(F.array(*seeded)).alias("seed"))
             .where("seed is not null"))
    blocks = max(1, -(-table.count() // block_seeds))

    words = docs.select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("h"))
    at = words.select("doc_id", "h", F.explode_outer(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    probes = at.select("doc_id", "h", "at", F.explode(F.array(*seeds("h", F.col("at")))).alias("seed"))
    hits = None
    for block in range(blocks):
        part = table.where(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else table
        found = probes.join(F.broadcast(part), "seed").select(
            "doc_id", "item_id", "h", (F.col("at") - F.col("item_at")).alias("shift"))
        hits = found if hits is None else hits.union(found)
    # compare the whole item on its diagonal; all hits of a diagonal become one row before the shuffle
    if blocks == 1:
        hits = hits.join(F.broadcast(items), "item_id")
    else:
        hits = hits.join(items, "item_id")
    same = F.transform(F.sequence(F.lit(0), F.col("n_item") - 1),
                       lambda j: F.coalesce((F.get("h", F.col("shift") + j) == F.get("item", j)).cast("int"), F.lit(0)))
    diagonals = hits.select("doc_id", "item_id", "shift", "n_item", same.alias("same")).distinct()
    counts = F.transform(F.sequence(F.lit(0), F.col("n_item") - sized), lambda s: F.aggregate(
        F.slice("same", s + 1, sized), F.lit(0), lambda total, x: total + x))
    checked = (diagonals.withColumn("n_window", sized).withColumn("counts", counts)
               .withColumn("n_same", F.array_max("counts"))
               .where(F.col("n_same") >= F.ceil(F.col("n_window") * F.lit(MIN_SHARE) - 1e-9))
               .where((F.col("n_item") >= tolerant_words) | (F.col("n_same") == F.col("n_item")))
               .withColumn("start", F.col("shift") + F.array_position("counts", F.col("n_same")).cast("int") - 1))
    best = F.max(F.struct("n_same", (-F.col("start")).alias("neg"), "n_window", "n_item"))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.neg")).alias("start"), F.col("b.n_window").alias("n_window"),
        F.col("b.n_same").alias("n_same"), F.col("b.n_item").alias("n_item"))
