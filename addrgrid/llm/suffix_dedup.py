"""Operator 12: removal of repeated byte strings by suffix arrays.

Every byte goes that a string of ``length`` bytes covers which also starts
anywhere else. Steps, each a Spark job over stored tables:

1. Candidates. Of each ``length``-byte window the place with the least hash of
   ``gram`` bytes is an anchor (leftmost of equals, so equal windows have their
   anchor at the same place). A window that occurs twice has an anchor whose
   hash occurs twice; stretches without such an anchor hold no repeat and need
   no sorting. Nothing is decided by these hashes.
2. Shards. Stretches with a common anchor go to the same shard as far as its
   size allows (about ``shard_bytes``; larger groups are split). Each shard is
   sorted by Larsson-Sadakane refinement in numpy: order by 8 bytes, then only
   groups that are not in order yet by the rank of what follows, doubling the
   depth. Kasai's walk over the text gives common prefixes of neighbours, many
   stretches of the text at a time. A window repeats if a neighbour shares
   ``length`` bytes.
3. Merge. Windows with an anchor that other shards hold too leave the shard as
   a sorted run of 128-bit fingerprints, each distinct window once; runs of one
   fingerprint range are merged by binary search, and a window that two runs
   hold repeats.
4. Cover. Ranges of a text are united and cut out.

Equal whole texts are one text with a number of copies (an aggregate before
the shuffle), so a group of copies never gathers. All keys of shuffles with
unbounded groups (anchor hash, text) are counted by aggregates and joined, not
collected. Matches never cross texts: a byte that UTF-8 never holds separates
them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import byte_slices
from .stored import stored

SEPARATOR = 0xFF
STEP = 1 << 17  # windows looked at together
PLACE_BITS = 18  # places of such a step
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_of(length: int) -> int:
    """Bytes of an anchor: the largest power of two (8 at least) up to a third of the window."""
    return max(8, 1 << int(math.log2(max(8, length / 3))))


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that sorts like them."""
    w = data.astype(np.uint64)
    for n in (1, 2, 4):
        w = (w[:-n] << np.uint64(8 * n)) | w[n:]
    return w


def joined(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    h = left * MIX[seed]
    h ^= right * MIX[2] + (h >> np.uint64(31))
    h *= MIX[3 - seed]
    h ^= h >> np.uint64(29)
    return h


def string_hash(w: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes (a multiple of 8, or the last 8 overlap)
    from each place on, from the words."""
    n, h, done, total = 8, joined(w, w, seed), None, 0
    while True:
        if length // n & 1 or n * 2 > length:
            part = h[total:] if total else h
            done = part if done is None else joined(done[:len(part)], part, seed)
            total += n
        if n * 2 > length:
            break
        h = joined(h[:-n], h[n:], seed)
        n *= 2
    if total < length:
        done = joined(done[:len(w) - length + 8], w[length - 8:], seed)
    return done[:len(w) - length + 8]


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:len(x) - (width - n)], x[width - n:]) if width > n else x


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the windows that ``valid`` marks."""
    gram = gram_of(length)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64((1 << PLACE_BITS) - 1)
    n = len(data) - length + 1
    for at in range(0, n, STEP):
        here = valid[at:min(n, at + STEP)]
        part = data[at:at + len(here) + length - 1]
        if not here.any():
            continue
        h = string_hash(words(part), gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        found = (least_of(key, length - gram + 1) & low)[:len(here)][here].astype(np.int64)
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        places.append(found + at)
        hashes.append(h[found])
    return np.concatenate(places), np.concatenate(hashes)


def laid_out(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a separator after each text and enough of them at the end,
    start of each text, which places begin a window inside a text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    sep = bytes([SEPARATOR])
    data = np.frombuffer(sep.join(texts) + sep * (2 * length + 16), np.uint8)
    change = np.zeros(len(data) + 1, np.int32)
    some = sizes >= length
    np.add.at(change, starts[some], 1)
    np.add.at(change, (starts + sizes - length + 1)[some], -1)
    return data, starts, np.cumsum(change[:-1]) > 0


def suffix_array(data: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Order of the first ``n`` suffixes by their first ``depth`` bytes at
    least, then by place, by Larsson-Sadakane refinement; ``data`` goes on with
    separators."""
    w = words(data)[:n]
    order = np.argsort(w).astype(np.int32)
    sorted_words = w[order]
    first = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    rank = np.full(len(data), n, np.int32)  # of a place: where its group begins
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    at = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]])).astype(np.int32)  # places in groups of two and more
    h = 8
    while h < depth and len(at):
        place = order[at]
        key = (rank[place].astype(np.uint64) << np.uint64(32)) | rank[place + h].astype(np.uint64)
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[at] = place
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[place] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~first | ~np.concatenate([first[1:], [True]])]
        h *= 2
    order[at] = order[at][np.argsort((rank[order[at]].astype(np.uint64) << np.uint64(32)) | order[at].astype(np.uint64))]
    return order


def long_prefixes(data: np.ndarray, order: np.ndarray, length: int, lanes: int = 1 << 13) -> np.ndarray:
    """For each place in ``order``: whether the suffix shares ``length`` bytes
    with the one before it in the order. Kasai's walk: where the neighbour
    moves on by one as well, the common prefix is that at the place before less
    one and is not compared again (suffixes are in order up to ``length`` bytes
    only, so another neighbour is compared anew); the text is walked in
    ``lanes`` stretches at a time."""
    n = len(order)
    w = words(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    stride = -(-n // lanes)
    start, h = np.arange(0, n, stride), np.zeros(-(-n // stride), np.int64)
    shared, last = np.zeros(n, bool), np.full(len(start), -2)
    for k in range(stride):
        place = start + k
        place = place[place < n]
        other = before[place]
        h = np.where(other == last[:len(place)] + 1, np.maximum(h[:len(place)] - 1, 0), 0)
        last = other
        open_ = np.flatnonzero((other >= 0) & (h < length))
        while len(open_):
            differ = w[place[open_] + h[open_]] ^ w[other[open_] + h[open_]]
            same = differ == 0
            # leading equal bytes of the words that differ; without neighbouring ones the float keeps the top bit
            bits = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
            h[open_] += np.where(same, 8, np.maximum(0, (64 - bits) >> 3))
            open_ = open_[same & (h[open_] < length)]
        shared[place] = h >= length
    return shared[order]


def sorted_shard(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of the texts, valid window places, which of them repeat,
    number of the group of equal windows of each place)."""
    data, starts, valid = laid_out(texts, length)
    n = int(starts[-1]) + len(texts[-1]) if texts else 0
    order = suffix_array(data, n, length)
    same = long_prefixes(data, order, length) & valid[order]
    repeats, group = np.zeros(len(data), bool), np.zeros(len(data), np.int32)
    repeats[order] = (same | np.concatenate([same[1:], [False]])) & valid[order]
    group[order] = np.cumsum(~same)
    return data, starts, valid, repeats, group


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For sorted runs of distinct 128-bit numbers (high, low): which numbers
    of each run another run holds. Runs are merged in pairs; the numbers of one
    are searched in the other by bisection."""
    base = np.cumsum([0, *(len(h) for h, _ in runs)])
    met = np.zeros(base[-1], bool)
    queue = [(h, lo, np.arange(b, b + len(h))) for (h, lo), b in zip(runs, base)]
    while len(queue) > 1:
        (h1, l1, e1), (h2, l2, e2) = sorted(queue[:2], key=lambda q: -len(q[0]))
        left, right = np.searchsorted(h1, h2, "left"), np.searchsorted(h1, h2, "right")
        found = np.zeros(len(h2), bool)
        put = left.copy()
        for step in range(int((right - left).max(initial=0))):  # numbers that share the high half, nearly always one
            here = np.flatnonzero(left + step < right)
            lows = l1[left[here] + step]
            equal = here[lows == l2[here]]
            met[e2[equal]] = met[e1[left[equal] + step]] = True
            found[equal] = True
            put[here[lows < l2[here]]] += 1
        new = ~found
        queue = queue[2:] + [tuple(np.insert(x1, put[new], x2[new]) for x1, x2 in ((h1, h2), (l1, l2), (e1, e2)))]
    return [met[a:b] for a, b in zip(base[:-1], base[1:])]


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    begin = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[begin], reach[np.concatenate([begin[1:], [True]])]


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _anchor_table(texts: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """(key, copies, hashes, places) of each distinct text of ``length`` bytes and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "body", batch_bytes):
                data, starts, valid = laid_out(part.column("body").to_pylist(), length)
                places, hashes = anchors(data, valid, length)
                cut = np.searchsorted(places, starts)
                ends = pa.array(np.append(cut, len(places)).astype(np.int32))
                own = places - np.repeat(starts, np.diff(np.append(cut, len(places))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(own))], names=["key", "hashes", "places"])

    found = texts.select("key", "body").mapInArrow(run, "key binary, hashes array<long>, places array<long>")
    return found.groupBy("key").agg(F.count("*").alias("copies"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))


def _units(held: DataFrame, length: int, unit_bytes: int) -> DataFrame:
    """The stretches of windows around shared anchors; cut where they are long,
    so that no window begins in two of them."""
    gram = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "body", unit_bytes):
                for k in range(part.num_rows):
                    body = part.column("body")[k].as_buffer()
                    near = part.column("near")[k].values
                    place, hashes = (near.field(c).to_numpy() for c in ("place", "hash"))
                    order = np.argsort(place, kind="stable")
                    place, hashes = place[order], hashes[order]
                    last = body.size - length
                    first, end = united(np.maximum(0, place - (length - gram)), np.minimum(place, last) + 1)
                    cuts = [(a, min(b, a + unit_bytes)) for f, e in zip(first.tolist(), end.tolist())
                            for a, b in ((x, e) for x in range(f, e, unit_bytes))]
                    rows = []
                    for a, b in cuts:
                        lo, hi = np.searchsorted(place, [a, b + length - gram])
                        rows.append({"key": part.column("key")[k].as_py(), "at": a, "stretch": body[a:b + length - 1].to_pybytes(),
                                     "copies": part.column("copies")[k].as_py(), "least": int(hashes.min()),
                                     "hashes": hashes[lo:hi], "places": place[lo:hi] - a})
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("stretch", pa.binary()), ("copies", pa.int64()),
                        ("least", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
    return held.mapInArrow(run, "key binary, at long, stretch binary, copies long, least long, hashes array<long>, places array<long>")


SORTED = """shard long, bucket int, keys array<binary>, at array<long>, copies array<long>, starts array<long>,
sizes array<long>, repeats binary, high binary, low binary, place binary"""


def _sort_shard(length: int, buckets: int):
    gram = gram_of(length)

    def run(units: pa.Table, cross: pa.Table) -> pa.Table:
        if not units.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        units = units.combine_chunks()
        shard, texts = units["shard"][0].as_py(), units["stretch"].to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        data, starts, valid, repeats, group = sorted_shard(texts, length)
        for k in np.flatnonzero(units["copies"].to_numpy() > 1):
            repeats[starts[k]:starts[k] + sizes[k] - length + 1] = True
        rows = [{"shard": shard, "bucket": -1, "keys": units["key"].to_pylist(), "at": units["at"].to_pylist(),
                 "copies": units["copies"].to_pylist(), "starts": starts, "sizes": sizes,
                 "repeats": np.packbits(repeats).tobytes()}]
        if cross.num_rows:
            number = {u: k for k, u in enumerate(units["unit"].to_pylist())}
            unit = np.array([number[u] for u in cross["unit"].to_pylist()], np.int64)
            place = cross["place"].to_numpy() + starts[unit]
            first, end = united(np.maximum(starts[unit], place - (length - gram)), place + 1)
            change = np.zeros(len(data) + 1, np.int32)
            change[first], change[end] = 1, -1  # united ranges never touch
            sent = np.flatnonzero((np.cumsum(change[:-1]) > 0) & valid)
            sent = sent[np.unique(group[sent], return_index=True)[1]]  # each distinct window once
            w = words(data)
            high, low = (string_hash(w, length, seed)[sent] for seed in (0, 1))
            order = np.lexsort((low, high))
            high, low, sent = high[order], low[order], sent[order]
            bucket = ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            place = np.where(repeats[sent], -1, sent).astype("<i4")
            rows += [{"shard": shard, "bucket": b, "high": high[lo:hi].tobytes(), "low": low[lo:hi].tobytes(),
                      "place": place[lo:hi].tobytes()} for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
        return pa.Table.from_pylist(rows, schema=schema)

    binary, longs = pa.binary(), pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(binary)), ("at", longs),
                        ("copies", longs), ("starts", longs), ("sizes", longs), ("repeats", binary), ("high", binary),
                        ("low", binary), ("place", binary)])
    return run


def _merge_bucket(rows: pa.Table) -> pa.Table:
    of = rows["shard"].to_pylist()
    runs = [tuple(np.frombuffer(x, "<u8") for x in pair) for pair in zip(rows["high"].to_pylist(), rows["low"].to_pylist())]
    places = [np.frombuffer(x, "<i4") for x in rows["place"].to_pylist()]
    found = [p[met & (p >= 0)].tobytes() for p, met in zip(places, merged_runs(runs))]
    return pa.table({"shard": pa.array(of, pa.int64()), "found": pa.array(found, pa.binary())})


def _ranges(length: int):
    def run(shards: pa.Table, found: pa.Table) -> pa.Table:
        out = {"key": [], "begin": [], "end": []}
        for row in shards.to_pylist():
            repeats = np.unpackbits(np.frombuffer(row["repeats"], np.uint8)).astype(bool)
            for places in found["found"].to_pylist():
                repeats[np.frombuffer(places, "<i4")] = True
            for key, at, copies, start, size in zip(*(row[c] for c in ("keys", "at", "copies", "starts", "sizes"))):
                if copies == 1:
                    first, end = runs_of(repeats[start:start + size - length + 1])
                    if len(first):
                        out["key"].append(key)
                        out["begin"].append(first + at)
                        out["end"].append(end + at + length - 1)
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(out["key"], pa.binary()), pa.array(out["begin"], longs), pa.array(out["end"], longs)],
                        names=["key", "begin", "end"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            body = batch.column("body")[k].as_buffer()
            first, end = united(*(batch.column(c)[k].values.to_numpy() for c in ("begin", "end")))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), end.tolist()):
                digest.update(body[at:a])
                at = b
            digest.update(body[at:])
            out.append((int((end - first).sum()), len(first), digest.hexdigest()))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   shard_bytes: int = 1 << 21, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_removed, n_spans
    (maximal removed runs) and kept_sha256 (lowercase hex of what is left).

    Null texts count as empty; texts under ``length`` bytes lose nothing; rows
    that repeat a text of ``length`` bytes and more lose all of it, also if
    their ids are equal or null. Other columns are ignored. An empty table
    gives no row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.select("doc_id", "body", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    rows = rows.select("*", F.substring(F.unhex("sha"), 1, 16).alias("key"))
    long = rows.where(F.col("n_bytes") >= length)

    known = stored(_anchor_table(long, length, batch_bytes))
    # 64 bits of the key are enough here: a clash only adds a place to look at
    # stored, so that both sides of the join are plain shuffles and a hot hash is split
    shared = stored(known.select(F.explode("hashes").alias("hash")).groupBy("hash").count().where("count > 1").select("hash"))
    places = known.select(F.xxhash64("key").alias("short"), F.explode(F.arrays_zip("hashes", "places")).alias("a")).select(
        "short", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    near = places.join(shared, "hash").groupBy("short").agg(F.collect_list(F.struct("place", "hash")).alias("near"))
    near = known.select("key", "copies", F.xxhash64("key").alias("short")).join(near, "short").drop("short")
    whole = long.groupBy("key").agg(F.first("body").alias("body"))
    held = stored(whole.join(near, "key"))
    in_text = F.filter("near", lambda a: a["place"] <= F.octet_length("body") - gram_of(length))
    units = stored(_units(held.withColumn("near", in_text), length, shard_bytes // 2))

    size = F.octet_length("stretch")
    n_buckets = max(1, math.ceil((units.agg(F.sum(size)).first()[0] or 0) / (shard_bytes / 2)))
    units = units.select("*", F.xxhash64("key", "at").alias("unit"), F.pmod("least", F.lit(n_buckets)).alias("home"))
    split = units.groupBy("home").agg(F.ceil(F.sum(size) / shard_bytes).alias("parts"))
    units = units.join(split, "home").withColumn("shard", F.col("home") * (1 << 24) + F.pmod("unit", "parts"))
    apart = units.select("shard", "unit", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select(
        "shard", "unit", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    in_several = stored(apart.groupBy("hash").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("hash"))
    cross = stored(apart.join(in_several, "hash").select("shard", "unit", "place"))
    buckets = max(1, math.ceil(cross.count() * (length - gram_of(length)) * 16 / (2 * shard_bytes)))

    sorted_ = stored(units.select("shard", "unit", "key", "at", "copies", "stretch").groupBy("shard").cogroup(
        cross.groupBy("shard")).applyInArrow(_sort_shard(length, buckets), SORTED))
    runs = sorted_.where("bucket >= 0").select("shard", "bucket", "high", "low", "place")
    found = runs.groupBy("bucket").applyInArrow(_merge_bucket, "shard long, found binary").where("octet_length(found) > 0")
    ranges = sorted_.where("bucket < 0").select("shard", "keys", "at", "copies", "starts", "sizes", "repeats").groupBy(
        "shard").cogroup(found.groupBy("shard")).applyInArrow(_ranges(length), "key binary, begin array<long>, end array<long>")
    cover = ranges.groupBy("key").agg(F.flatten(F.collect_list("begin")).alias("begin"), F.flatten(F.collect_list("end")).alias("end"))
    cut = held.where("copies = 1").select("key", "body").join(cover, "key").mapInArrow(
        _cut, "key binary, n_removed long, n_spans long, kept_sha256 string")
    copies = known.where("copies > 1").select("key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                              F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    lost = stored(cut.union(copies)).withColumnRenamed("key", "lost_key").withColumn("lost", F.lit(True))
    return rows.drop("body").join(lost, F.col("key") == F.col("lost_key"), "left").select(
        "doc_id", "n_bytes", F.when(F.col("lost"), F.coalesce("n_removed", "n_bytes")).otherwise(0).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
