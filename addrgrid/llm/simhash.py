"""Operator 3: SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made in Arrow batches; from there on only distinct
fingerprints travel (a group of copies is one row). The index is a tree over
the fingerprints in Gray order, where neighbours in rank differ in few bits:

* Upper nodes are runs of Gray rank that share their first bits, the node's
  pattern. They are rows of Spark tables: a fingerprint descends to every node
  whose pattern differs from its own bits in at most ``max_distance`` places
  (the differences add up along the way, a spent budget prunes the whole
  group). Nodes with more members than ``node_cap`` split again by the next
  bits, so a dense cluster never lands in one task.
* Inside a node a task sorts the members by Gray rank, cuts them into nested
  runs, factors out the bits that all members of a run share (mask and pattern,
  without those already spent above), and sends the node's queries down,
  dropping a run as soon as the accumulated differences exceed the limit.

Each node returns links to the roots of its local groups (never all pairs), and
components are contracted over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import byte_slices, id_and_text, let_go, schema_with
from .components import components

FAN_OUT = 8


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text as an unsigned integer; 0 for a text without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only; space and \t-\r only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in
                          zip(starts[:n].tolist(), ends[size - 1:].tolist())), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        octets = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(set_in * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                fp = [fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema_with(docs, id_col, "fp long"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(members: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Nested runs of Gray-sorted members, widest first: run length, and for
    each run the mask and the pattern of the bits that its members share and
    that no wider run has factored out."""
    sizes, length = [], 1
    while length < len(members):
        sizes.append(length)
        length *= FAN_OUT
    sizes.append(length)
    levels, spent, parent = [], np.zeros(1, np.uint64), sizes[-1]
    for length in reversed(sizes):
        starts = np.arange(0, len(members), length)
        every = np.bitwise_and.reduceat(members, starts)
        some = np.bitwise_or.reduceat(members, starts)
        shared = ~(every ^ some)
        above = spent[starts // parent]
        levels.append((length, shared & ~above, every))
        spent, parent = shared, length
    return levels


def search(members: np.ndarray, queries: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, member) index pairs within ``max_distance`` differing bits;
    members must be in Gray order."""
    levels = _levels(members)
    found_q, found_m = [], []
    for at in range(0, len(queries), 1 << 13):
        some = queries[at:at + (1 << 13)]
        q, run, spent = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.uint8)
        for k, (length, mask, pattern) in enumerate(levels):
            if k:  # children of the runs that are left
                step = levels[k - 1][0] // length
                child = (run[:, None] * step + np.arange(step)).ravel()
                q, spent = np.repeat(q, step), np.repeat(spent, step)
                there = child < len(mask)
                q, run, spent = q[there], child[there], spent[there]
            spent = spent + np.bitwise_count((some[q] ^ pattern[run]) & mask[run])
            left = spent <= max_distance
            q, run, spent = q[left], run[left], spent[left]
        found_q.append(q + at)
        found_m.append(run)
    return np.concatenate(found_q), np.concatenate(found_m)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def node_links(table: pa.Table, max_distance: int) -> pa.Table:
    """Links found in one node: each fingerprint to the root of its group."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    member = table.column("member").to_numpy(zero_copy_only=False)
    own = np.unique(fp[member])
    if not len(own):  # only visitors: a run of ranks that holds nothing
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    own = own[np.argsort(gray_rank(own), kind="stable")]
    queries = np.concatenate([own, np.unique(fp[~member])])
    q, m = search(own, queries, max_distance)
    root = _local_roots(len(queries), q, m)  # queries begin with the members, in order
    linked = root != np.arange(len(queries))
    return pa.table({"a": queries[linked].view(np.int64), "b": queries[root[linked]].view(np.int64)})


def _flips(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, ones) of all masks over ``bits`` bits with at most ``most`` ones."""
    return [(sum(1 << i for i in c), r) for r in range(most + 1) for c in combinations(range(bits), r)]


def _descend(rows: DataFrame, bits: int, depth: int, most: int) -> DataFrame:
    """Children (one level of ``bits`` bits below) that each row may enter: a
    member enters its own child as a member and later siblings as a query."""
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(r).alias("r")) for m, r in _flips(bits, most)])
    down = rows.withColumn("f", F.explode(flips)).where(F.col("spent") + F.col("f.r") <= most)
    own = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    low = own.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    child = F.shiftleft("node", bits).bitwiseOR(low.bitwiseXOR(F.col("f.m")))
    down = down.select(child.alias("node"), "fp", (F.col("spent") + F.col("f.r")).alias("spent"),
                       (F.col("member") & (F.col("f.r") == 0)).alias("member"),
                       F.when(F.col("member") & (F.col("f.r") > 0), child > own).otherwise(True).alias("ahead"))
    return down.where("ahead").drop("ahead")


def links(distinct_fp: DataFrame, n: int, max_distance: int = 2, node_size: int = 1024,
          node_cap: int = 4096, split_bits: int = 6) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most
    ``max_distance`` bits apart: a spanning set of each node's groups, so that
    reachability is that of all pairs. ``n`` sets the depth of the first
    level: about ``node_size`` members a node."""
    first = min(30, max(0, (max(n, 1) // node_size).bit_length()))
    rows = _descend(distinct_fp.select(F.lit(0).cast("long").alias("node"), "fp", F.lit(0).alias("spent"),
                                       F.lit(True).alias("member")), first, first, max_distance)
    depth, leaves = first, None
    while True:
        sizes = rows.where("member").groupBy("node").count()
        over = sizes.where(F.col("count") > node_cap).select("node")
        last = depth >= 64 or over.isEmpty()
        here = rows if last else rows.join(over, "node", "left_anti")
        here = here.select(F.lit(depth).alias("depth"), "node", "fp", "member")
        leaves = here if leaves is None else leaves.union(here)
        if last:
            break
        bits = min(split_bits, 64 - depth)
        depth += bits
        down = _descend(rows.join(over, "node", "left_semi"), bits, depth, max_distance)
        there = down.where("member").select("node").distinct()
        rows = cut_lineage(down.join(there, "node", "left_semi"))
    return leaves.groupBy("depth", "node").applyInArrow(
        lambda table: node_links(table, max_distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    seed: int = 42, max_distance: int = 2, hot_share: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links of fingerprints that
    differ in at most ``max_distance`` bits, itself included).

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Equal texts and repeated rows share a fingerprint. A null doc_id is
    never a component's smallest unless all are null; then component_id is null.

    Rows whose fingerprint has more than ``hot_share`` of all rows get their
    component by a broadcast of those fingerprints, so that no task of the last
    join holds a whole group of copies."""
    own = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed))
    reps = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    size = reps.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    groups = components(links(reps.select("fp"), size["distinct"], max_distance)).withColumnRenamed("node", "fp")
    groups = groups.join(reps, "fp")
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = groups.join(lowest, "component").select("fp", "component_id")
    named = cut_lineage(reps.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id"), (F.col("n") > hot_share * size["rows"]).alias("hot")))
    hot = F.broadcast(named.where("hot").drop("hot"))  # fewer than 1 / hot_share rows
    cold = own.join(hot, "fp", "left_anti").join(named.where("not hot").drop("hot"), "fp")
    return cold.unionByName(own.join(hot, "fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
