"""Operator 11: conversation structure repair by a persistent audit DP.

A conversation is edited (keep, re-role, delete, insert) until its role
initials read ``(s?(ua)+)?``. The programme runs over the rows in order with
four states (nothing yet, after s, after u, after a); a state holds its least
cost and, of all cheapest edit sequences, the ASCII-least one. Sequences are
not copied: each is a linked node (parent, edit), so the four states share
their prefixes. A node has binary-lifting ancestors and the rolling hash of its
sequence; two sequences of equal cost are compared by a search for their
longest common prefix over these, and a hash that two different nodes share is
verified on the edits themselves. Rows before the common ancestor of all
states are settled and written out, so nodes stay few.

On Spark: equal (role, text) rows of a conversation are found by an aggregate
and a join, both spread over the cluster whatever the size of a conversation;
then rows stream in order of turn through one pass. That pass holds about a
byte an edit of a conversation, since the result returns its edits as one
string; texts beyond ``spill_chars`` wait in an unlinked temporary file until
the edits are known. One SHA-256 over a conversation is a chain and cannot be
divided further.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
#: states: nothing yet, after s, after u, after a; a conversation may end in the first and the last
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60

RESULT = """gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
repaired_sha256 string"""


class Edits:
    """Linked edit sequences. Node 0 is the empty sequence."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.edit, self.depth, self.hash = bytearray(1), array("q", [0]), array("Q", [0])
        self.up = [array("q", [0])]  # up[k][node]: its ancestor 2**k edits back

    def grow(self, parent: int, edit: str) -> int:
        node, code = len(self.edit), ord(edit)
        self.edit.append(code)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 1_000_003 + code) % self.modulus)
        self.up[0].append(parent)
        if self.depth[node] >= 1 << len(self.up):
            self.up.append(array("q", bytes(8 * node)))
        for k in range(1, len(self.up)):
            self.up[k].append(self.up[k - 1][self.up[k - 1][node]])
        return node

    def ancestor(self, node: int, depth: int) -> int:
        back = self.depth[node] - depth
        for k in range(back.bit_length()):
            if back >> k & 1:
                node = self.up[k][node]
        return node

    def _first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """Of two nodes of equal depth, edit by edit: the shallowest nodes
        whose edits differ; None if the sequences are equal."""
        found = None
        while a != b:
            if self.edit[a] != self.edit[b]:
                found = a, b
            a, b = self.up[0][a], self.up[0][b]
        return found

    def less(self, a: int, b: int) -> bool:
        """The sequence of ``a`` comes before that of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x != y and self.hash[x] != self.hash[y]:
            for up in reversed(self.up):
                if self.hash[up[x]] != self.hash[up[y]]:
                    x, y = up[x], up[y]
            before = self.up[0][x], self.up[0][y]
            # equal hashes of different nodes may collide: then the difference lies further up
            x, y = (before[0] != before[1] and self._first_difference(*before)) or (x, y)
            return self.edit[x] < self.edit[y]
        differ = x != y and self._first_difference(x, y)
        return self.edit[differ[0]] < self.edit[differ[1]] if differ else self.depth[a] < self.depth[b]

    def text(self, node: int, above: int = 0) -> str:
        """The edits from below ``above`` to ``node``."""
        out = bytearray()
        while node != above:
            out.append(self.edit[node])
            node = self.up[0][node]
        return out[::-1].decode()

    def shared(self, nodes: list[int]) -> int:
        """Deepest common ancestor."""
        x = nodes[0]
        for y in nodes[1:]:
            depth = min(self.depth[x], self.depth[y])
            x, y = self.ancestor(x, depth), self.ancestor(y, depth)
            for up in reversed(self.up):
                if up[x] != up[y]:
                    x, y = up[x], up[y]
            x = self.up[0][x] if x != y else x
        return x


def cheapest_edits(rows: str, modulus: int = (1 << 61) - 1, settle_nodes: int = 1 << 16) -> tuple[int, str]:
    """(cost, ASCII-least cheapest edits) of a conversation given as a letter a
    row: s, u, a or o (other) by its role's initial, the capital for a
    truncated row, x for one that must go."""
    edits, heads, settled = Edits(modulus), [(0, 0), (FAR, 0), (FAR, 0), (FAR, 0)], []

    def best(offers: list[tuple[int, int, str]]) -> tuple[int, int]:
        """Of (cost, node, next edit): the cheapest, ASCII-least one."""
        cost = min(c for c, _, _ in offers)
        if cost >= FAR:
            return FAR, 0
        node = None
        for c, parent, edit in offers:
            if c == cost:
                new = edits.grow(parent, edit) if edit else parent
                node = new if node is None or edits.less(new, node) else node
        return cost, node

    def with_inserts(now: list) -> list:
        now = list(now)
        now[AFTER_U] = best([(*now[AFTER_U], ""), *((now[s][0] + INSERT, now[s][1], "I")
                                                    for s in (START, AFTER_S, AFTER_A))])
        now[AFTER_A] = best([(*now[AFTER_A], ""), (now[AFTER_U][0] + INSERT, now[AFTER_U][1], "I")])
        return now

    for row in rows:
        now = with_inserts(heads)
        offers = [[(now[s][0] + DELETE, now[s][1], "D")] for s in range(4)]
        if row != "x":
            extra, role = (TRUNCATED if row.isupper() else 0), row.lower()
            if role == "s":
                offers[AFTER_S].append((now[START][0] + KEEP + extra, now[START][1], "K"))
            for s in (START, AFTER_S, AFTER_A):
                edit, price = ("K", KEEP) if role == "u" else ("R", REROLE)
                offers[AFTER_U].append((now[s][0] + price + extra, now[s][1], edit))
            edit, price = ("K", KEEP) if role == "a" else ("R", REROLE)
            offers[AFTER_A].append((now[AFTER_U][0] + price + extra, now[AFTER_U][1], edit))
        heads = [best(o) for o in offers]
        if len(edits.edit) > settle_nodes:
            edits, heads, done = _settle(edits, heads)
            settled.append(done)
            settle_nodes = max(settle_nodes, 2 * len(edits.edit))
    now = with_inserts(heads)
    cost, node = min((now[s] for s in (START, AFTER_A)), key=lambda h: h[0])
    if now[START][0] == now[AFTER_A][0] and edits.less(now[START][1], node):
        node = now[START][1]
    return cost, "".join(settled) + edits.text(node)


def _settle(edits: Edits, heads: list) -> tuple[Edits, list, str]:
    """The live sequences alone, without what all of them begin with. A state
    dearer by more than any way to reach it from another one can be left out:
    at most one deletion, two inserts and a re-role."""
    least = min(c for c, _ in heads)
    heads = [(c, n) if c <= least + DELETE + 2 * INSERT + REROLE + TRUNCATED else (FAR, 0) for c, n in heads]
    live = [n for c, n in heads if c < FAR]
    root = edits.shared(live)
    fresh, moved = Edits(edits.modulus), {root: 0}
    for node in live:
        chain = []
        while node not in moved:
            chain.append(node)
            node = edits.up[0][node]
        for old in reversed(chain):
            moved[old] = fresh.grow(moved[edits.up[0][old]], chr(edits.edit[old]))
    return fresh, [(c, moved[n] if c < FAR else 0) for c, n in heads], edits.text(root)


class Rows:
    """(role, text) of a conversation's rows, beyond ``spill_chars`` in a file
    of the task that has no name and goes with it."""

    def __init__(self, spill_chars: int):
        self.spill_chars, self.held, self.chars, self.file = spill_chars, [], 0, None

    def append(self, role: str, text: str) -> None:
        self.held.append((role, text))
        self.chars += len(text) + len(role) + 64
        if self.chars > self.spill_chars:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.held


def repaired_lines(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[str]:
    """``role:text`` of the repaired conversation; inserted and re-roled rows
    take the role that must follow."""
    rows, last = iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield f"{role}:{text}"


class Conversation:
    """What streams by of one conversation, and its repair."""

    def __init__(self, spill_chars: int, repair):
        self.rows, self.letters, self.repair = Rows(spill_chars), bytearray(), repair
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = self.initial = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        core = text.rstrip(BLANKS)
        seen = not first or self.before == (role, text)
        self.before = role, text
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not core:
            self.blank += 1
            letter = "x"
        elif seen:
            self.duplicate += 1
            letter = "x"
        elif not core.endswith(ENDS):
            self.truncated += 1
            letter = letter.upper()
        self.letters.append(ord(letter))
        self.rows.append(role, text)

    def result(self) -> tuple:
        cost, audit = self.repair(self.letters.decode())
        digest, gap = hashlib.sha256(), b""
        for line in repaired_lines(self.rows, audit):
            digest.update(gap + line.encode("utf-8", "surrogatepass"))
            gap = b"\n"
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present_col: str | None = None, spill_chars: int = 1 << 24) -> DataFrame:
    """One row per conversation: conv_id, gaps in its turns, faults (blank,
    duplicate, truncated rows; a row's first fault counts), illegal role
    changes, cost, audit (K, R, D, I in order) and repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text in
    code-point order. Null roles and texts count as one space. A null conv_id
    is a conversation of its own. Rows whose ``present_col`` is false only say
    that their conversation exists; one without other rows gets zeros, an empty
    audit and the hash of the empty string. An empty table gives no row. Other
    columns are ignored. ``turn_col`` must hold whole numbers."""
    there = F.coalesce(F.col(present_col), F.lit(True)) if present_col else F.lit(True)
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      _or_space(F.col(role_col)).alias("role"), _or_space(F.col(text_col)).alias("text"),
                      there.alias("present"))
    own = own.withColumn("text_key", F.sha2("text", 256))
    # the least turn (null first) of equal rows; an aggregate before the shuffle, so copies do not gather
    first = (own.where("present").groupBy("conv_id", "role", "text_key")
             .agg(F.min(F.struct("turn")).alias("first")).select(
                 F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("text_key").alias("f_key"),
                 F.col("first.turn").alias("f_turn")))
    said = own.where("present").join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role"))
                                     & (F.col("text_key") == F.col("f_key"))).select(
        "conv_id", "turn", "role", "text", F.col("turn").eqNullSafe(F.col("f_turn")).alias("first"))
    absent = own.where("not present").select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("first"))
    ordered = said.unionByName(absent) if present_col else said
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema[conv_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lru_cache(1 << 16)(cheapest_edits)  # conversations of the same shape have the same edits
        pick = lambda letters: short(letters) if len(letters) <= 64 else cheapest_edits(letters)
        now, key, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for conv, turn, role, text, first in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "first"))):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.result()))
                    now, key = Conversation(spill_chars, pick), conv
                if first is not None:
                    now.add(turn, role, text, first)
            if out:
                yield batch_of()
                out = []
        if now is not None:
            out.append((key, *now.result()))
            yield batch_of()

    fields = StructType([StructField("conv_id", kind), *StructType.fromDDL(RESULT).fields])
    return ordered.mapInArrow(run, fields)


def _or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) damaged by
    crc32(``conv_id:turn``) modulo 20 (nulls: one space): 0 drops the row
    (present false), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 sets role user."""
    harm = (F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))) % 20)
    rows = rows.select("conv_id", "turn", _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"),
                       harm.alias("harm"))
    text = (F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("harm") != 0).alias("present"),
                       F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
                       ).drop("copy")
