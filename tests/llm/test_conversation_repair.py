"""Operator 11 against plain versions that share no code with it."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from addrgrid.llm import conversation_repair as cr
from addrgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_way(rows, inserts=3):
    """All (cost, audit) whose initials are legal, with few inserts in a row."""
    found = []

    def go(i, out, audit, cost, run):
        if i == len(rows) and GRAMMAR.fullmatch(out):
            found.append((cost, audit))
        if run < inserts:
            for r in "ua":
                go(i, out + r, audit + "I", cost + 3, run + 1)
        if i < len(rows):
            go(i + 1, out, audit + "D", cost + 4, 0)
            if rows[i] != "x":
                more = 3 if rows[i].isupper() else 0
                go(i + 1, out + rows[i].lower(), audit + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, out + r, audit + "R", cost + more + 3, 0)
    go(0, "", "", 0, 0)
    return min(found)


def backwards(rows):
    """Cost to go from each place, then the least letter that keeps to it."""
    n, inf = len(rows), 10 ** 9
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def moves(i, s):
        for r in "ua":
            if (s, r) in step:
                yield "I", 3, i, step[s, r]
        if i < n:
            yield "D", 4, i + 1, s
            if rows[i] != "x":
                more = 3 if rows[i].isupper() else 0
                if (s, rows[i].lower()) in step:
                    yield "K", more, i + 1, step[s, rows[i].lower()]
                for r in "ua":
                    if (s, r) in step:
                        yield "R", 3 + more, i + 1, step[s, r]
    togo = {(n, s): 0 if s in ("", "a") else inf for s in ("", "s", "u", "a")}
    for i in range(n, -1, -1):
        for s in ("", "s", "u", "a"):
            togo.setdefault((i, s), inf)
        for _ in range(4):
            for s in ("", "s", "u", "a"):
                togo[i, s] = min([togo[i, s]] + [c + togo.get((j, t), inf) for _, c, j, t in moves(i, s)])
    i, s, audit = 0, "", ""
    while not (i == n and s in ("", "a") and togo[i, s] == 0):
        audit_step = min((e, c, j, t) for e, c, j, t in moves(i, s) if c + togo[j, t] == togo[i, s])
        audit, i, s = audit + audit_step[0], audit_step[2], audit_step[3]
    return togo[0, ""], audit


def test_edits_are_the_cheapest_and_least_of_all():
    rng = random.Random(1)
    for _ in range(60):
        rows = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(4)))
        assert cr.cheapest_edits(rows) == every_way(rows), rows


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 1])
def test_long_conversations_small_hashes_and_settling(modulus):
    rng = random.Random(2)
    for n in (5, 17, 60, 300):
        for letters in ("suaoSUAOx", "o", "u", "ooox", "ua"):
            rows = "".join(rng.choice(letters) for _ in range(n))
            expected = backwards(rows)
            assert cr.cheapest_edits(rows, modulus) == expected
            assert cr.cheapest_edits(rows, modulus, settle_nodes=40) == expected


def plain(rows):
    """The contract in plain Python; rows: (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, harm = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        own = groups.setdefault(conv, [])
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            own += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        faults, letters, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in own:
            core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = ("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
                     else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if fault:
                faults[fault] += 1
                letter = letter.upper() if fault == "truncated" else "x"
            letters += letter
        cost, audit = backwards(letters)
        lines, state, at = [], "", 0
        for e in audit:
            if e == "I":
                role, text = None, ""
            else:
                _, role, text = own[at]
                at += 1
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_conversation_repair"](spark, SF)) == plain(rows)


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", "", None]),
             rng.choice(["Yes.", "No", "", " \t", None, "Why?\n", "x" * 300_000 + "."]))
            for c in [None, *range(40)] for _ in range(rng.randrange(1, 9))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"Line {t % 50}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "first", F.lit("clash")).withColumn("cost", F.lit(1)).withColumn("present", F.lit(False)).repartition(5)
    expected = plain(rows)
    harmed = cr.damaged(df)
    assert result(cr.repair(harmed, present_col="present")) == expected
    assert result(cr.repair(harmed, present_col="present", spill_chars=1000)) == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = cr.repair(cr.damaged(df), present_col="present")
    assert found.columns == ["conv_id", *COLUMNS] and found.count() == 0
