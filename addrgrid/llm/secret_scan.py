"""Operator 8: secret scan with password guess costs.

Three fixed patterns give the base spans. The value of each, and of further
places in a wider credential context (a key word, a separator, a value), is
priced by dynamic programming: the cheapest way to put the value together from
known words, dates, repeats, keyboard walks, sequences and brute-force
characters, in powers of ten of guesses. Further values that are dear enough to
guess are secrets too; base spans stay and say what they would cost. The price
takes time in proportion to the length of a value.

Map-only, in Arrow batches. A cheap look for the key words decides whether a
pattern is run at all; every pattern needs one of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import byte_slices, id_and_text, per_worker, schema_with

#: The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs of 24 or more, each found whole
ASSIGN_KEYS = ("passw", "secret", "token", "api")

#: Key words of the wider context.
CONTEXT_KEYS = ("passphrase", "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key",
                "credential", "credentials", "auth", "bearer", "private_key", "access_key", "client_secret", "login")
CONTEXT = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(CONTEXT_KEYS, key=len, reverse=True)) +
                     r""")["']?\s{0,3}(?:[:=]|=>|\bis\b|(?<=bearer))\s{0,3}["']?([^\s"'<>,;]{8,})""",
                     re.IGNORECASE | re.ASCII)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "bearer", "private_key", "access_key",
                 "login")

#: Frequent words of passwords, the most frequent first.
COMMON_WORDS = """password admin welcome letmein monkey dragon master login qwerty secret football baseball sunshine
princess shadow superman michael jordan hunter ranger buster soccer hockey killer george charlie andrew michelle love
jessica pepper daniel access joshua maggie starwars silver william dallas yankees hello freedom whatever trustno nicole
ginger heather hammer summer corvette taylor austin merlin matthew golfer cheese martin chelsea patrick richard diamond
yellow bigdog asdfgh computer internet service server system default guest user root test demo example changeme temp
public private token key pass word the and for you with this that from have not are was all can will one""".split()
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157@$!", "aeoistasi")

DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12]\d|3[01]|0?[1-9])"
                  r"|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
STEP = 0.3  # for each further segment of a password, in powers of ten


class GuessCost:
    """Guess costs of strings, in powers of ten."""

    def __init__(self, words: list[str] = COMMON_WORDS):
        self.rank = {w: k + 1 for k, w in enumerate(words)}
        self.longest = max(map(len, words))
        self.next_key = {}
        for r, row in enumerate(KEYBOARD):
            for c, key in enumerate(row):
                near = {(r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)}
                self.next_key[key] = {KEYBOARD[i][j] for i, j in near
                                      if 0 <= i < len(KEYBOARD) and 0 <= j < len(KEYBOARD[i])}

    def _words(self, value: str, lower: str, at: int):
        for end in range(at + 3, min(len(value), at + self.longest) + 1):
            part = lower[at:end]
            for plain, extra in ((part, 0.0), (part.translate(LEET), 0.5)):
                if plain in self.rank:
                    case = 0.0 if value[at:end] == part else 0.3
                    yield end, log10(self.rank[plain] + 1) + extra + case
                    break

    def _dates(self, value: str, at: int):
        found = DATE.match(value, at)
        if found:
            yield found.end(), 2.1 if found.end() - at == 4 else 4.5

    def _runs(self, value: str, lower: str):
        """For each place the repeats, walks over neighbouring keys and
        sequences of code points that begin there, as (kind, end, cost). How far
        each reaches follows from the place after it, so all of them take time
        in proportion to the length."""
        n = len(value)
        same = {unit: [0] * (n + 1) for unit in (1, 2, 3, 4)}
        walk, rise, fall = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        turns = [0] * (n + 2)  # turns at this place and after it
        for at in range(n - 1, -1, -1):
            for unit, reach in same.items():
                reach[at] = reach[at + 1] + 1 if at + unit < n and value[at] == value[at + unit] else 0
            turns[at] = turns[at + 1] + (at >= 2 and lower[at] != lower[at - 2])
            walk[at] = rise[at] = fall[at] = at + 1
            if at + 1 < n:
                step = ord(value[at + 1]) - ord(value[at])
                walk[at] = walk[at + 1] if lower[at + 1] in self.next_key.get(lower[at], ()) else at + 1
                rise[at] = rise[at + 1] if step == 1 else at + 1
                fall[at] = fall[at + 1] if step == -1 else at + 1

        def found(at: int):
            for unit, reach in same.items():
                end = at + unit + reach[at] // unit * unit
                if at + unit <= n and end - at >= max(3, 2 * unit):
                    yield "repeat", end, unit * 1.5 + log10((end - at) / unit)
            end = walk[at]
            if end - at >= 3:
                yield "walk", end, log10(47 * 6) + 0.5 * log10(end - at) + 0.2 * min(turns[at + 2] - turns[end], 12)
            for ends in (rise, fall):
                if ends[at] - at >= 3:
                    yield "walk", ends[at], 1.5 + log10(ends[at] - at)
        return found

    @staticmethod
    def _alphabet(value: str) -> float:
        """log10 of the size of the character classes that occur."""
        size = sum(n for n, pattern in ((10, r"[0-9]"), (26, r"[a-z]"), (26, r"[A-Z]"), (33, r"[^0-9a-zA-Z]"))
                   if re.search(pattern, value))
        if size and not re.search(r"[^0-9a-f]", value):
            size = 16
        return log10(max(size, 2))

    def __call__(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """(cost, segments) of the cheapest segmentation of ``value``."""
        n, letter, lower = len(value), self._alphabet(value), value.lower()
        if len(lower) != n:  # a few letters have a longer lower case
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        runs = self._runs(value, lower)
        cost, way = [0.0] + [float("inf")] * n, [("", 0)] * (n + 1)
        for at in range(n):
            here = cost[at] + (STEP if at and way[at][0] != "brute" else 0.0)
            after_brute = STEP if at and way[at][0] == "brute" else 0.0
            options = [("brute", at + 1, letter)]
            options += [("word", end, price + after_brute) for end, price in self._words(value, lower, at)]
            options += [("date", end, price + after_brute) for end, price in self._dates(value, at)]
            options += [(kind, end, price + after_brute) for kind, end, price in runs(at)]
            for kind, end, price in options:
                if here + price < cost[end]:
                    cost[end], way[end] = here + price, (kind, at)
        segments, end = [], n
        while end:
            kind, at = way[end]
            if segments and kind == "brute" == segments[-1][0]:
                segments[-1] = ("brute", at, segments[-1][2])
            else:
                segments.append((kind, at, end))
            end = at
        return cost[n], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of the base patterns."""
    spans, lower = [], text.lower()
    if any(k in lower for k in ASSIGN_KEYS):
        spans += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def value_at(text: str, start: int, kind: str, end: int) -> str:
    """What is priced of a span: the assigned value, else all of it."""
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def priced_spans(text: str, price: GuessCost, min_cost: float) -> list[tuple[int, int, str, int, float, str]]:
    """(start, order, kind, end, cost, segments) of the base spans and of the
    values in credential context outside them whose guess cost reaches
    ``min_cost`` powers of ten, by start and order."""
    spans = base_spans(text)
    lower = text.lower()
    further = []
    if any(k in lower for k in CONTEXT_HINTS):
        further = [(m.start(1), 3, "guess", m.end(1)) for m in CONTEXT.finditer(text)]
        further = [g for g in further if all(g[3] <= s or g[0] >= e for s, _, _, e in spans)]
    out = []
    for start, order, kind, end in sorted(spans + further):
        cost, segments = price(value_at(text, start, kind, end))
        if kind != "guess" or cost >= min_cost:
            out.append((start, order, kind, end, cost, " ".join(f"{k}:{a}-{b}" for k, a, b in segments)))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 10.0,
         batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_guess,
    base_spans and spans (array of kind, start, end, cost in powers of ten of
    guesses, segments of the cheapest segmentation; code points, end
    exclusive), ordered by start and kind. Null texts have none. Repeated rows
    stay repeated; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price = per_worker(("guess cost",), GuessCost)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64()),
                                   ("segments", pa.string())]))
        kinds = ("assign", "access", "hex", "guess")
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                every = [priced_spans(text, price, min_cost) for text in part.column("text").to_pylist()]
                rows = [[{"kind": k, "start": s, "end": e, "cost": c, "segments": g} for s, _, k, e, c, g in x] for x in every]
                basic = [[r for r in x if r["kind"] != "guess"] for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([sum(s[2] == k for s in x) for x in every], pa.int64())
                                              for k in kinds), pa.array(basic, span), pa.array(rows, span)],
                    names=["doc_id", *(f"n_{k}" for k in kinds), "base_spans", "spans"])

    spans = "array<struct<kind: string, start: long, end: long, cost: double, segments: string>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema_with(
        docs, id_col, f"n_assign long, n_access long, n_hex long, n_guess long, base_spans {spans}, spans {spans}"))
