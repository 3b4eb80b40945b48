"""Operator 1: token counts by Arrow batch encoding that returns lengths only.

Texts go through the tokenizer library in batches balanced by bytes. Each text
is cut before every space that follows a non-blank, where no match of the
byte-level pre-splitting pattern can reach across; what the pieces of a text
hold adds up to the whole text's tokens. A piece that occurs again is not
encoded again (a bounded table per Python worker), which is what makes counting
cheap: words repeat, so the library sees each distinct piece of a worker's
share about once. Map-only: no shuffle, nothing but counts leaves a task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow_text import BEFORE_SPACE, byte_slices, id_and_text, per_worker, schema_with

BLANK_THEN_SPACE = re.compile(r"\s ")

#: pieces that are encoded as one text
TOGETHER = 64

#: marks that end a word and that are split off it before it is looked up
TRAILING = ".,;:!?%&*$#)|"


def cuts_at_spaces(tokenizer_json: dict) -> bool:
    """True if pieces cut before spaces encode like the whole: byte-level
    pre-splitting by pattern, no normalizer, no prefix space, no post-processor
    template, special strings that neither hold nor swallow spaces."""
    pre = tokenizer_json.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not tokenizer_json.get("normalizer") and not tokenizer_json.get("truncation")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]
                        for t in tokenizer_json.get("added_tokens", ())))


def cut_at_spaces(text: str) -> list[str]:
    """The text cut before each space that follows a non-blank; all pieces but
    the first are given without the space they begin with."""
    if BLANK_THEN_SPACE.search(text) is None:
        return text.split(" ")
    head, *rest = BEFORE_SPACE.split(text)
    return [head, *(p[1:] for p in rest)]


class PieceTable:
    """What the tokenizer gives for pieces of text, each distinct piece encoded once.

    ``value`` maps the ids of a piece to what is kept of it; ``add`` joins the
    kept values of a text. Entries live in two generations of at most
    ``max_pieces``: when the young one is full it becomes the old one, and what
    is still in use comes back from there, so memory is bounded and frequent
    pieces are never encoded again. Pieces over ``max_chars`` never enter."""

    def __init__(self, tokenizer_file: str, value: Callable, add: Callable, max_pieces: int = 400_000,
                 max_chars: int = 64):
        from tokenizers import Tokenizer

        # a task has one core; the library's own threads would only take other tasks' cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = cuts_at_spaces(spec)
        special = {c for t in spec.get("added_tokens", ()) for c in t["content"]}
        self.trailing = "".join(c for c in TRAILING if c not in special)
        self.value, self.add = value, add
        added = {t["id"] for t in spec.get("added_tokens", ())}
        vocabulary = self.tokenizer.get_vocab()
        #: ids that begin with a space, which byte-level vocabularies write as this letter
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for t, k in vocabulary.items() if t[0] == "\u0120" and k not in added]] = True
        self.max_pieces, self.max_chars = max_pieces, max_chars
        self.known: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.tails: dict[str, object] = {}

    def _encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_spaced(self, pieces: list[str]) -> list:
        """The kept value of each piece, read after a space. Many go to the
        library as one text, which takes half the time. Pieces that hold no
        space and do not end in a blank are cut there as at any place of a
        text, and each begins with the only id of its own that begins with a
        space; the others are encoded one by one."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p and " " not in p and not p[-1].isspace()]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at:at + TOGETHER]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids
            begin = np.flatnonzero(self.spaced[ids]).tolist()
            if len(begin) == len(some) and begin[0] == 0:
                for i, a, b in zip(some, begin, [*begin[1:], len(ids)]):
                    out[i] = self.value(ids[a:b])
        rest = [i for i, v in enumerate(out) if v is None]
        for i, value in zip(rest, self._encode([" " + pieces[i] for i in rest])):
            out[i] = value
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Take new pieces over from the old generation or encode them; a word
        is separated from closing marks, since a match of letters always ends
        where a mark begins."""
        known, old, trailing = self.known, self.old, self.trailing
        whole, split = set(), []
        for p in pieces:
            value = old.get(p)
            if value is not None:
                known[p] = value
                continue
            word = p.rstrip(trailing)
            n = len(word)
            if n == len(p) or not n or not word[-1].isalpha() or word[-1] >= "\u0250":
                whole.add(p)
                continue
            split.append((p, word, p[n:]))
            if word not in known:
                value = old.get(word)
                if value is None:
                    whole.add(word)
                else:
                    known[word] = value
        whole = list(whole)
        known.update(zip(whole, self._encode_spaced(whole)))
        tails = list({t for _, _, t in split}.difference(self.tails))
        if len(self.tails) + len(tails) > self.max_pieces:
            self.tails.clear()
            tails = list({t for _, _, t in split})
        self.tails.update(zip(tails, self._encode(tails)))
        for p, word, tail in split:
            known[p] = self.add((known[word], self.tails[tail]))

    def batch(self, texts: list[str]) -> list:
        """The joined value of each text."""
        if not self.cuts:
            return self._encode(texts)
        if len(self.known) > self.max_pieces:
            self.known, self.old = {}, self.known
        pieces = [cut_at_spaces(t) for t in texts]
        heads = self._encode([ws[0] for ws in pieces])
        get = self.known.get
        out, gaps, new = [], [], set()
        for head, ws in zip(heads, pieces):
            values = list(map(get, ws))
            values[0] = head
            missing = [i for i, v in enumerate(values) if v is None] if None in values else ()
            new.update([ws[i] for i in missing])
            out.append(values)
            gaps.append(missing)
        long = [p for p in new if len(p) > self.max_chars]
        self._learn(new.difference(long))
        rare = dict(zip(long, self._encode([" " + p for p in long])))
        for values, missing, ws in zip(out, gaps, pieces):
            for i in missing:
                value = get(ws[i])
                values[i] = rare[ws[i]] if value is None else value
        return list(map(self.add, out))


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit). Null texts count as empty: 0, 0, false.
    Repeated rows stay repeated; a null id stays null. Begin and end tokens are
    not added; strings of special tokens inside a text are what the library
    makes of them by default (one id)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(("lengths", tokenizer_file), lambda: PieceTable(tokenizer_file, len, sum))
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                n = pa.array(table.batch(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), n,
                     pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        encode, schema_with(docs, id_col, "n_bytes long, n_tokens long, over_limit boolean"))
