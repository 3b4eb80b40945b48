"""Operator 10: toxicity by the nearest labelled examples.

Fitting. A bounded, class-balanced sample of labelled documents gives the
examples (equal texts are one example that weighs as many). Terms are words and
word beginnings, marked by a hyphen; every term that ``min_examples`` examples
hold is in the vocabulary (one that a single example holds ties it to no
other), and its document frequency is counted over the whole corpus. Vectors
are plain TF-IDF of unit length, (1 + ln tf)^2 x (1 + ln((1 + N) / (1 + df))):
no label takes part in a weight.

Scoring. Block-max inverted index: examples are ordered so that similar ones
are neighbours, and lie in blocks; each term has postings by block and its
largest weight in each block. Terms that many examples hold are added up by one
product of matrices; the others at first only in the blocks that promise most,
then in each block whose bound can still reach the k-th best cosine, so the k
nearest are exact. Each votes for its label, weighted by the inverse of its
sampling share and by its cosine, a shared term counting 1 + sqrt(chi2) times
by how unevenly the examples of the two labels hold it: what two texts share
only by chance says less. The votes give a raw score, which a monotone fit on
the examples (each scored without itself and its near copies) turns into a
calibrated one. The nearest examples are the evidence.

What the driver holds is bounded by ``examples`` and the terms they share;
scoring is map-only, with one model per Python worker.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import byte_slices, give_back, id_and_text, latest_per_worker
from .stored import stored

LETTERS = re.compile(r"[^\W\d_]+")
WIDE_LETTER = re.compile(r"[^\W\d_\x00-\xff]")
BEGINNINGS = (4, 5, 6)
BLOCK = 256
TEXTS = 128  # looked up and scored together
STEP_BYTES = 1 << 20  # looked up at a time
#: what leaves the first so many bytes of a little-endian integer
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
FIRST_BLOCKS = 3
#: lower case of each Latin-1 letter, a space for what is no letter
LATIN = bytes(ord(chr(c).lower()) if LETTERS.match(chr(c)) else 32 for c in range(256))


def latin(text: str) -> bytes | None:
    """The lower-case words as Latin-1 between spaces, None if that does not hold them."""
    try:
        return text.encode("latin-1").translate(LATIN)
    except UnicodeEncodeError:
        return None if WIDE_LETTER.search(text) else text.encode("latin-1", "replace").translate(LATIN)


def words_of(text: str) -> list[bytes]:
    """The lower-case words, as Latin-1 where that holds them, else as UTF-8 after a zero byte."""
    plain = latin(text)
    return [as_key(w) for w in LETTERS.findall(text.lower())] if plain is None else plain.split()


def as_key(word: str) -> bytes:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return b"\0" + word.encode()


def as_term(key: bytes) -> str:
    return key[1:].decode() if key[:1] == b"\0" else key.decode("latin-1")


def terms_of(word: bytes) -> list[bytes]:
    """The word and its beginnings."""
    if word[:1] == b"\0":
        whole = as_term(word)
        return [word, *(as_key(whole[:n] + "-") for n in BEGINNINGS if len(whole) > n)]
    return [word, *(word[:n] + b"-" for n in BEGINNINGS if len(word) > n)]


def profile(text: str) -> str:
    """The most frequent ASCII letter and the most frequent other letter: what
    the sample is stratified by, so that rare kinds of text teach too."""
    of = np.bincount(np.frombuffer(text.encode("latin-1", "ignore").translate(LATIN), np.uint8), minlength=256)
    plain, other = int(np.argmax(of[97:123])) + 97, int(np.argmax(of[128:])) + 128
    if not of[plain] and not of[other]:
        wide = WIDE_LETTER.findall(text)
        return max(sorted(set(wide)), key=wide.count) if 0 < len(set(wide)) < 50 else "*" if wide else ""
    return (chr(plain) if of[plain] else "") + (chr(other) if of[other] else "")


class Vocabulary:
    """Term numbers of texts. Words of Latin-1 texts are read as integers of
    their first and next eight bytes and looked up all at once; longer words,
    and those of other texts, one by one (the table that keeps the latter is
    emptied at ``max_words`` entries). Terms that such integers hold are kept
    as integers only."""

    def __init__(self, terms: list[str], max_words: int = 200_000):
        keys = [as_key(t) for t in terms]
        self.max_words, self.words = max_words, {}
        self.size = len(terms)
        short = [k for k, key in enumerate(keys) if self._is_short(key)]
        self.number = {key: k for k, key in enumerate(keys) if not self._is_short(key)}
        packed = np.frombuffer(b"".join(keys[k].ljust(16, b"\0") for k in short), "<u8").reshape(-1, 2)
        self.low, self.high, self.short = packed[:, 0].copy(), packed[:, 1].copy(), np.array(short, np.int64)
        self.slot_bits = max(4, (4 * len(short)).bit_length())
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        left, slot = np.arange(len(short)), self._slot(self.low, self.high)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            late = self.slots[slot] != left
            left, slot = left[late], (slot[late] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _is_short(key: bytes) -> bool:
        return len(key) <= 16 and key[:1] != b"\0"

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of terms by their bytes, -1 for what is none."""
        out, left, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(left):
            at = self.slots[slot]
            held = at >= 0
            left, slot, at = left[held], slot[held], at[held]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[same]] = self.short[at[same]]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _cells(self, plain: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text x 2^32 + term, times), in order, of the words between spaces;
        ``ends`` holds where each text ends."""
        padded = b" " + plain + b" " * 16
        letter = np.frombuffer(padded, np.uint8) != 32
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, length = edge[::2], edge[1::2] - edge[::2]
        text = np.searchsorted(ends, start - 1, side="right") << 32
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        low = eight[start] & FIRST_BYTES[np.minimum(length, 8)]
        # who holds a word or a longer beginning holds its first beginning too
        cells, whole, rest = [], [], np.arange(len(start))
        for n in BEGINNINGS:
            longer = length[rest] > n
            whole.append(rest[~longer])
            rest = rest[longer]
            term = self._find(low[rest] & FIRST_BYTES[n] | np.uint64(ord("-") << 8 * n), np.zeros(len(rest), np.uint64))
            rest, term = rest[term >= 0], term[term >= 0]
            cells.append(text[rest] + term)
        whole = np.concatenate([*whole, rest])
        fits = length[whole] <= 16
        beyond, whole = whole[~fits], whole[fits]
        high = eight[start[whole] + 8] & FIRST_BYTES[np.maximum(length[whole] - 8, 0)]
        term = self._find(low[whole], high)
        cells.append(text[whole[term >= 0]] + term[term >= 0])
        long = [(t, self.number.get(padded[a:a + n])) for t, a, n in
                zip(text[beyond].tolist(), start[beyond].tolist(), length[beyond].tolist())]
        cells.append(np.array([t + k for t, k in long if k is not None], np.int64))
        cell = np.sort(np.concatenate(cells))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[:len(cell)])
        return cell[first], np.diff(np.append(first, len(cell)))

    def _numbers(self, keys: set[bytes]) -> dict[bytes, int]:
        """Numbers of the keys that are terms."""
        found = {key: self.number[key] for key in keys if key in self.number}
        short = [key for key in keys if self._is_short(key)]
        packed = np.frombuffer(b"".join(key.ljust(16, b"\0") for key in short), "<u8").reshape(-1, 2)
        term = self._find(packed[:, 0], packed[:, 1]).tolist()
        return found | {key: t for key, t in zip(short, term) if t >= 0}

    def _wide_cells(self, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the one text numbered ``k``."""
        if len(self.words) > self.max_words:
            self.words = {}
        total: Counter = Counter()
        words = Counter(words_of(text))
        new = {word: terms_of(word) for word in words if word not in self.words}
        number = self._numbers({key for keys in new.values() for key in keys})
        self.words.update((word, [number[key] for key in keys if key in number]) for word, keys in new.items())
        for word, times in words.items():
            for term in self.words[word]:
                total[term] += times
        return np.array([(k << 32) + t for t in total], np.int64), np.array(list(total.values()), np.int64)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times), in this order, of the terms that occur in the texts."""
        plain = [latin(t) for t in texts]
        found = [self._wide_cells(texts[k], k) for k, own in enumerate(plain) if own is None]
        ends = np.cumsum([len(own or b"") + 1 for own in plain])
        joined, at = b" ".join(own or b"" for own in plain), 0
        while at < len(joined):  # memory follows the step, not a long text
            end = len(joined) if len(joined) - at <= STEP_BYTES else joined.find(b" ", at + STEP_BYTES)
            end = len(joined) if end < 0 else end
            found.append(self._cells(joined[at:end], ends - at))
            at = end
        cell, times = (np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in (0, 1))
        if len(found) > 1:
            by = np.argsort(cell, kind="stable")
            cell, times = cell[by], times[by]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[:len(cell)])
            cell, times = cell[first], np.add.reduceat(times, first) if len(first) else times
        return cell >> 32, cell & 0xFFFFFFFF, times


def unit_vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of length 1; empty if no term occurs."""
    terms = np.array(sorted(counts), np.int64)
    times = np.array([counts[t] for t in terms.tolist()], np.int64)
    return unit_vectors((np.zeros(len(terms), np.int64), terms, times), 1, idf)[0]


def unit_vectors(counts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int,
                 idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vector of each of ``n`` texts from their (text, term, times)."""
    text, terms, times = counts
    weights = (1 + np.log(times)) ** 2 * idf[terms]
    weights = weights / np.sqrt(np.maximum(np.bincount(text, weights ** 2, minlength=n), 1e-300))[text]
    at = np.searchsorted(text, np.arange(n + 1))
    return [(terms[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:])]


def similar_together(rows: np.ndarray, size: int) -> np.ndarray:
    """Order in which similar rows are neighbours: halved along the direction
    in which they differ most, until ``size`` are left."""
    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= size or not rows.shape[1]:
            return [at]
        own = rows[at] - rows[at].mean(axis=0)
        direction = own[int(np.argmax((own ** 2).sum(axis=1)))].copy()
        for _ in range(8):
            direction = own.T @ (own @ direction)
            direction /= max(np.sqrt((direction ** 2).sum()), 1e-300)
        at = at[np.argsort(own @ direction, kind="stable")]
        middle = -(-len(at) // (2 * size)) * size
        return halves(at[:middle]) + halves(at[middle:])

    return np.concatenate(halves(np.arange(len(rows)))) if len(rows) else np.zeros(0, np.int64)


class Index:
    """Block-max inverted index over unit vectors; exact nearest neighbours."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, common: int = 512, block: int = BLOCK):
        self.n, self.block, self.n_terms = len(vectors), block, n_terms
        self.n_blocks = max(1, -(-self.n // block))
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        held = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:common]
        often = often[held[often] > self.n / 16]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        of, dense = np.repeat(np.arange(self.n), sizes), self.column[terms] >= 0
        table = np.zeros((self.n, len(often)))
        table[of[dense], self.column[terms[dense]]] = weights[dense]
        order = similar_together(table, block)
        self.example = np.append(order, np.full(self.n_blocks * block - self.n, -1)).astype(np.int64)  # at each place
        self.place = np.zeros(self.n, np.int64)
        self.place[order] = np.arange(self.n)
        self.dense = np.zeros((len(self.example), len(often)))
        self.dense[:self.n] = table[order]
        rare = np.flatnonzero(~dense)
        cell = terms[rare].astype(np.int64) * len(self.example) + self.place[of[rare]]
        del of, table, terms, dense  # each as large as the index, or half of it
        by = np.argsort(cell)
        cell = cell[by]
        self.posting, self.weight = (cell % len(self.example)).astype(np.int32), weights[rare[by]]
        del rare, weights, by
        begin = np.searchsorted(cell, np.arange(0, (n_terms * self.n_blocks + 1) * block, block)).astype(np.int32)
        self.begin = np.concatenate([begin[:-1].reshape(n_terms, -1), begin[self.n_blocks::self.n_blocks, None]], axis=1)
        # rounded up: a bound must not be under what it bounds
        self.largest = np.zeros(n_terms * self.n_blocks, np.float32)
        np.maximum.at(self.largest, cell // block, np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        self.largest = self.largest.reshape(n_terms, self.n_blocks)

    def _add(self, sums: list[np.ndarray], begin: np.ndarray, weights: list[np.ndarray], blocks: np.ndarray) -> None:
        """Add the postings of some blocks (a flag each), once for each of some
        weightings of the terms; ``begin`` has where the blocks of each term begin."""
        flags = np.concatenate([[False], blocks, [False]])
        at = begin[:, np.flatnonzero(flags[1:] != flags[:-1])].astype(np.int64)
        first, n = at[:, ::2], at[:, 1::2] - at[:, ::2]
        at = np.repeat((first - (np.cumsum(n) - n.ravel()).reshape(n.shape)).ravel(), n.ravel())
        at += np.arange(len(at))
        place, own = self.posting.take(at, mode="clip").astype(np.int64), self.weight.take(at, mode="clip")
        n = n.sum(axis=1)
        for total, w in zip(sums, weights):
            total += np.bincount(place, own * np.repeat(w, n), minlength=len(total))

    def cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]], telling: np.ndarray | None = None) -> np.ndarray:
        """Cosine of each vector with each example, all blocks added up (with
        ``telling``, a shared term counts as many times)."""
        if telling is not None:
            vectors = [(terms, weights * telling[terms]) for terms, weights in vectors]
        sums, rare = self._common(vectors)
        for row, (terms, weights) in zip(sums, rare):
            self._add([row], self.begin[terms], [weights], np.ones(self.n_blocks, bool))
        return sums[:, self.place]

    def _common(self, vectors: list) -> tuple[np.ndarray, list]:
        often, rare = np.zeros((len(vectors), self.dense.shape[1])), []
        for row, (terms, weights) in zip(often, vectors):
            column = self.column[terms]
            dense = column >= 0
            row[column[dense]] = weights[dense]
            rare.append((terms[~dense], weights[~dense]))
        return often @ self.dense.T, rare

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine over 0, nearest
        first, equal ones in order of number."""
        return self.nearest_of_each([(terms, weights)], k, np.ones(self.n_terms))[0][:2]

    def nearest_of_each(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int,
                        telling: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``nearest`` of each vector, with the cosines in which a shared term
        counts ``telling`` times."""
        all_sums, rare = self._common(vectors)
        k, out = min(k, len(self.example)), []
        for sums, (every, shares), (terms, weights) in zip(all_sums, vectors, rare):
            sums[self.n:] = -1
            reach = sums.reshape(self.n_blocks, self.block).max(axis=1)
            reach += weights @ self.largest[terms] + 1e-9
            told, begin, both = np.zeros(len(sums)), self.begin[terms], [weights, weights * telling[terms]]
            done = np.zeros(self.n_blocks, bool)
            todo = np.zeros(self.n_blocks, bool)
            todo[np.argsort(-reach, kind="stable")[:FIRST_BLOCKS]] = True
            while todo.any():
                self._add([sums, told], begin, both, todo)
                done |= todo
                seen = sums.reshape(self.n_blocks, self.block)[done].ravel()
                # the k-th best of the blocks added up; a block under it holds no neighbour
                least = np.partition(seen, -k)[-k] if len(seen) >= k else -1.0
                todo = ~done & (reach >= max(least, 0) - 1e-9)
            sums = np.where(np.repeat(done, self.block), sums, -1)
            found = np.flatnonzero((sums >= max(least, 0) - 1e-9) & (sums > 1e-12) & (self.example >= 0))
            top = found[np.lexsort((self.example[found], -np.round(sums[found], 12)))[:k]]
            column = self.column[every]  # the common terms count for the neighbours alone
            row, common = np.zeros(self.dense.shape[1]), column >= 0
            row[column[common]] = (shares * telling[every])[common]
            out.append((self.example[top], sums[top], told[top] + self.dense[top] @ row))
        return out


def monotone_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from x on, value) of the best non-decreasing fit of y on x."""
    groups: list[list[float]] = []
    for at in np.unique(x):
        here = x == at
        groups.append([at, float((w[here] * y[here]).sum()), float(w[here].sum())])
        while len(groups) > 1 and groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2]:
            last = groups.pop()
            groups[-1][1] += last[1]
            groups[-1][2] += last[2]
    return np.array([g[0] for g in groups]), np.array([g[1] / g[2] for g in groups])


def label_weights(counts: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + sqrt(chi2) of each term: how unevenly the examples of the two labels hold it."""
    a, b = (np.bincount(counts[1][labels[counts[0]] == y], minlength=n_terms).astype(np.float64) for y in (1, 0))
    m1, m0 = float((labels == 1).sum()), float((labels == 0).sum())
    n = m1 + m0
    return 1 + np.sqrt(n / np.maximum((a + b) * (n - a - b) * m0 * m1, 1e-9)) * np.abs(a * m0 - b * m1)


class Model:
    """Examples, index and calibration. The index is built where it is used."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list, labels: np.ndarray, weights: np.ndarray,
                 counts: tuple[np.ndarray, np.ndarray, np.ndarray], base_rate: float, neighbours: int, copy_cosine: float):
        self.version = uuid.uuid4().hex
        self.terms, self.ids, self.labels, self.idf = terms, ids, labels.astype(np.float64), idf
        self.weights = weights / max(weights.mean(), 1e-12) if len(ids) else weights
        self.base_rate, self.k = base_rate, neighbours
        # the rows in order: their lengths, terms and times
        self.rows = np.bincount(counts[0], minlength=len(ids)), counts[1].astype(np.int32), counts[2].astype(np.int32)
        self.steps, self.values = np.array([0.0]), np.array([base_rate])
        self.telling = label_weights(counts, labels, max(1, len(terms)))
        if ids:
            raw = []
            vectors = unit_vectors(counts, len(ids), idf)
            self.prepare()
            for at in range(0, len(ids), TEXTS):
                some = vectors[at:at + TEXTS]
                cosines, told = np.round(self.index.cosines(some), 12), self.index.cosines(some, self.telling)
                cosines[np.arange(len(cosines)), np.arange(at, at + len(cosines))] = -1
                cosines[cosines >= copy_cosine] = -1  # an example's own copies are no evidence for it
                for own, votes in zip(cosines, told):
                    near = np.lexsort((np.arange(len(own)), -own))[:neighbours]
                    near = near[own[near] > 1e-12]
                    raw.append(self._vote(near, votes[near]))
            self.steps, self.values = monotone_fit(np.array(raw), self.labels, self.weights)
            del self.index, self.vocabulary, vectors

    def prepare(self) -> Model:
        """Index and vocabulary, which do not travel."""
        lengths, terms, times = self.rows
        vectors = unit_vectors((np.repeat(np.arange(len(self.ids)), lengths), terms, times), len(self.ids), self.idf)
        self.index = Index(vectors, max(1, len(self.terms)))
        self.vocabulary = Vocabulary(self.terms)
        return self

    def on_worker(self) -> Model:
        """``prepare`` for a copy that only scores: without what index and vocabulary were made from."""
        self.prepare()
        del self.rows, self.terms
        return self

    def _vote(self, near: np.ndarray, told: np.ndarray) -> float:
        """Share of label 1 among the votes of the examples ``near``."""
        w = self.weights[near] * told
        return round(float(((w * self.labels[near]).sum() + 0.1 * self.base_rate) / (w.sum() + 0.1)), 9)

    def score(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, nearest examples, their cosines) of each text."""
        out = []
        vectors = unit_vectors(self.vocabulary.counts(texts), len(texts), self.idf)
        for near, cosines, told in self.index.nearest_of_each(vectors, self.k, self.telling):
            step = max(0, int(np.searchsorted(self.steps, self._vote(near, told), side="right")) - 1)
            out.append((float(min(1.0, max(0.0, self.values[step]))), near, cosines))
        return out


def stratum_shares(sizes: list[int], total: int, places: float) -> list[float]:
    """Share of each stratum to draw: half of the ``places`` in proportion to
    the ``total`` rows, half level, strata that are too small giving theirs to others."""
    if total <= places:
        return [1.0] * len(sizes)
    level, left = 0.0, places / 2
    for k, n in enumerate(sorted(sizes)):
        level = left / (len(sizes) - k)
        if n > level:
            break
        left -= n
    return [min(1.0, places / 2 / total + level / n) for n in sizes]


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, examples: int, strata: int) -> tuple:
    """(doc_id, y, share) of the sample, and the number of labelled rows of either label."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
             .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
             .groupBy("doc_id").agg(F.max("y").alias("y")))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(profile, part.column("text").to_pylist()), pa.string())],
                                                 names=["doc_id", "stratum"])

    kinds = docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).mapInArrow(
        profiles, T.StructType([docs.schema["doc_id"], T.StructField("stratum", T.StringType())]))
    known = stored(known.join(kinds, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("stratum").alias("stratum")))
    sizes = known.groupBy("y", "stratum").agg(F.count("*").alias("n"))
    total = {r.y: r.n for r in sizes.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    largest = sizes.orderBy(F.desc("n"), "y", "stratum").limit(2 * strata).collect()
    shares, plain = [], []
    for y in (0, 1):
        own, n = [r for r in largest if r.y == y], total.get(y, 0)
        shares += [(y, r.stratum, s) for r, s in zip(own, stratum_shares([r.n for r in own], n, examples / 2))]
        plain.append(min(1.0, examples / 2 / max(1, n)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = (known.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "y int, stratum string, share double")),
                        ["y", "stratum"], "left")
             .withColumn("share", F.coalesce("share", F.when(F.col("y") == 1, plain[1]).otherwise(plain[0])))
             .where(place < F.col("share") * (1 << 30)).select("doc_id", "y", "share"))
    return drawn, total.get(0, 0), total.get(1, 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        examples: int = 4000, neighbours: int = 80, min_examples: int = 2, strata: int = 1000,
        copy_cosine: float = 0.95) -> Model:
    """Model from the labelled rows whose crc32(id as text) leaves no 2 by 4.

    About ``examples`` documents are drawn, half of either label as far as
    there are, by a hash of the id. Half of a label's places go to its strata
    (the ``strata`` largest, by ``profile`` of the text) in proportion, half
    evenly, so the wording of a rare kind of text is present; votes weigh by
    the inverse share. Rows without a label, null ids and labels other than 0
    and 1 teach nothing; an id with both labels counts as 1; equal texts of one
    label are one example with the sum of their weights."""
    own = id_and_text(docs, id_col, text_col)
    chosen, n0, n1 = _drawn(own, labels, id_col, label_col, examples, strata)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                count: Counter = Counter()
                for word, n in Counter(words_of(text)).items():
                    for t in terms_of(word):
                        count[as_term(t)] += n
                found.append(list(count.items()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "y", "share", "digest")),
                 pa.array(found, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "y", "share", "digest", "terms"])

    # about ``examples`` rows of an id, a label and a share
    drawn = own.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.sha2("text", 256))
    drawn = stored(drawn.select("doc_id", "y", "share", "digest", "text").mapInArrow(terms, T.StructType([
        own.schema["doc_id"], *T.StructType.fromDDL("y int, share double, digest string, terms map<string, bigint>").fields])))
    kept = (drawn.groupBy("digest", "y").agg(F.min("doc_id").alias("doc_id"), F.sum(1 / F.col("share")).alias("weight"))
            .toArrow().sort_by([("doc_id", "ascending"), ("digest", "ascending"), ("y", "ascending")]))
    single = drawn.select("digest", "y", "terms").dropDuplicates(["digest", "y"])
    names = (single.select(F.explode(F.map_keys("terms")).alias("term")).groupBy("term").count()
             .where(F.col("count") >= min_examples).select("term").toArrow()["term"])
    names = sorted(names.to_pylist())
    # bounded by the examples
    shared, version = docs.sparkSession.sparkContext.broadcast(pickle.dumps(names)), uuid.uuid4().hex

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(pickle.loads(shared.value))}
        for batch in batches:
            own = [sorted((number[t], n) for t, n in row if t in number) for row in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("y"),
                 *(pa.array([[x[k] for x in row] for row in own], pa.list_(pa.int32())) for k in (0, 1))],
                names=["digest", "y", "term", "times"])

    held = single.mapInArrow(numbered, "digest string, y int, term array<int>, times array<int>").toArrow()
    row = {k: i for i, k in enumerate(zip(held["digest"].to_pylist(), held["y"].to_pylist()))}
    held = held.take(pa.array([row[k] for k in zip(kept["digest"].to_pylist(), kept["y"].to_pylist())], pa.int64())).combine_chunks()
    term, times = (held[c].combine_chunks().flatten().to_numpy() if held.num_rows else np.zeros(0, np.int32) for c in ("term", "times"))
    at = np.repeat(np.arange(held.num_rows, dtype=np.int32), [len(x) for x in held["term"]])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = latest_per_worker("toxic words", version, lambda: Vocabulary(pickle.loads(shared.value)))
        df = np.zeros(vocabulary.size + 1, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", STEP_BYTES):
                texts = part.column("text").to_pylist()
                for at in range(0, len(texts), TEXTS):
                    df[:-1] += np.bincount(vocabulary.counts(texts[at:at + TEXTS])[1], minlength=vocabulary.size)[:vocabulary.size]
                df[-1] += len(texts)
        met = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(df[met])], names=["t", "df"])

    met = (own.select("text").mapInArrow(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))
           .toArrow())
    df = np.zeros(len(names) + 1)
    df[met["t"].to_numpy()] = met["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    model = Model(names, idf, kept["doc_id"].to_pylist(), kept["y"].to_numpy().astype(np.int64), kept["weight"].to_numpy(),
                  (at, term, times), n1 / max(1, n0 + n1), neighbours, copy_cosine)
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          evidence: int = 3, batch_bytes: int = 1 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with tox_score (0 to 1), tox_label (1 if
    tox_score >= threshold) and tox_evidence (the nearest examples: id, cosine,
    label). Null and empty texts have no term and get the calibrated score of
    examples without one. Input columns of these three names are replaced."""
    kind = docs.schema[id_col].dataType
    own = docs.drop("tox_score", "tox_label", "tox_evidence")
    fields = T.StructType([*own.schema.fields, T.StructField("tox_score", T.DoubleType()),
                           T.StructField("tox_label", T.IntegerType()),
                           T.StructField("tox_evidence", T.ArrayType(T.StructType([
                               T.StructField("id", kind), T.StructField("cosine", T.DoubleType()),
                               T.StructField("label", T.IntegerType())])))])
    # bounded by the examples and their terms; as bytes, since broadcasts are pickled by reference
    shared, version = docs.sparkSession.sparkContext.broadcast(
        zlib.compress(cloudpickle.dumps(model), 1)), model.version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = latest_per_worker("toxicity", version, lambda: pickle.loads(zlib.decompress(shared.value)).on_worker())
        for batch in batches:
            for part in byte_slices(batch, text_col, batch_bytes):
                scores, proof = [], []
                texts = [text or "" for text in part.column(text_col).to_pylist()]
                for at in range(0, len(texts), TEXTS):
                    for s, near, cosines in own.score(texts[at:at + TEXTS]):
                        scores.append(s)
                        proof.append([{"id": own.ids[i], "cosine": float(c), "label": int(own.labels[i])}
                                      for i, c in zip(near[:evidence].tolist(), cosines[:evidence].tolist())])
                value = np.array(scores)
                kinds = pa.struct([("id", part.column(id_col).type), ("cosine", pa.float64()), ("label", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32)),
                     pa.array(proof, pa.list_(kinds))], names=[*part.schema.names, "tox_score", "tox_label", "tox_evidence"])
        give_back()

    return own.mapInArrow(run, fields)
