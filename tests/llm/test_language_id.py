"""Language identification: vectors by definition, memory, rare languages, odd rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from addrgrid.llm import language_id
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables():
    return language_id.letter_vectors(), language_id._letter_classes()


def plain_vector(text, letters, classes):
    """Every trigram's letters bound one by one, added up."""
    words = "".join(c if classes[ord(c)] else " " for c in text.lower()).split()
    out = np.zeros(letters.shape[1])
    padded = [0, *[x for w in words for x in (*[int(classes[ord(c)]) for c in w], 0)]]
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        out += letters[a].astype(int) * np.roll(letters[b].astype(int), 1) * np.roll(letters[c].astype(int), 2)
    return out


def test_vectors_by_definition_for_any_cut(tables, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh éßжд.,\n ") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["", "123 !", "a", texts[0], "word " * 5000]
    want = np.array([plain_vector(t, *tables) for t in texts])
    for texts_at_once, grams_at_once in ((256, 4096), (7, 50)):
        monkeypatch.setattr(language_id, "TEXTS", texts_at_once)
        monkeypatch.setattr(language_id, "GRAMS", grams_at_once)
        got, known = language_id.text_vectors(texts, *tables)
        assert np.array_equal(got, want.astype(np.float32))
        assert known.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_many_short_texts_take_little_memory(tables):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=50)) for _ in range(10_000)]
    tracemalloc.start()
    language_id.text_vectors(texts, *tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_a_rare_language_is_learned_and_odd_rows_are_named(spark):
    rng = random.Random(7)
    words = {"aa": ["salo", "tama", "karo", "mita", "pola"], "zz": ["xqu", "vrek", "zwik", "qyx", "wuzk"]}
    rows = [(i, " ".join(rng.choices(words["zz" if i % 300 == 7 else "aa"], k=20)), "zz" if i % 300 == 7 else "aa", i % 2)
            for i in range(6000)]
    rows += [(7000, None, "aa", 0), (7001, "", "zz", 0), (7002, "12 - 3", "aa", 1), (None, "salo tama karo", "aa", 0),
             (7003, "salo " * 40_000, None, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")  # a name of the result
    got = language_id.identify(docs, train_rows=100).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by_id = {r.doc_id: r for r in got}
    held = [(r[0], r[2]) for r in rows[:6000] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert any(lang == "zz" for _, lang in held) and all(by_id[i].lang_pred == lang for i, lang in held)
    assert [by_id[i].lang_pred for i in (7000, 7001, 7002, 7003, None)] == ["und", "und", "und", "aa", "aa"]
    assert by_id[7000].score == 0 and not by_id[None].held_out
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None)))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0)).collect() == []
