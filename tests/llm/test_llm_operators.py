"""Operators of the training-data package against brute force, with nulls,
empty, very long and repeated rows, ties, empty tables and clashing names."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from addrgrid.llm import (byte_bpe, content_sort, decontaminate, language_id, queries, secret_scan, simhash, token_count,
                          token_files, toxicity, url_filter)
from addrgrid.session import ensure_checkpoint_dir

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "It's  a\ttest,\r\nof  spaces. ", "x" * 5000, "word " * 4000, "naïve café ß 漢字 🙂%%% a,b",
         "<|endoftext|> in, text", "same text here and there again", "same  text here\nand there again",
         "same text here and there again", "12 monkeys' 3.14 don't we'll\x1c \x85 end"]
SCHEMA = "doc_id long, text string, lang string, n_tokens string, keep_id string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", "y", "z") for i, t in enumerate(TEXTS)] + [(3, "a", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key]))


def test_token_counts_are_the_librarys(docs, none):
    tk = Tokenizer.from_file(JSON)
    want = sorted((i, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False)))
                  for i, t in [*enumerate(TEXTS), (3, "a")])
    got = token_count.count_tokens(docs, JSON)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())
    assert token_count.count_tokens(none, JSON).collect() == []


def test_pieces_of_random_texts_add_up():
    tk, rng = Tokenizer.from_file(JSON), np.random.default_rng(3)
    parts = ["the", " ", "  ", "\n", "é", "%%%", ".", ",", "'s", "12", "<|endoftext|>", "x y", "\t", "word", "|"]
    texts = ["".join(rng.choice(parts, 40)) for _ in range(300)]
    table = token_count.PieceTable(JSON, list, lambda v: list(itertools.chain(*v)), max_pieces=50)
    got = [ids for k in range(0, 300, 20) for ids in table.batch(texts[k:k + 20])]
    assert got == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_go_to_the_library_together():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    tk, rng = Tokenizer.from_file(JSON), np.random.default_rng(5)
    parts = ["th", "ing", "\u00e9", "\u00df", "Wh", "12", "\u6f22", ".\n", "\u0120", "%", "'s", "\u00a0", "<|endoftext|>", "\u3000"]
    words = sorted({"".join(rng.choice(parts, rng.integers(1, 9), p=[.2, .2, .1, .1, .1, *[.3 / 9] * 9])) for _ in range(3000)})
    table = token_count.PieceTable(JSON, list, lambda v: list(itertools.chain(*v)))
    table.tokenizer = Counting(table.tokenizer)
    texts = [" ".join(words), "  ".join(words[:50]) + " \n ", " "]
    assert table.batch(texts) == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert table.tokenizer.texts < len(words) / 4


def test_byte_bpe_round_trip(docs, none):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.defaultdict(list)
    for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        for r in got[i]:
            assert r.n_tokens == len(ids) and r.lossless
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {(r.doc_id, bytes(r.raw)) for r in back.collect()} == {(i, (t or "").encode()) for i, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).collect() == []
    small = byte_bpe.RankFile(RANKS, P.PATTERN, max_chars=7)
    assert all(small.ids(t) == enc.encode_ordinary(t) for t in TEXTS if t)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sorted(fps.items()), 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_components(spark, docs, none):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    assert simhash.near_duplicates(none).collect() == []
    for share in (0.1, 1.0):  # some and no fingerprints count as hot
        split = simhash.near_duplicates(docs, hot_share=share).collect()
        assert sorted(split) == sorted(got)


@pytest.mark.parametrize("sizes", [(1024, 4096), (16, 8)])
def test_simhash_links_with_split_nodes(spark, sizes):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)}
    for x in list(fps)[:20]:
        for _ in range(4):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.links(table, len(fps), 2, *sizes).collect():
        x, y = find(r.a % 2**64), find(r.b % 2**64)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == brute_components({f: f for f in fps})


def test_url_rules_and_verdicts(spark):
    urls = ["http://a.example.com/en/1", "http://www.example.com/en/2?x=1", "https://example.com/fr/3", None, "no host",
            "http://net/es/9", "http://NET/fr/", "http://b.net/en/#x", "http://notexample.com/en/", "http://xcom/a",
            "http://example.com?en/", "http://c.org/en/5", "http://c.org/en/5"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES, trees=2).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(w, v) for w, v in queries.URL_RULES for h, p in [w.split("/", 1)]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda x: len(x[0]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert got[i].verdict == best[1] if best else got[i].verdict in ("allow", "block")
    assert got[11].verdict == got[12].verdict
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).collect() == []


def test_language_id_held_out(spark, none):
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: (r.lang, r.text) for r in d.collect()}
    got = language_id.identify(d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(truth[r.doc_id][0] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 %%", "en"), (3, "the the", None)],
                                "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(odd).collect() if r.doc_id < 3} == {"und"}
    assert language_id.identify(none).collect() == []


def test_token_files(spark, docs, none):
    tk, at = Tokenizer.from_file(JSON), 0
    path = f"{ensure_checkpoint_dir(spark)}/test-token-files"
    own = docs.where("lang is not null")
    token_files.write(own, path, JSON, end_id=2, segment_tokens=64)
    got = rows_of(token_files.read(spark, path))
    assert len(got) == len(TEXTS)
    for r, t in zip(got, TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_files.write(none, path + "-none", JSON, end_id=2)
    assert token_files.read(spark, path + "-none").collect() == []


def test_coder_round_trip_and_checksum():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (1000, 3), (5000, 50000), (3000, 1)):
        ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
        segment = token_files.encode_segment(ids, block=700, lanes=64)
        assert (token_files.decode_segment(segment) == ids).all()
    segment["blocks"][0]["crc"] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_segment(segment)


def test_decontamination(spark, none):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [[word() for _ in range(n)] for n in (30, 15, 6, 3, 0)]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(9, None, "x"), (0, " ".join(items[0]), "x")],
                                  "item_id long, text string, doc_id string")
    noise = lambda n: [word() for _ in range(n)]
    changed = [w if k % 7 else "zzz" for k, w in enumerate(items[0])]
    texts = {1: noise(50) + items[0] + noise(9), 2: noise(5) + changed, 3: noise(200), 4: items[1],
             5: noise(3) + items[2] + noise(3), 6: items[2][:5] + ["q"] + noise(8), 7: items[3],
             8: [w.upper() + "," for w in items[1]], 9: items[0][:8] + noise(30)}
    docs = spark.createDataFrame([(i, " ".join(w), "c") for i, w in texts.items()] + [(10, None, "c"), (11, "", "c"), (4, " ".join(items[1]), "c")],
                                 "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (5, 2), (8, 1)}
    assert got[1, 0].start == 50 and got[1, 0].n_same == 13 and got[4, 1].n_item == 15
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench, block_seeds=20).collect()}
    assert blocks == set(got)
    assert decontaminate.find_overlaps(none, bench).collect() == []
    assert decontaminate.find_overlaps(docs, bench.limit(0)).collect() == []


def test_secret_spans(spark, none):
    texts = ["Password: 'hunter22' token=abc", "secret: token: abcdefgh", "AKIA" + "A1" * 8 + " AKIAshort", "f" * 24 + " " + "a" * 23,
             "pwd => xK9!vQ2#mZ7$ and pwd: password1", None, "", "api_key = \"0123456789abcdef01234567\""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs).collect()}
    assert got[0] == [("assign", 0, 19)] and got[1] == [] and got[2] == [("access", 0, 20)] and got[3] == [("hex", 0, 24)]
    assert got[4] == [("guess", 7, 19)] and got[5] == got[6] == []
    assert [k for k, _, _ in got[7]] == ["assign", "hex"]
    price = secret_scan.GuessCost()
    assert price("password")[0] < 2 < price("qwertyuiop")[0] < price("xK9!vQ2#")[0]
    assert price("admin1999")[1] == [("word", 0, 5), ("date", 5, 9)]
    assert secret_scan.scan(none).collect() == []


@pytest.mark.parametrize("hot", [3, 10_000])
def test_content_sort(spark, docs, none, hot):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(i if i % 9 else None, ["q  r\n", "q r ", None, "", f"t{i % 4}"][i % 5]) for i in range(90)] + [(1, "q r "), (1, "q r ")]
    table = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept string")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = content_sort.exact_dedup(table, hot_rows=hot, salts=4).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[norm(r.text)]
        assert (r.keep_id, r.group_size) == (min(i for i in ids if i is not None), len(ids))
        assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    assert collections.Counter(norm(r.text) for r in got if r.kept) == {t: 1 for t in groups}
    assert content_sort.exact_dedup(none).collect() == []


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(6)
    vectors = [toxicity.unit_vector({int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(0, 8), replace=False)},
                                    np.linspace(1, 3, 40)) for _ in range(500)]
    dense = np.zeros((500, 40))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = toxicity.Index(vectors, 40)
    for k in range(0, 500, 17):
        cosines = dense @ dense[k]
        order = [i for i in np.lexsort((np.arange(500), -np.round(cosines, 12))) if cosines[i] > 1e-12][:7]
        near, found = index.nearest(*vectors[k], 7)
        assert near.tolist() == order and np.allclose(found, cosines[order])


def test_toxicity_terms_of_many_texts_at_once(monkeypatch):
    texts = ["Vile words, VILE Wordsmith\u2019s \u00c9tude \u00e9tude", "", "abcdefghijklmnop abcdefghijklmnopq abcdefghijklmnopq",
             "\u041f\u0440\u0438\u0432\u0435\u0442 vile \u041f\u0440\u0438\u0432\u0435\u0442 wordsmith", "vil vile\0vile vilest", " 12 -- "]

    def plain(text):
        return collections.Counter(toxicity.as_term(t) for w in toxicity.words_of(text) for t in toxicity.terms_of(w))

    terms = sorted(set().union(*map(plain, texts)) - {"vilest", "vil"})
    vocabulary = toxicity.Vocabulary(terms)
    many = [*texts, *(" ".join(rng.choice(terms, 40)) for rng in map(np.random.default_rng, range(60))), " ".join(texts) * 20]
    for step in (toxicity.STEP_BYTES, 7):  # a text can be looked up in steps
        monkeypatch.setattr(toxicity, "STEP_BYTES", step)
        found = vocabulary.counts(many)
        want = [(k, terms.index(t), n) for k, text in enumerate(many) for t, n in plain(text).items() if t in terms]
        assert list(zip(*(x.tolist() for x in found))) == sorted(want)
    vocabulary = toxicity.Vocabulary(terms)
    vocabulary.counts(texts[:3])
    assert not vocabulary.words  # no word of a Latin-1 text is looked up alone


def test_votes_count_what_the_neighbours_share():
    rng = np.random.default_rng(9)
    idf, telling = np.linspace(1, 3, 60), rng.random(60) + 1
    vectors = [toxicity.unit_vector({int(t): int(rng.integers(1, 4)) for t in rng.choice(60, rng.integers(0, 9), replace=False)},
                                    idf) for _ in range(700)]
    dense = np.zeros((700, 60))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = toxicity.Index(vectors, 60, common=20, block=64)
    for k, (near, cosines, told) in enumerate(index.nearest_of_each(vectors[:90], 11, telling)):
        assert np.array_equal(near, index.nearest(*vectors[k], 11)[0]) and np.allclose(cosines, dense[near] @ dense[k])
        assert np.allclose(told, dense[near] @ (dense[k] * telling))


def test_toxicity_held_out(spark, none):
    d = "/root/testdata/sf0.1"
    docs = queries.table(spark, d, "documents")
    labels = {r.doc_id: r.toxic for r in queries.table(spark, d, "labels").collect()}
    got = [r for r in queries.op10_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in got)
    caught = sum(r.predicted for r in got if labels[r.doc_id] == 1)
    assert right / len(got) > 0.94 and caught / sum(labels[r.doc_id] for r in got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(none.select("doc_id", "text"), queries.table(spark, d, "labels"))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x")], "doc_id long, text string, tox_score string")
    assert {r.tox_score for r in toxicity.score(odd, empty).collect()} and toxicity.score(none, empty).collect() == []
    assert docs.count() == len(queries.op10_toxicity(spark, d).select("doc_id").collect())


def test_toxicity_uses_every_term_of_the_examples(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(60)]
    texts = {i: " ".join(rng.choice(words, 12)) + (" vile" if i % 5 == 0 else "") for i in range(200)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in texts], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    taught = {i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.ids) <= taught and set(model.terms) == {w for i in model.ids for w in texts[i].split()}
    held = [r for r in toxicity.score(d, model).collect() if r.doc_id not in taught]
    assert len(held) > 20
    assert all(r.tox_evidence[0].cosine > 0 for r in held)
