"""The pipeline's filters on odd rows, against plain Python without the operators."""

import collections
import hashlib
import math
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken.load
import xxhash

CLASH = ["kept", "keep_id", "tox_score", "tox_label", "component_id", "fingerprint", "item_id", "own_row", "_norm", "h", "start"]
rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
ITEM = rng.choices(WORDS, k=16)


def text(n=60):
    return " ".join(rng.choices(WORDS, k=n))


def leaky():
    part = ITEM[2:15]
    part[3], part[9] = "one", "two"
    return " ".join([text(30), *part, text(30)])


BASE = text(900)
LONG = text(60_000)
ROWS = [(5, BASE), (3, BASE.replace(" ", "  \n")), (9, BASE + " tail"), (None, BASE + " other"), (7, text()), (7, text()),
        (8, leaky()), (8, text()), (None, leaky()), (None, text()), (None, text()), (20, LONG), (21, LONG + " x"),
        (30, None), (31, ""), (32, " \t"), (30, None), (40, text(3)), (41, "A B C D"), (42, "a b c d"), (7, text()), (50, "x")]
ROWS += [ROWS[4], ROWS[10]]


def bits(a):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (a or "").encode().lower())
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def in_order(row):
    return (row[0] is None, row[0] or 0)


def one_of_each_text(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    return [min(g, key=in_order) for g in groups.values()]


def one_of_each_component(rows):
    fp, left, out = [bits(r[1]) for r in rows], set(range(len(rows))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            group.add(i)
            todo += [j for j in left - group if (fp[i] ^ fp[j]).bit_count() <= 2]
        left -= group
        out.append(min((rows[i] for i in group), key=in_order))
    return out


def clean(rows):
    def leaks(t):
        words = [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
        return any(sum(0 <= s + j < len(words) and words[s + j] == ITEM[j] for j in range(at, at + 13)) >= math.ceil(10.4)
                   for at in range(len(ITEM) - 12) for s in range(-at, len(words)))
    return [r for r in rows if not leaks(r[1])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame([(*r, *[f"{c} {i}" for c in CLASH]) for i, r in enumerate(ROWS)],
                          "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)
                          ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def key(id, t):
    return id, hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("stage, plain", [("exact_dedup", one_of_each_text), ("simhash_near_dedup", one_of_each_component),
                                          ("decontamination", clean)])
def test_a_stage_decides_by_row(spark, tables, stage, plain):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    apply = dict(corpus_pipeline.STAGES)[stage]
    got = apply(spark, docs, tables)
    assert got.columns == docs.columns
    rows = got.collect()
    want = plain(ROWS)
    assert 0 < len(want) < len(ROWS)
    if stage == "exact_dedup":  # of one text and id any spelling of the blanks may stay
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in want)
    elif stage == "decontamination":
        assert collections.Counter(key(r.doc_id, r.text) for r in rows) == collections.Counter(key(*r) for r in want)
    else:  # equal ids: any of the component's rows
        assert collections.Counter((r.doc_id, bits(r.text)) for r in rows) == collections.Counter((i, bits(t)) for i, t in want)
    for r in rows:  # the caller's columns are untouched and belong to the row
        i = int(r.kept.split()[1])
        assert ROWS[i] == (r.doc_id, r.text) and all(r[c] == f"{c} {i}" for c in CLASH)
    assert apply(spark, docs.limit(0), tables).collect() == []


def test_run_on_odd_rows(spark, tables):
    want = clean(one_of_each_component(one_of_each_text(ROWS)))
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, tables).collect()
    assert len(got) == len(want) and all(r.lossless for r in got)
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): len(bpe.encode_ordinary(t or "")) for _, t in ROWS}
    assert all(sha[r.decoded_sha256] == r.n_tokens for r in got)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in want)
