"""The pipeline's stages against plain Python."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
from addrgrid.llm import decontaminate, simhash, toxicity
from addrgrid.sources.tables import table

D = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, D, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, D, "labels"))
    left = {r.doc_id for r in toxicity.score(docs, model).where("tox_label = 0").collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    left = set(first.values())
    own = docs.where(docs.doc_id.isin(list(left)))
    left = {r.doc_id for r in simhash.near_duplicates(own).collect() if r.doc_id == r.component_id}
    own = docs.where(docs.doc_id.isin(list(left)))
    left -= {r.doc_id for r in decontaminate.find_overlaps(own, table(spark, D, "benchmark")).collect()}
    got = corpus_pipeline.run(spark, D).collect()
    assert collections.Counter(r.doc_id for r in got) == {i: 1 for i in left}
    assert all(r.lossless for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]


def test_toxic_wording_of_a_rare_language_goes(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = {lang: [a + "".join(rng.choice(list(abc), 4)) for a in abc for _ in range(20)]
             for lang, abc in (("en", "abcdefgh"), ("xx", "qrstuvwz"))}
    rows = []
    for i in range(12_000):  # of 6,000 toxic documents 60 (1 %) are in the rare language
        lang, toxic = "xx" if i % 200 in (99, 150) else "en", i % 2
        bad = {"en": ["gnash", "hodge"], "xx": ["zzurk", "wwolt"]}[lang] if toxic else []
        rows.append((i, " ".join([*rng.choice(words[lang], 12), *bad]), lang, toxic))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").createOrReplaceTempView("rare_toxic")
    spark.sql("select doc_id, text, lang from rare_toxic").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select doc_id, toxic from rare_toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    held = [(i, lang, toxic) for i, _, lang, toxic in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    for lang in ("en", "xx"):
        own = [(i in left, toxic) for i, at, toxic in held if at == lang]
        assert len(own) > 20 and sum(stays != (toxic == 1) for stays, toxic in own) / len(own) > 0.9
