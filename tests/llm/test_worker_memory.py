"""What a Python worker keeps between the stages of the pipeline."""

import gc
import pickle
import sys
import tracemalloc
import weakref

from addrgrid.llm import arrow_text, toxicity
from pyspark import cloudpickle


class Large:
    pass


def test_a_worker_holds_one_large_object_at_a_time(monkeypatch):
    monkeypatch.delitem(sys.modules, "_addrgrid_worker", raising=False)
    words = weakref.ref(arrow_text.latest_per_worker("words", "1", Large))
    assert arrow_text.latest_per_worker("words", "1", Large) is words()
    model = weakref.ref(arrow_text.latest_per_worker("model", "1", Large))
    gc.collect()
    assert words() is None and arrow_text.latest_per_worker("model", "1", Large) is model()
    kept = arrow_text.per_worker(("small",), Large)
    arrow_text.let_go()
    gc.collect()
    assert model() is None and arrow_text.per_worker(("small",), Large) is kept
    arrow_text.let_go()
    monkeypatch.delitem(sys.modules, "_addrgrid_worker", raising=False)


def test_terms_are_kept_as_integers():
    terms = [f"word{k}" for k in range(50_000)]
    tracemalloc.start()
    vocabulary = toxicity.Vocabulary(terms)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert vocabulary.size == len(terms) and held < 4e6


def test_a_copy_that_only_scores_gives_the_same(spark):
    texts = [(i, f"{'vile' if i % 3 == 0 else 'fine'} words of kind k{'abcdefgh'[i % 8]} При{'ве' * (i % 4)} unwordenunwordenunworden")
             for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int"))
    travelled = cloudpickle.dumps(model)
    own, whole = pickle.loads(travelled).on_worker(), pickle.loads(travelled).prepare()
    found, wanted = ([(s, near.tolist(), cosines.tolist()) for s, near, cosines in m.score([t for _, t in texts] + ["", "vile"])]
                     for m in (own, whole))
    assert found == wanted and len({s for s, _, _ in found}) > 1
    assert not hasattr(own, "rows") and not hasattr(own, "terms") and model.rows and model.terms
