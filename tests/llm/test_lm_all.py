"""The recurrent model learns from every training document."""
import zlib

import numpy as np

from skychan.llm import common
from skychan.llm.gru_lm import END, EPOCHS, co_occurrence, modelled, trained, training_texts


def test_all_documents_are_learned_from(spark):
    common.ship(spark)
    rows = [(i, " ".join(["a", "b", f"w{i % 7}"][: i % 4])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    words = [END, "a", "b", *(f"w{i}" for i in range(7))]
    a = np.log1p([[t.count(w) for w in words] for t in train])
    texts = training_texts(docs, "doc_id", "text")
    together = co_occurrence(texts, words)
    assert np.allclose(together, a.T @ a, rtol=1e-4)
    model = modelled(words, together)
    assert len(train) > 800 and trained(model, texts) == EPOCHS * sum(len(t) + 1 for t in train)
    assert all(np.isfinite(v).all() for v in model.p.values()) and model.p["wc"].any()
