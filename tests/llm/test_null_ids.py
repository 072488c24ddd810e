"""Components whose rows all have a null doc_id stay apart."""
from test_llm import BASE, SCHEMA

from skychan.llm import common
from skychan.llm.voronoi_join import keep_one, linked


def test_unrelated_texts_under_null_ids(spark):
    common.ship(spark)
    texts = [" ".join(f"{w}{k}" for w in BASE) for k in range(4)]
    rows = [(None, t) for t in texts] + [(None, texts[0] + " end"), (None, texts[1]), (7, texts[2] + " end"), (8, texts[2]), (None, ""), (9, "alone here")]
    table = spark.createDataFrame([(i, t, "en", "a", 0, 0, "", "", 0, 0) for i, t in rows], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in keep_one(table).collect()]
    assert len(kept) == 6 and {(7, texts[2] + " end"), (9, "alone here"), (None, ""), (None, texts[1]), (None, texts[3])} <= set(kept)
    assert len({t for _, t in kept} & {texts[0], texts[0] + " end"}) == 1
    found = linked(table).filter("n_shingles > 0").collect()
    assert all(r._component is not None for r in found) and len({r._component for r in found}) == 5
