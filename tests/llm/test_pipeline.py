import re

from cases import edge_docs, empty_docs

import corpus_pipeline
from ebbflow.llm import decontaminate, quality
from ebbflow.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, table(spark, SF, "labels"))
    hasher = quality.Hasher()
    good = {i: r for i, r in rows.items() if model.score(hasher, r.text or "") >= 0.7}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table(spark, SF, "documents").columns
        docs = docs.cache()
        kept.append({r.doc_id: r for r in docs.collect()})
    assert kept[0] == good
    last = {}
    for i in good:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), good[i].text or "")
        last[text] = max(last.get(text, i), i)
    assert set(kept[1]) == set(last.values())
    assert set(kept[2]) <= set(kept[1]) and len(kept[2]) < len(kept[1])
    items = [t for r in table(spark, SF, "benchmark").collect() if (t := plain(r.text)).strip()]
    assert set(kept[3]) == {i for i, r in kept[2].items() if not any(t in plain(r.text) for t in items)}
    assert set(kept[4]) == set(kept[3]) and all(r.n_tokens == len(r.ids) for r in kept[4].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(kept[4])


def plain(text):
    return f" {' '.join(w for w in (decontaminate.EDGES.sub('', x).lower() for x in (text or '').split()) if w)} "


def test_edge_cases(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()
