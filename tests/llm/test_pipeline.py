from collections import Counter

import corpus_pipeline
from softseg.llm import exact_dedup, mixing, packing, quality, simhash

from .test_dedup import low
from .test_similar import brute_components


def stages(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_stages_on_documents(spark, sf, documents):
    _, good, once, apart, mixed, packed = stages(spark, documents, sf)
    assert all(d.columns == documents.columns for d in (good, once, apart, mixed))
    rows = lambda d: [tuple(r) for r in d.collect()]
    assert set(rows(good)) <= set(rows(documents)) and good.count() > 0.7 * documents.count()
    best = {}
    for r in good.collect():
        k = low(r["text"])
        best[k] = max(best.get(k, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(best.values())
    near = brute_components({r["doc_id"]: r["text"] for r in once.collect()})
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(set(near.values()))
    want = {r["id"]: r["copies"] for r in mixing.mix(apart).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in want.items() if n})
    assert Counter(r["doc_id"] for r in packed.filter("start = 0").collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_stages_on_odd_rows(spark, sf, odd, none):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd, none):
        *kept, packed = stages(spark, docs, sf)
        assert all(d.columns == docs.columns for d in kept)
        assert packed.filter("start = 0").count() == kept[-1].count()


def test_run_returns_pieces(spark, sf):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    assert all((exact_dedup, packing, quality, simhash))
