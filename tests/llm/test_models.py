import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from softseg.llm import langid, mixing, quality, queries


def targets(sizes, share=1.5, cap=2.0):
    """Source -> target, by sharing the excess again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s) + [n for n in sizes if n is None]
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, got, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        rest = total - sum(got.values())
        plan = {n: rest * w[n] / sum(w[m] for m in open_) for n in open_}
        over = [n for n in open_ if plan[n] >= cap * sizes[n]]
        if not over:
            return got | plan
        got |= {n: cap * sizes[n] for n in over}
        open_ = [n for n in open_ if n not in over]
    return got


def test_mix_of_documents(documents, texts):
    rows = mixing.mix(documents).collect()
    sizes, taken, want = {}, {}, {}
    for r in rows:
        assert r["size"] == len((texts[r["id"]] or "").encode().split()) and r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        want[r["source"]] = r["target"]
    assert len(rows) == len(texts) and want == pytest.approx(targets(sizes))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(20, 0.02 * want[s])
    again = {r["id"]: r["copies"] for r in mixing.mix(documents).collect()}
    assert again == {r["id"]: r["copies"] for r in rows}


def test_mix_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(n), f"s{i % 4 if i % 3 else 0}") for i, n in enumerate(rng.lognormal(4, 1, 4000))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    for r in mixing.mix(docs, block_rows=50).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") / (2 * F.col("size") + 1e-9)).alias("m")).collect():
        assert abs(r["t"] - r["g"]) < 0.02 * r["g"] and r["m"] <= 1


def test_mix_keeps_document_and_token_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.withColumns({"source": F.lit("large"), "doc_id": F.col("doc_id") + 10_000}))
    for block_rows in (mixing.BLOCK_ROWS, 40):
        per = mixing.mix(docs, block_rows=block_rows).groupBy("source").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"))
        for r in per.collect():
            expected = r["n"] * r["target"] / r["size"]
            # One document may weigh as much as a dozen others; tokens come first.
            assert abs(r["copies"] - expected) < (15 if r["n"] < 100 else 5)
            assert abs(r["taken"] - r["target"]) <= max(0.002 * r["target"], 2)


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(0, 900, 500).astype(float)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-4
    picked = np.mean([mixing.flight(np.full(9, 0.3), np.arange(9.0), np.random.default_rng(s)) for s in range(600)], axis=0)
    assert np.abs(picked - 0.3).max() < 0.1


def test_landing_keeps_chances():
    got = np.mean([mixing.landing(np.array([0.3, 0.6, 1.0]), np.array([10.0, 4.0, 1.0]), np.random.default_rng(s)) for s in range(2000)], axis=0)
    assert np.abs(got - [0.3, 0.6, 1.0]).max() < 0.05


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).collect() == []
    assert {r["size"] for r in rows if r["id"] in (1, 2, 3)} == {0}
    out = mixing.take_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows) and {r["_nth"] for r in out.collect()} <= {"own _nth"}


def test_language_of_held_out_texts(spark, sf, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = queries.op2_language(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_bundle_is_the_sum_of_bound_letters():
    encoder = langid.Encoder(64)
    doc, codes, base = encoder.ngrams(["Ab!", "ab  c"])
    got = encoder.bundle(doc, codes, base, 2)
    v = dict(zip(" abc", (encoder.letters[0], *(encoder.letters[encoder.of[ord(c)]] for c in "abc"))))
    bound = lambda t: np.roll(v[t[0]], 2) * np.roll(v[t[1]], 1) * v[t[2]]
    assert (got[0] == sum(bound(t).astype(int) for t in (" ab", "ab "))).all()
    assert (got[1] == sum(bound(t).astype(int) for t in (" ab", "ab ", "b c", " c "))).all()


def test_language_odd_rows(odd, none):
    learned = langid.prototypes(odd)
    rows = langid.identify(odd.select("doc_id", "text", "score"), learned).collect()
    assert len(rows) == odd.count() and langid.identify(none, learned).collect() == [] and langid.prototypes(none) == {}
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert {r["lang_pred"] for r in langid.identify(odd.select("doc_id", "text"), {}).collect()} == {"und"}


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality(spark, sf).collect() if r["doc_id"] in labels and r["held_out"]]
    good = [r["score"] for r in rows if labels[r["doc_id"]]]
    bad = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.85


def test_features_by_definition(monkeypatch):
    seen = np.zeros(quality.N_FEATURES, bool)
    text = "abcabcé xyz" * 40
    found = quality.features(text, seen)
    assert not seen.any()
    monkeypatch.setattr(quality, "PIECE", 7)
    assert (quality.features(text, seen) == found).all()
    assert len(quality.features(None, seen)) == len(quality.features("a", seen)) == 0
    raw = "abcabcé xyz".encode() * 40
    two = {(a << 8 | b) + (1 << 16) for a, b in zip(raw, raw[1:])}
    three = {(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:])}
    words = text.split()
    six = set()
    for i in range(len(words) - 5):
        gram, code = words[i : i + 6], 0
        for j, w in enumerate(gram):
            code = code * (j + 1) + gram.index(w)
        six.add(code + (1 << 17))
    assert set(found.tolist()) == two | three | six


def test_descent_reaches_the_optimum():
    """Primal and dual objective of the hinge loss meet, and no dual variable leaves its bounds."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.choice(40, 12) + 10 * (rng.random() < (0.7 if i % 3 else 0.3))) for i in range(120)]
    y = np.array([1 if i % 3 else -1 for i in range(120)])
    ratio = np.zeros(quality.N_FEATURES, np.float32)
    ratio[:60] = rng.normal(size=60)
    w, bias, alpha = quality.dual_coordinate_descent(rows, ratio, y, epochs=2_000)
    cost = np.where(y > 0, quality.COST * 120 / (2 * (y > 0).sum()), quality.COST * 120 / (2 * (y < 0).sum()))
    x = np.zeros((120, 60))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(ratio[r] @ ratio[r])
    assert (alpha >= 0).all() and (alpha <= cost + 1e-9).all() and (alpha >= cost - 1e-9).any()
    assert np.allclose(w[:60], (alpha * y) @ x, atol=1e-3) and abs(bias - alpha @ y) < 1e-6
    norm = w[:60] @ w[:60] + bias**2
    primal = norm / 2 + cost @ np.maximum(0, 1 - y * (x @ w[:60] + bias))
    dual = alpha.sum() - norm / 2
    assert primal - dual < 1e-2 * primal


def test_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.choice(60, 20) + (30 if i % 2 else 0)) for i in range(200)]
    y = np.array([1 if i % 2 else -1 for i in range(200)])
    model = quality.fit_model(rows, (y > 0).astype(int))
    assert np.mean([(model.score(r) > 0.5) == (v > 0) for r, v in zip(rows, y)]) > 0.97


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (5, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score(odd.select("doc_id", "text", "score"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() and {r["score"] for r in kept.collect()} == {"own score"}
    assert quality.keep_good(none, labels).collect() == [] and quality.keep_good(odd, labels.limit(0)).count() == odd.count()
