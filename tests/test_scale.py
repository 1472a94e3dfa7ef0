"""Clustering and order statistics beyond what one task holds: against plain definitions."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from softseg.operators import blocks, clustering, counts, heuristics, indicators, many, quantiles, reduce, validity, ward


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("x"))
    return rows.repartition(3).cache()


def arrays(rows):
    got = sorted(rows.collect(), key=lambda r: r["id"])
    return np.array([r["x"] for r in got], float), got


def brute_ward(x):
    """(heights, partitions) by the cheapest join of all, again and again."""
    live = {i: (v, 1.0) for i, v in enumerate(x)}
    members, heights, parts = {i: [i] for i in live}, [], []
    while len(live) > 1:
        ids = sorted(live)
        v, n = np.array([live[i][0] for i in ids]), np.array([live[i][1] for i in ids])
        cost = ((v[:, None] - v[None]) ** 2).sum(2) * (n[:, None] * n / (n[:, None] + n))
        np.fill_diagonal(cost, np.inf)
        i, j = divmod(int(cost.argmin()), len(ids))
        a, b = ids[i], ids[j]
        heights.append(np.sqrt(2 * cost[i, j]))
        total = live[a][1] + live[b][1]
        live[a] = ((live[a][0] * live[a][1] + live[b][0] * live[b][1]) / total, total)
        members[a] = members[a] + members[b]
        del live[b], members[b]
        parts.append(sorted(sorted(m) for m in members.values()))
    return heights, parts


@pytest.mark.parametrize("local", [1_024, 60])
def test_ward_tree_and_its_cuts(vectors, local):
    """From the first merge on the driver, and by rounds over the neighbour table."""
    x, _ = arrays(vectors)
    heights, parts = brute_ward(x)
    tree = ward.ward_tree(vectors, local)
    assert (tree.rounds > 0) == (local < len(x))
    assert sorted(r["height"] for r in tree.merges.collect()) == pytest.approx(sorted(heights))
    leaves, centers, within = tree.cut(range(2, 13))
    labelled = vectors.select("id", "x").join(leaves, "x").collect()
    for k in range(2, 13):
        got = sorted(sorted(r["id"] for r in labelled if r[f"k{k}"] == j) for j in range(k))
        want = parts[len(x) - 1 - k]
        assert got == want and within[k] == pytest.approx(sum(((x[p] - x[p].mean(0)) ** 2).sum() for p in want))
        assert sorted(map(tuple, centers[k].round(6))) == sorted(map(tuple, np.array([x[p].mean(0) for p in want]).round(6)))


def test_ward_of_repeated_and_few_rows(spark):
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0, 0, 10, 10, 25])], "id int, x array<double>")
    tree = ward.ward_tree(rows, 2)
    assert sorted(r["height"] for r in tree.merges.collect()) == pytest.approx([np.sqrt(2 * 6 / 5) * 10, np.sqrt(2 * 5 / 6) * 21])
    model = clustering.ward(rows, 2)
    frame = model.assign(rows.unionByName(spark.createDataFrame([(9, [24.0])], rows.schema)))
    assert {r["id"]: r["label"] for r in frame.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 9: 1}
    one = clustering.ward(rows.limit(2), 3)
    assert one.k == 1 and one.objective == 0.0


def test_many_runs_equal_single_runs(vectors):
    x, _ = arrays(vectors)
    starts = [x[:3], x[5:9], x[20:22]]
    for found, start in zip(many.fcm_runs(vectors, starts, max_iter=25), starts):
        v, last = start, None
        for step in range(25):
            d2 = np.maximum(((x[:, None] - v[None]) ** 2).sum(2), 1e-12)
            u = (1 / d2) / (1 / d2).sum(1, keepdims=True)
            cost = ((u**2) * d2).sum()
            if last is not None and abs(last - cost) < 1e-5:
                break
            last, v = cost, (u**2).T @ x / (u**2).sum(0)[:, None]
        assert found.iterations == min(step + 1, 25) and found.objective == pytest.approx(cost, rel=1e-6) and np.allclose(found.centers, v, atol=1e-6)
    for found, start in zip(many.lloyd_runs(vectors, starts), starts):
        alone = clustering.lloyd(vectors, start)
        assert found.iterations == alone.iterations and np.allclose(found.centers, alone.centers)


def test_random_starts_do_not_depend_on_partitions(vectors):
    plan = [(3, 1), (2, 7), (3, 2)]
    for starts in (many.random_starts, many.plus_plus_starts):
        a, b = starts(vectors, plan), starts(vectors.repartition(5), plan)
        assert all(np.allclose(p, q) for p, q in zip(a, b)) and [len(p) for p in a] == [3, 2, 3]
        assert np.allclose(a[1], starts(vectors, [(2, 7)])[0]) and not np.allclose(a[0], a[2])


def test_thirty_restarts_read_the_rows_once_a_step(spark, vectors):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("restarts", "")
    best, runs = clustering.with_restarts("fcm", vectors, 3, range(30))
    jobs = len(tracker.getJobIdsForGroup("restarts"))
    spark.sparkContext.setJobGroup("rest", "")
    assert len(runs) == 30 and best.objective == min(r.objective for r in runs)
    # A step is one job, or two where its plan is adapted between its stages; a few more draw the starts.
    assert jobs <= 2 * max(r.iterations for r in runs) + 8


def test_validity_table_equals_single_indices(vectors):
    x, _ = arrays(vectors)
    models = [clustering.Clusters("fcm", x[:k], 0.0, 0, True) for k in (2, 3, 5)]
    for model, row in zip(models, many.validity_table(vectors, models)):
        frame = model.assign(vectors)
        assert row["partition_coefficient"] == pytest.approx(validity.partition_coefficient(frame).first()[0])
        assert tuple(validity.classification_entropy(frame).first()) == pytest.approx((row["classification_entropy"], row["normalised_entropy"]))
        assert row["xie_beni"] == pytest.approx(validity.xie_beni(frame, model.centers).first()[0])
        assert row["davies_bouldin"] == pytest.approx(validity.davies_bouldin(frame)) and row["calinski_harabasz"] == pytest.approx(validity.calinski_harabasz(frame))


def brute_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_bytes", [32 << 20, 6 * 8 * 40])
def test_silhouettes_of_all_rows(vectors, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    x, got = arrays(vectors)
    want = brute_silhouettes(x, np.array([r["label"] for r in got]))
    found = {r["id"]: r["s"] for r in validity.silhouette_rows(vectors).collect()}
    assert [found[r["id"]] for r in got] == pytest.approx(list(want), abs=1e-6)
    part = {r["id"]: r["s"] for r in validity.silhouette_rows(vectors, vectors.filter("id % 7 = 0")).collect()}
    assert set(part) == {r["id"] for r in got if r["id"] % 7 == 0} and all(part[i] == pytest.approx(found[i], abs=1e-6) for i in part)


def test_silhouettes_of_more_rows_than_a_sample(spark):
    """6,000 rows, each of which counts; two of three labels lie far apart, and one row is alone."""
    rows = spark.range(6_000).select("id", F.array((F.col("id") % 2 * 100.0 + F.col("id") / 6_000).alias("v")).alias("x"), F.when(F.col("id") == 5_999, 2).otherwise(F.col("id") % 2).cast("int").alias("label"))
    got = validity.silhouette_rows(rows)
    assert got.count() == 6_000 and got.filter("label = 2").first()["s"] == 0.0
    assert got.filter("label = 0").agg(F.min("s")).first()[0] > 0.99
    assert validity.crisp_silhouette(rows.filter("label = 0")) != validity.crisp_silhouette(rows.filter("label = 0"))  # one label: NaN


def test_silhouettes_of_several_models_share_their_distances(vectors, monkeypatch):
    x, _ = arrays(vectors)
    models = [clustering.Clusters("fcm", x[:k], 0.0, 0, True) for k in (2, 5, 3)] + [clustering.Clusters("kmeans", np.stack([x.mean(0), x.mean(0) + 1e6]), 0.0, 0, True)]
    passes, whole = [], validity.distance_totals
    monkeypatch.setattr(validity, "distance_totals", lambda *a: passes.append(1) or whole(*a))
    for asked in (None, vectors.filter("id % 7 = 0")):
        got, n = validity.model_silhouettes(vectors, models, asked), len(passes)
        want = [validity.crisp_silhouette(m.assign(vectors), None if asked is None else m.assign(asked)) for m in models]
        assert got == pytest.approx(want, nan_ok=True) and np.isnan(got[3])
        assert n == 1
        passes.clear()


def test_runs_of_gk_possibilistic_and_k_means_equal_single_runs(spark, vectors):
    tracker = spark.sparkContext.statusTracker()
    for method, options in (("gk", {"max_iter": 20}), ("pfcm", {"max_iter": 20}), ("kmeans", {"n_init": 3})):
        spark.sparkContext.setJobGroup(method, "")
        best, runs = clustering.with_restarts(method, vectors, 3, [1, 2], **options)
        jobs = len(tracker.getJobIdsForGroup(method))
        spark.sparkContext.setJobGroup("rest", "")
        for run, seed in zip(runs, (1, 2)):
            one = clustering.run_method(method, vectors, 3, seed, **options)
            assert np.allclose(run.centers, one.centers, atol=1e-6) and run.iterations == one.iterations and run.objective == pytest.approx(one.objective)
        # Fuzzy starts take up to 50 steps; a step is one job, or two where its plan is adapted.
        assert jobs <= 2 * (max(r.iterations for r in runs) + 1 + (50 if method != "kmeans" else 3)) + 14


def test_pairwise_fuzzy_silhouette(vectors):
    x, got = arrays(vectors)
    model = clustering.Clusters("fcm", x[:3], 0.0, 0, True)
    u = model.degrees(x)
    d, w = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.clip(u, 1e-12, 1) ** 2
    mean, own = d @ w / w.sum(0), u.argmax(1)
    a = mean[np.arange(len(x)), own]
    b = np.where(np.arange(3) == own[:, None], np.inf, mean).min(1)
    found = {r["id"]: r["s"] for r in validity.pairwise_fuzzy_silhouette(model.assign(vectors)).collect()}
    assert [found[r["id"]] for r in got] == pytest.approx(list((b - a) / np.maximum(a, b)), abs=1e-6)


def test_gustafson_kessel_takes_the_published_steps(vectors):
    """Degrees, then centres, covariances with their ridge and norms of volume one; the stop is on degrees."""
    x, _ = arrays(vectors)
    v, k, d = x[:3], 3, x.shape[1]
    u = clustering.memberships(((x[:, None] - v[None]) ** 2).sum(2), 2.0)
    last, steps = None, 0
    for steps in range(1, 41):
        w = u**2
        v = w.T @ x / w.sum(0)[:, None]
        d2 = np.empty((len(x), k))
        for j in range(k):
            diff = x - v[j]
            cov = (diff.T * w[:, j]) @ diff / w[:, j].sum()
            cov = cov + 1e-4 * np.trace(cov) / d * np.eye(d)
            d2[:, j] = ((diff @ (np.linalg.det(cov) ** (1 / d) * np.linalg.inv(cov))) * diff).sum(1)
        new = clustering.memberships(d2, 2.0)
        cost, change, u = (new**2 * d2).sum(), np.abs(new - u).max(), new
        if change < 1e-3 or last is not None and abs(last - cost) < 1e-3:
            break
        last = cost
    found = clustering.gustafson_kessel(vectors, 3, max_iter=40, tol=1e-3, centers=x[:3])
    assert found.iterations == steps and found.objective == pytest.approx(cost, rel=1e-5) and np.allclose(found.centers, v, atol=1e-4)


def test_rand_of_all_pairs_of_runs(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (200, 4))
    held = rng.random((200, 4)) < 0.8
    rows = [(i, [int(v) if h else None for v, h in zip(labels[i], held[i])]) for i in range(200)]
    got = {(r["a"], r["b"]): r["adjusted_rand"] for r in validity.pairwise_rand(spark.createDataFrame(rows, "id int, labels array<int>"), 4).collect()}
    for a, b in combinations(range(4), 2):
        both = [(int(labels[i, a]), int(labels[i, b])) for i in range(200) if held[i, a] and held[i, b]]
        assert got[a, b] == pytest.approx(validity.adjusted_rand(spark.createDataFrame(both, "p int, q int"), "p", "q").first()[0])


def test_stability_of_fuzzy_runs_and_of_trees(vectors):
    x, _ = arrays(vectors)
    runs = [clustering.Clusters("fcm", x[s : s + 3], 0.0, 0, True) for s in (0, 3, 9)]
    frames = [r.assign(vectors) for r in runs]
    found = validity.stability(vectors, runs)
    assert found["agreement"] == pytest.approx(np.mean([validity.membership_agreement(frames[a], frames[b]) for a, b in combinations(range(3), 2)]))
    trees = validity.subsample_stability(vectors, lambda r, s: clustering.ward(r, 2), 3)
    assert -0.5 <= trees["min_ari"] <= trees["mean_ari"] <= 1


def test_projected_centres_and_ellipses(vectors):
    x, _ = arrays(vectors)
    pca = reduce.fit_pca(vectors, 6, None, standardise=True, names=tuple("abcdef"))
    rows = reduce.center_features(pca, pca.project(x[:2]), 3)
    z = (x[0] - x.mean(0)) / x.std(0)
    top = [r for r in rows if r["cluster"] == 0 and r["ranking"] == "absolute"]
    assert [r["feature"] for r in top] == ["abcdef"[i] for i in np.argsort(-abs(z))[:3]] and top[0]["original"] == pytest.approx(x[0]["abcdef".index(top[0]["feature"])])
    assert all(r["standardised"] > 0 for r in rows if r["ranking"] == "positive") and all(r["standardised"] < 0 for r in rows if r["ranking"] == "negative")
    flat = reduce.Components(np.zeros(2), np.ones(2), np.eye(2), np.array([0.7, 0.3]))
    turn = np.radians(30)
    r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    found = reduce.covariance_ellipses(flat, np.array([[1.0, 2.0]]), (r @ np.diag([9.0, 4.0]) @ r.T)[None])[0]
    assert (found["x"], found["y"], found["width"], found["height"], found["angle"]) == pytest.approx((1, 2, 12, 8, 30))


CELLS = [
    ('{"a": 1, "b": null}', {"a": 1, "b": 0}), ('{"a": "3"}', {"a": 3}), ('{"a,b": 1}', {"a,b": 1}), ('{"a\\"b": 1}', {'a"b': 1}), ("{'a': 1, 'b': None}", {"a": 1, "b": 0}),
    ("{post-created:3,login:2}", {"post-created": 3, "login": 2}), ("{a.b: 1.5, c: x}", {"a.b": 1.5, "c": 0}), ('{"a": 1, "a": 2}', {"a": 2}), ("{a:1,a:2,a:5}", {"a": 5}), ("{'a\\'b': 1}", {"a'b": 1}),
    ('{"a:b": 1}', {"a:b": 1}), ('{"a": true, "b": [1]}', {"a": 1, "b": 0}), ("{}", {}), ("", {}), (None, {}), ("nan", {}), ("none", {}), ("[1, 2]", {}), ("{a 1}", {}), ("{a: 1", {}), ("{a: 1,}", {"a": 1}), ("{ 'x' : 1 }", {"x": 1}),
]


def test_count_cells(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "i int, cell string")
    got = {r["i"]: r["m"] for r in rows.select("i", counts.parse_counts(F.col("cell")).alias("m")).collect()}
    assert {CELLS[i][0]: m for i, m in got.items()} == {c: want for c, want in CELLS}
    many_names = "{" + ",".join(f"n{i % 20_000}: {i}" for i in range(30_000)) + "}"
    found = spark.createDataFrame([(many_names,)], "cell string").select(counts.parse_counts(F.col("cell")).alias("m")).first()["m"]
    assert len(found) == 20_000 and found["n5"] == 20_005 and found["n15000"] == 15_000


def test_as_of_lookup_with_all_rows_on_one_day(spark):
    """No range holds more than twice the mean, though all posts and queries lie on one day, a third of them in one moment."""
    day = datetime(2025, 3, 3)
    rng = np.random.default_rng(1)
    posts = [(i, day + timedelta(seconds=0 if i % 3 == 0 else int(rng.integers(1, 80_000)))) for i in range(3_000)]
    asks = [(i, day + timedelta(seconds=int(rng.integers(0, 80_000))), float(rng.random())) for i in range(300)]
    frame = counts.recent_post(spark.createDataFrame(asks, "id int, ts timestamp_ntz, pick double"), spark.createDataFrame(posts, "post_id int, created_at timestamp_ntz"), 7)
    ordered = sorted(posts, key=lambda p: (p[1], p[0]))
    want = {}
    for i, ts, pick in asks:
        seen = sum(p[1] < ts for p in posts)
        room = min(seen, 7)
        want[i] = (seen, ordered[seen - room + int(pick * room) if seen else 0][0])
    assert {r["id"]: (r["seen"], r["post_id"]) for r in frame.collect()} == want
    dealt = spark.createDataFrame(posts, "post_id int, created_at timestamp_ntz").repartitionByRange(8, "created_at", "post_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) <= 2 * 3_000 / 8


def test_quantiles_narrow_more_than_once(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=20_000), np.where(rng.random(20_000) < 0.5, 7.0, rng.random(20_000))
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(4)
    qs = (0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0)
    got = quantiles.exact_quantiles(rows, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None)}, qs, small_rows=50, accuracy=60)
    assert got["a"] == pytest.approx(list(np.quantile(a, qs))) and got["b"] == pytest.approx(list(np.quantile(b, qs))) and got["none"] == [None] * len(qs)
    table = {r["indicator"]: r for r in indicators.summary(rows, ["a", "b"]).collect()}
    assert table["a"]["p50"] == pytest.approx(np.median(a)) and table["b"]["p75"] == 7.0 and table["a"]["n"] == 20_000


def test_similar_posts_are_compared_by_kind(spark, monkeypatch):
    """Repeated posts and ids, zeros, a single kind: as all pairs give, from as many comparisons as there are kinds."""
    rng = np.random.default_rng(5)
    data = [(i % 290, int(rng.integers(0, 4)), int(rng.integers(0, 5)), int(rng.integers(0, 2))) for i in range(300)] + [(1000, 9, 1, 1), (1001, 0, 0, 0)]
    posts = spark.createDataFrame(data, "post_id long, comment_count long, like_count long, has_video int").repartition(3)
    want: dict[int, tuple] = {}
    for p, *a in data:
        if p % 10 == 0:
            cos = [np.dot(a, b) / n if (n := np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))) else 0.0 for q, *b in data if q != p]
            best, close = want.get(p, (-1.0, 0))
            want[p] = max(best, max(cos)), close + sum(c >= 0.99 for c in cos)
    for block in (7, 1 << 14):
        got = {r["post_id"]: (r["best"], r["n_close"]) for r in heuristics.post_similarity(posts.filter("post_id % 10 = 0"), posts, block=block).collect()}
        assert got.keys() == want.keys() and all(got[p][0] == pytest.approx(want[p][0]) and got[p][1] == want[p][1] for p in want)
    taken, cosines = [], heuristics._cosines
    for n in (1, 40):
        many_ = posts.select((F.col("post_id") + 0).alias("post_id"), "comment_count", "like_count", "has_video").crossJoin(spark.range(n).select(F.col("id").alias("copy"))).withColumn("post_id", F.col("post_id") + 10_000 * F.col("copy"))
        cells = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(heuristics, "_cosines", lambda q, v, cells=cells: (cells.add(q.shape[0] * v.shape[0]), cosines(q, v))[1])
        heuristics.post_similarity(many_.filter("post_id = 1000 or post_id % 10000 > 280"), many_).collect()
        taken.append(cells.value)
    assert taken[1] <= 2 * taken[0]


def test_rows_of_one_file_are_met_by_several_tasks(spark, vectors):
    """And tiles give plain distances, for blocks that are no multiple of a tile."""
    x, _ = arrays(vectors)
    rows = vectors.select("x").coalesce(1)
    asked = rows.withColumn("nth", F.monotonically_increasing_id())
    parts = blocks.meet(asked, rows, (), (), lambda q, more: (lambda x, batch: None, lambda: [np.ones(len(q))]), "one double")
    assert parts.groupBy("nth").count().agg(F.min("count")).first()[0] > 1
    q = np.concatenate([x, x])[: blocks.TILE + 9] + 3.0
    found = np.empty((len(q), len(x)))
    for at, d2 in blocks.tiles(q)(x):
        found[at] = d2
    assert np.allclose(found, ((q[:, None] - x[None]) ** 2).sum(2))


def test_last_rounds_of_ward_ask_for_few_distances(monkeypatch):
    """Of 1,500 vectors, against single joins; a round asks only for clusters that are new or whose nearest is gone."""
    x = np.random.default_rng(3).normal(size=(1_500, 4))
    asked, plain = [], ward._cheapest
    monkeypatch.setattr(ward, "_cheapest", lambda q, *a: asked.append(len(q)) or plain(q, *a))
    merges = ward._local([{"c": 10 + i, "n": 1.0, "x": list(v), "h": 0.0} for i, v in enumerate(x)], 5_000)
    live = {10 + i: (v, 1.0) for i, v in enumerate(x)}
    for node, a, b, height, n in merges:
        (v, s), (w, r) = live.pop(a), live.pop(b)
        assert height == pytest.approx(np.sqrt(2 * s * r / (s + r) * ((v - w) ** 2).sum())) and n == s + r
        live[node] = ((v * s + w * r) / n, n)
    assert len(merges) == 1_499 and len(live) == 1 and asked[0] == 1_500 and sum(asked) < 6 * 1_500


def test_subsample_trees_grow_side_by_side(spark):
    """Fits that wait for each other end, and keep their order and seeds."""
    import threading

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "id long, x array<double>")
    met, seen = threading.Barrier(3), []

    def fit(part, seed):
        met.wait(60)
        seen.append(seed)
        return clustering.lloyd(part, np.array([[0.0, 0.0], [6.0, 2.0]]), 3)

    alone = validity.subsample_stability(rows, lambda part, seed: clustering.lloyd(part, np.array([[0.0, 0.0], [6.0, 2.0]]), 3), 3)
    assert validity.subsample_stability(rows, fit, 3) == alone and sorted(seen) == [1, 2, 3]
