import functools
import operator
from datetime import datetime
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from softseg.functions import scalars
from softseg.operators import clustering, compliance, counts, fuzzify, heuristics, indicators, profiles, quantiles, reduce, rules, scale, validity
from softseg.plans.catalogue import queries


def test_titles(spark):
    titles = ["CEO", "Senior Manager", "manager", "Sales Associate", "General Manager", "International", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "user_id int, job_title string")
    got = [r["hierarchy_score"] for r in heuristics.hierarchy(rows).orderBy("user_id").collect()]
    assert got[0] >= 20 and got[1:] == [8, 6, 1, 9, 0, 0]


def test_roles_bands_regions(spark):
    row = spark.range(1).select(
        scalars.role_category(F.lit(2)), scalars.role_category(F.lit(3)), scalars.role_category(F.lit(8)), scalars.role_category(F.lit(None).cast("int")),
        scalars.age_band(F.lit(25)), scalars.age_band_midpoint(F.lit(30)), scalars.age_band(F.lit(10)), scalars.age_band_midpoint(F.lit(10)), scalars.region(F.lit("ch")), scalars.region(F.lit("JP")),
    ).first()
    assert list(row) == ["frontline", "supervisory", "management", "nan", "25-34", 30.0, "nan", None, "europe", "other"]


def test_engaging_posts(spark):
    rows = spark.createDataFrame([(0, "s", 0, 1, 0), (1, "s", 1, 1, 0), (2, "s", 5, 10, 0), (3, "s", 6, 0, 1), (4, None, 9, 9, 1)], "post_id int, stream_id string, comment_count int, like_count int, has_video int")
    assert [r["engaging"] for r in heuristics.engaging_posts(rows).orderBy("post_id").collect()] == [0, 0, 1, 1, 0]


def test_count_cells(spark):
    cells = ['{"a": 1, "b": 2}', "{post-created:3,login:2}", "{'x': 1}", None, "junk", "[1]"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    got = [r[0] for r in rows.orderBy("i").select(counts.parse_counts(F.col("cell"))).collect()]
    assert got == [{"a": 1, "b": 2}, {"post-created": 3, "login": 2}, {"x": 1}, {}, {}, {}]
    wide = counts.unpack_counts(rows, "cell").orderBy("i").collect()
    assert wide[1].asDict() == {"i": 1, "a": 0, "b": 0, "login": 2, "post-created": 3, "x": 0}
    with pytest.raises(ValueError):
        counts.unpack_counts(rows, "missing")


def events(spark, rows):
    return spark.createDataFrame([(i, u, datetime(*t), k, c) for i, (u, t, k, c) in enumerate(rows)], "event_id bigint, user_id string, timestamp timestamp_ntz, event_type string, client string")


def test_indicators_of_silent_and_active_users(spark):
    log = events(spark, [("a", (2025, 3, 3, 2, 0), "login", "mobile"), ("a", (2025, 3, 3, 2, 30), "post.created", "web"), ("b", (2025, 3, 8, 12, 0), "comment.created", "web")])
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    rows = {r["user_id"]: r for r in indicators.indicators(log, users).collect()}
    assert len(indicators.SCALARS) == 21 and len(rows["a"]) == 1 + 21 + 24 + 7
    assert rows["a"]["mobile_login_share"] == 1.0 and rows["a"]["working_hours_share"] == 0.0 and rows["a"]["hour_share_02"] == 1.0
    assert rows["b"]["comment_working_hours_share"] == 1.0 and rows["b"]["weekend_share"] == 1.0
    assert rows["c"]["non_working_hours_share"] == 1.0 and rows["c"]["total_events_per_month"] == 0.0
    assert indicators.Period(datetime(2025, 3, 3, 2), datetime(2025, 3, 8, 12)).days == 6


def hours(spark, **by_user):
    cols = ", ".join(f"{h} double" for h in indicators.HOURS)
    return spark.createDataFrame([(u, *[1.0 if h == at else 0.0 for h in range(24)]) for u, at in by_user.items()], f"user_id string, {cols}")


def test_shift_windows(spark):
    rows = hours(spark, night=2, noon=12, none=99).withColumn("p", F.lit("night"))
    engine = fuzzify.Fuzzifier([{"name": "w", "kind": "hour_profile", "window": [6, 8, 16, 18]}])
    plain = {r["user_id"]: (r["w__working"], r["w__non_working"]) for r in engine.fit_transform(rows).collect()}
    assert plain == {"night": (0.0, 1.0), "noon": (1.0, 0.0), "none": (0.0, 1.0)}
    night = {r["user_id"]: r["w__working"] for r in engine.fit_transform(rows, pattern=F.col("p")).collect()}
    assert night == {"night": 1.0, "noon": 0.0, "none": 0.0}


def test_default_features_are_27_in_unit_range(spark):
    rng = np.random.default_rng(0)
    cols = [f["indicator"] for f in fuzzify.DEFAULT_FEATURES if "indicator" in f]
    data = [(f"u{i}", *map(float, rng.gamma(1, 5, len(cols))), *map(float, rng.dirichlet(np.ones(24)))) for i in range(50)]
    rows = spark.createDataFrame(data, "user_id string, " + ", ".join(f"{c} double" for c in [*cols, *indicators.HOURS]))
    engine = fuzzify.Fuzzifier()
    out = engine.fit_transform(rows).toPandas()
    assert len(engine.columns) == 27 and list(out.columns) == ["user_id", *engine.columns]
    assert ((out[engine.columns] >= 0) & (out[engine.columns] <= 1)).all().all()
    assert not ((out["posting__high"] > 0) & (out["posting__high"] < 0.5)).any()
    with pytest.raises(KeyError):
        engine.fit(rows.drop("weekend_share"))
    with pytest.raises(ValueError):
        fuzzify.Fuzzifier([])


def test_alpha_report(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 5, 1.0).otherwise(0.0).alias("a"))
    got = fuzzify.alpha_report(rows, ["a"], [0.5]).first()
    assert (got["size"], got["reportable"]) == (5, False)
    assert fuzzify.segment_stability(rows, ["a"]).first()["stability"] == 1.0


def test_rules(spark):
    rows = spark.createDataFrame([(0, 1.0, 2, "shift-based", "night"), (0, 0.0, 20, "office-based", "office"), (20, 1.0, 2, "shift-based", "long"), (20, 0.0, 20, "office-based", "office")], "hierarchy_score int, broadcast_stream_share double, accessible_streams int, employee_category string, shift_pattern string")
    rows = rows.withColumns({c: F.lit(1.0) for c in ("topic_accesses_per_month", "reactions_per_month", "comments_per_month")})
    layer = rules.RuleLayer()
    effect = layer.apply(rows, ["posting", "commenting", "reactions"])
    got = rows.select(effect.weights["posting"].alias("p"), effect.weights["reactions"].alias("r"), effect.shift_pattern.alias("s"), effect.indicators["reactions_per_month"].alias("i")).collect()
    assert got[0]["p"] == pytest.approx(0.5, abs=0.02) and got[0]["r"] == pytest.approx(1.5, abs=0.02) and got[3]["p"] == pytest.approx(1.0, abs=0.02)
    assert [g["s"] for g in got] == ["night", None, "long", None]
    assert got[0]["i"] == pytest.approx(11 / 2) and got[1]["i"] == 1.0
    assert layer.describe()[0].startswith("IF hierarchy_score is low AND broadcast_stream_share is high THEN")
    off = rules.RuleLayer(enabled=False).apply(rows, ["posting"])
    assert rows.select(off.weights["posting"]).distinct().collect()[0][0] == 1.0
    with pytest.raises(KeyError):
        layer.apply(rows.drop("hierarchy_score"), ["posting", "commenting", "reactions"])


def test_compliance(spark):
    users = spark.createDataFrame([("a", "Ann", 30, "CH"), ("b", "Bob", 40, "US")], "user_id string, full_name string, age int, country string")
    consent = spark.createDataFrame([("a", 1)], "user_id string, consent int")
    assert [r["user_id"] for r in compliance.with_consent(users, consent).collect()] == ["a"]
    assert compliance.consent_coverage(users, consent).first()["coverage"] == 0.5
    assert compliance.generalise_demographics(users).columns == ["user_id", "age_band", "age_band_midpoint", "region"]
    assert compliance.forbidden_features(["age", "posts_per_month", "age__young", "full_name", "user_email"]) == ["age", "full_name", "user_email"]
    import hashlib

    p = users.select(scalars.pseudonym(F.col("user_id"), "s")).first()[0]
    assert p == "p" + hashlib.sha256(b"s:a").hexdigest()[:12]


def blobs(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    data = [(4 * i + j, [float(v) for v in rng.normal(c, 0.6)], j) for i in range(n) for j, c in enumerate(((0, 0), (6, 0), (0, 6), (6, 6)))]
    return spark.createDataFrame(data, "id int, x array<double>, truth int").coalesce(2).cache()


@pytest.mark.parametrize("method, options", [("fcm", {"max_iter": 60}), ("pfcm", {"max_iter": 40}), ("gk", {"max_iter": 30}), ("kmeans", {"n_init": 3}), ("ahc", {})])
def test_methods_find_the_blobs(spark, method, options):
    rows = blobs(spark)
    best, _ = clustering.with_restarts(method, rows, 4, range(1, 4 if method in ("fcm", "gk", "pfcm") else 2), **options)
    frame = best.assign(rows)
    assert validity.adjusted_rand(frame, "truth", "label").first()[0] > 0.95
    assert validity.separation(frame, best.fuzzy) > 0.5


def test_validity_of_blobs(spark):
    rows = blobs(spark, 40)
    model = clustering.fcm(rows, 4, max_iter=40, init="kmeans++")
    frame = model.assign(rows)
    assert validity.xie_beni(frame, model.centers).first()[0] < 1.0
    assert validity.davies_bouldin(frame) < 0.5 and validity.calinski_harabasz(frame) > 500
    runs = [clustering.fcm(rows, 4, max_iter=40, seed=s, init="kmeans++") for s in (1, 2)]
    got = validity.stability(rows, runs)
    assert got["mean_ari"] > 0.95 and got["agreement"] > 0.95


def test_elbow_votes_and_assignment():
    assert validity.detect_elbow([2, 3, 4, 5, 6], [100, 60, 20, 18, 17]) == 4
    assert validity.detect_elbow([2, 3], [2, 1]) is None
    gain = np.array([[1, 9, 2], [8, 7, 3], [2, 3, 1.0]])
    from itertools import permutations

    best = max(permutations(range(3)), key=lambda p: sum(gain[i, j] for i, j in enumerate(p)))
    assert validity.assignment(gain) == list(best)


def test_pca_and_scalers(spark):
    rows = blobs(spark, 20)
    pca = reduce.fit_pca(rows, 1.0)
    back = np.array([r["x"] for r in rows.orderBy("id").collect()])
    scores = np.array([r["pc"] for r in pca.transform(rows).orderBy("id").collect()])
    assert pca.k == 2 and np.allclose(pca.inverse(scores), back) and np.allclose(scores.mean(0), 0, atol=1e-9)
    flat = rows.select("id", F.col("x")[0].alias("a"), F.lit(3.0).alias("b"))
    z = scale.standard_scale(flat, ["a", "b"]).toPandas()
    assert abs(z["a"].mean()) < 1e-9 and abs(z["a"].std(ddof=0) - 1) < 1e-9 and (z["b"] == 0).all()
    assert scale.full_resolution(flat, ["a", "b"]).toPandas().notna().all().all()
    with pytest.raises(ValueError):
        scale.scale(flat, ["a"], "other")


def test_archetypes_and_privacy():
    base = {c: {i: v for i, v in zip(profiles.ARCHETYPE_INDICATORS, t)} for c, t in enumerate(profiles.ARCHETYPES.values())}
    got = profiles.label_archetypes(base)
    assert [got[c][0] for c in range(4)] == list(profiles.ARCHETYPES)
    assert profiles.privacy(True, [20, 30]) == "High" and profiles.privacy(True, [19]) == "Low" and profiles.privacy(False, [50]) == "Low"


def test_recent_post(spark):
    posts = spark.createDataFrame([(i, datetime(2025, 1, 1 + i // 3, i % 3)) for i in range(9)], "post_id int, created_at timestamp_ntz")
    asks = spark.createDataFrame([(0, datetime(2024, 1, 1), 0.5), (1, datetime(2025, 1, 2, 1), 0.99), (2, datetime(2025, 2, 1), 0.0)], "id int, ts timestamp_ntz, pick double")
    got = {r["id"]: (r["seen"], r["post_id"]) for r in counts.recent_post(asks, posts, 2).collect()}
    assert got == {0: (0, 0), 1: (4, 3), 2: (9, 7)}


def test_exact_quantiles_of_many_rows(spark):
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.normal(size=4_000), np.repeat([0.5, 0.7], 900), rng.integers(0, 5, 700)])
    rng.shuffle(data)
    rows = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(data)] + [(None, 1.0)], "a double, b double").repartition(4)
    qs = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = quantiles.exact_quantiles(rows, {"a": F.col("a"), "b": F.col("b")}, qs, small_rows=10, accuracy=100)
    assert got["a"] == pytest.approx(list(np.quantile(data, qs))) and got["a"] == pytest.approx(quantiles.exact_quantiles(rows, {"a": F.col("a")}, qs)["a"])
    assert got["b"] == pytest.approx(list(np.quantile([float(i % 3) for i in range(len(data))] + [1.0], qs)))


def test_a_bound_on_a_sum_does_not_depend_on_the_order_of_its_terms(spark, tmp_path):
    terms = [0.1, 0.02, 0.08, 0.1, 0.05, 0.03, 0.07, 0.05]
    orders = list(permutations(terms, 8))
    off = [o for o in orders if functools.reduce(operator.add, o) > 0.5][:3]
    assert off
    rows = [(part, 1.0, 2.0, x) for part, o in enumerate(off) for x in o] + [(7, 1.0, 2.0, 0.7), (8, 1.0, 2.0, 0.9), (9, 1.0, 2.0, float("nan")), (9, 1.0, 2.0, 0.1), (10, 1.0, 2.0, None)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_partkey"]: r["discount"] for r in queries()["impute_median"](spark, str(tmp_path)).collect()}
    assert got == {0: 0.8, 1: 0.8, 2: 0.8, 7: 0.7, 8: 0.9, 9: 0.8, 10: 0.8}
