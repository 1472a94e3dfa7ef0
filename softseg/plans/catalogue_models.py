"""Queries that hold fitted models to SQL: components, possibilistic and Gustafson-Kessel steps, stability, interpretability.

Where a model starts from somewhere, it starts from the vectors of the first
ids or the mean of each label, so that SQL takes the same steps.  Components
and Gustafson-Kessel norms have closed forms on two coordinates, which is where
SQL follows them; what holds for all coordinates is checked on all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softseg.operators import clustering, compliance, profiles, reduce, scale, validity
from softseg.operators.vectors import argmax_label
from softseg.sources import driver_tables as src

from . import segmentation
from . import sql as S
from .catalogue import query, rnd, rounded
from .catalogue_clusters import _DOM, _SOFT, _center_frame, _means, _one, _user_clusters, _vectors

# Principal components.

_PLANE = """p as (select vec_id as i, embedding[1]::double as x, embedding[2]::double as y from embeddings),
cv as (select var_pop(x) as a, covar_pop(x, y) as b, var_pop(y) as c, avg(x) as mx, avg(y) as my from p),
ev as (select *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) as l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) as l2 from cv)"""


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", F.slice("x", 1, 2).alias("x"))


def _shares(rows: DataFrame, table: list[tuple[int, float, float]]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(v).alias("share"), F.lit(c).alias("cumulative")) for i, v, c in table])
    return rounded(rows.limit(1).select(F.explode(cells).alias("p")).select("p.*"))


@query(f"""with {_PLANE} select 1 as component, {rnd('l1 / (l1 + l2)', 'share')}, {rnd('l1 / (l1 + l2)', 'cumulative')} from ev
union all select 2, {rnd('l2 / (l1 + l2)', 'share')}, 1e0 from ev""")
def pca_plane_variance(spark, d):
    rows = _plane(spark, d)
    return _shares(rows, reduce.fit_pca(rows, 2).variance_table())


@query(f"""with {_PLANE} select 1 as component, {rnd('(1 + abs(b / sqrt(a * c))) / 2', 'share')}, {rnd('(1 + abs(b / sqrt(a * c))) / 2', 'cumulative')} from ev
union all select 2, {rnd('(1 - abs(b / sqrt(a * c))) / 2', 'share')}, 1e0 from ev""")
def pca_standardised_variance(spark, d):
    rows = _plane(spark, d)
    return _shares(rows, reduce.fit_pca(rows, 2, standardise=True).variance_table())


@query(f"""with {_PLANE}, ax as (select *, b / sqrt(b * b + (l1 - a) * (l1 - a)) as u0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) as v0 from ev),
ay as (select *, sign(case when abs(u0) >= abs(v0) then u0 else v0 end) as s1, sign(case when abs(v0) >= abs(u0) then -v0 else u0 end) as s2 from ax)
select i as id, {rnd('s1 * ((x - mx) * u0 + (y - my) * v0)', 'pc1', 5)}, {rnd('s2 * ((y - my) * u0 - (x - mx) * v0)', 'pc2', 5)} from p, ay""")
def pca_plane_scores(spark, d):
    rows = _plane(spark, d)
    scores = reduce.fit_pca(rows, 2).transform(rows, "pc")
    return rounded(scores.select("id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2")), 5)


@query(f"with {S.VECTORS} select count(*) as n_components, {rnd('sum(s)', 'total_variance', 5)}, 0e0 as largest_covariance from (select d, var_pop(v) as s from vec group by 1)")
def pca_whole(spark, d):
    """All components together hold all the variance, and no two of them vary together."""
    rows = _vectors(spark, d).select("id", "x")
    found = reduce.fit_pca(rows, int(rows.select(F.size("x")).first()[0]), None).transform(rows, "pc")
    cells = found.select("id", F.posexplode("pc").alias("c", "v"))
    total = cells.groupBy("c").agg(F.var_pop("v").alias("v")).agg(F.count(F.lit(1)).alias("n_components"), F.sum("v").alias("total_variance"))
    # Neighbouring components of each row stand for all pairs.
    pairs = found.select(F.explode(F.arrays_zip(F.expr("slice(pc, 1, size(pc) - 1)").alias("p"), F.expr("slice(pc, 2, size(pc) - 1)").alias("q"), F.expr("sequence(1, size(pc) - 1)").alias("c"))).alias("z"))
    most = pairs.groupBy("z.c").agg(F.abs(F.covar_pop("z.p", "z.q")).alias("v")).agg(F.max("v").alias("largest_covariance"))
    return rounded(total.crossJoin(F.broadcast(most)), 5)


# Steps of the soft models.

_TYPICAL = """g as (select j, greatest(sum(u * u * d2) / sum(u * u), 1e-12) as gamma from mem group by 1),
t0 as (select i, j, u, d2, 1e0 / (1e0 + d2 / gamma) as t from mem join g using (j))"""


@query(f"""with {S.MEMBERS}, {_TYPICAL} select cast(j as integer) as cluster, cast(d as integer) as d, {rnd('sum((u * u + t * t) * v) / sum(u * u + t * t)', 'c', 4)} from t0 join vec using (i) group by 1, 2""")
def pfcm_fixed_iter(spark, d):
    """One possibilistic fuzzy c-means step from the label means: widths, typicalities, degrees and new centres."""
    rows = _vectors(spark, d).select("id", "x")
    first = _means(_vectors(spark, d))
    return rounded(_center_frame(rows, clustering.pfcm(rows, len(first), max_iter=1, tol=0.0, centers=first).centers), 4)


@query(f"with {S.MEMBERS}, {_TYPICAL} select i as id, cast(j as integer) as cluster, {rnd('t', 'typicality', 5)} from t0")
def typicality_of_means(spark, d):
    rows = _vectors(spark, d).select("id", "x")
    first = _means(_vectors(spark, d))
    model = clustering.pfcm(rows, len(first), max_iter=1, tol=0.0, centers=first)
    model.centers = first
    frame = clustering.typicality_frame(model, rows)
    return rounded(frame.select("id", F.posexplode("t").alias("cluster", "typicality")), 5)


_GK_STEP = """d{n} as (select i, j, p.x, p.y, greatest((p.x - c.x) * (p.x - c.x) * c.aa + 2 * (p.x - c.x) * (p.y - c.y) * c.ab + (p.y - c.y) * (p.y - c.y) * c.bb, 0e0) as d2 from p, c{p} c),
u{n} as (select *, case when min(d2) over (partition by i) <= 1e-12 then (case when d2 <= 1e-12 then 1e0 else 0e0 end) / sum(case when d2 <= 1e-12 then 1e0 else 0e0 end) over (partition by i)
                      else (1e0 / greatest(d2, 1e-12)) / sum(1e0 / greatest(d2, 1e-12)) over (partition by i) end as u from d{n}),
m{n} as (select j, sum(u * u * x) / sum(u * u) as x, sum(u * u * y) / sum(u * u) as y from u{n} group by 1),
k{n} as (select j, any_value(m.x) as x, any_value(m.y) as y, sum(u * u * (u.x - m.x) * (u.x - m.x)) / sum(u * u) as a, sum(u * u * (u.x - m.x) * (u.y - m.y)) / sum(u * u) as b, sum(u * u * (u.y - m.y) * (u.y - m.y)) / sum(u * u) as c from u{n} u join m{n} m using (j) group by 1),
r{n} as (select j, x, y, a + 1e-4 * (a + c) / 2 + 1e-12 as a, b, c + 1e-4 * (a + c) / 2 + 1e-12 as c from k{n}),
c{n} as (select j, x, y, sqrt(a * c - b * b) * c / (a * c - b * b) as aa, -sqrt(a * c - b * b) * b / (a * c - b * b) as ab, sqrt(a * c - b * b) * a / (a * c - b * b) as bb from r{n})"""


@query(f"""with {_PLANE}, c0 as (select i as j, x, y, 1e0 as aa, 0e0 as ab, 1e0 as bb from p where i < 3), {', '.join(_GK_STEP.format(p=n, n=n + 1) for n in range(3))}
select cast(j as integer) as cluster, 1 as d, {rnd('x', 'c', 4)} from c3 union all select cast(j as integer), 2, {rnd('y', 'c', 4)} from c3""")
def gk_fixed_iter(spark, d):
    """Three Gustafson-Kessel steps on the first two coordinates, from the first three vectors."""
    rows = _plane(spark, d)
    first = np.array([r["x"] for r in rows.filter("id < 3").orderBy("id").collect()], float)
    model = clustering.gustafson_kessel(rows, 3, max_iter=3, tol=0.0, centers=first)
    return rounded(_center_frame(rows, model.centers), 4)


# Stability, interpretability and privacy.

_PERMUTATIONS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def _run_sql(n: int) -> str:
    return f"""q{n} as (select a.i, b.i - {3 * n} as j, greatest(sum((a.v - b.v) * (a.v - b.v)), 0e0) as d2 from vec a join vec b using (d) where b.i >= {3 * n} and b.i < {3 * n + 3} group by 1, 2),
r{n} as (select i, j, case when min(d2) over (partition by i) <= 1e-12 then (case when d2 <= 1e-12 then 1e0 else 0e0 end) / sum(case when d2 <= 1e-12 then 1e0 else 0e0 end) over (partition by i)
                      else (1e0 / greatest(d2, 1e-12)) / sum(1e0 / greatest(d2, 1e-12)) over (partition by i) end as u from q{n}),
l{n} as (select i, arg_min(j, (-u, j)) as l from r{n} group by 1)"""


@query(f"""with {S.VECTORS}, {_run_sql(0)}, {_run_sql(1)},
c as (select l0.l as a, l1.l as b, count(*) as n from l0 join l1 using (i) group by 1, 2),
t as (select (select sum(n * (n - 1) / 2e0) from c) as s, (select sum(q * (q - 1) / 2e0) from (select sum(n) as q from c group by a)) as sa,
             (select sum(q * (q - 1) / 2e0) from (select sum(n) as q from c group by b)) as sb, (select sum(n) * (sum(n) - 1) / 2e0 from c) as t),
ari as (select (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t) as v from t),
pm as (select * from (values {', '.join(f'({n}, {a}, {b})' for n, p in enumerate(_PERMUTATIONS) for a, b in enumerate(p))}) x(n, a, b)),
ov as (select n, sum(r0.u * r1.u) as gain, sum(abs(r0.u - r1.u)) as away from pm join r0 on r0.j = a join r1 on r1.j = b and r1.i = r0.i group by 1),
ag as (select 1 - arg_max(away, gain) / 2 / (select count(*) from embeddings) as v from ov)
select (select count(*) from embeddings) as n, {rnd('ari.v', 'mean_ari')}, {rnd('ari.v', 'min_ari')}, {rnd('ag.v', 'agreement')} from ari, ag""")
def stability_runs(spark, d):
    """Two soft runs, around the first three vectors and the three after them: agreement of labels and of degrees."""
    rows = _vectors(spark, d).select("id", "x")
    got = {r["id"]: r["x"] for r in rows.filter("id < 6").collect()}
    runs = [clustering.Clusters("fcm", np.array([got[3 * n + j] for j in range(3)], float), 0.0, 0, True) for n in (0, 1)]
    found = validity.stability(rows, runs)
    return rounded(rows.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.lit(found[k]).alias(k) for k in ("mean_ari", "min_ari", "agreement")]))


@query(f"""with {S.VECTORS}, rn as (select unnest(range(10)) as r), kp as (select r, vec_id as i from rn join embeddings on (vec_id * 7 + r * 3) % 10 < 8),
ce as (select r, label as j, d, avg(v) as c from kp join vec using (i) group by 1, 2, 3),
ds as (select r, i, j, sum((v - c) * (v - c)) as d2 from kp join vec using (i) join ce using (r, d) group by 1, 2, 3),
la as (select r, i, arg_min(j, (d2, j)) as l from ds group by 1, 2),
ct as (select x.r as a, y.r as b, x.l as p, y.l as q, count(*) as n from la x join la y on x.i = y.i and x.r < y.r group by 1, 2, 3, 4),
sp as (select a, b, sum(t * (t - 1) / 2e0) as s from (select a, b, p, sum(n) as t from ct group by 1, 2, 3) group by 1, 2),
sq as (select a, b, sum(t * (t - 1) / 2e0) as s from (select a, b, q, sum(n) as t from ct group by 1, 2, 3) group by 1, 2),
st as (select a, b, sum(n * (n - 1) / 2e0) as s, sum(n) * (sum(n) - 1) / 2e0 as t from ct group by 1, 2),
ar as (select (st.s - sp.s * sq.s / t) / ((sp.s + sq.s) / 2 - sp.s * sq.s / t) as v from st join sp using (a, b) join sq using (a, b))
select (select count(*) from embeddings) as n, {rnd('avg(v)', 'mean_ari')}, {rnd('min(v)', 'min_ari')} from ar""")
def stability_subsamples(spark, d):
    """Ten subsamples of four fifths of the rows, each with its own means of the labels as centres: agreement of all pairs on the rows that both have."""
    rows = _vectors(spark, d)

    def fit(part: DataFrame, seed: int) -> clustering.Clusters:
        return clustering.Clusters("kmeans", _means(part), 0.0, 0, True, seed)

    found = validity.subsample_stability(rows, fit, kept=[(F.col("id") * 7 + i * 3) % 10 < 8 for i in range(10)])
    return rounded(rows.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.lit(found[k]).alias(k) for k in ("mean_ari", "min_ari")]))


# Clusters mapped back, and drawn, through components.

_TOP = 5


@query(f"""with {S.VECTORS}, st as (select d, avg(v) as m, stddev_pop(v) as s from vec group by 1),
z as (select j, d, c, (c - m) / s as z from cen join st using (d)),
r as (select j, 'absolute' as ranking, row_number() over (partition by j order by abs(z) desc, d) as nth, d, z, c from z
      union all select j, 'positive', row_number() over (partition by j order by z desc, d), d, z, c from z where z > 0
      union all select j, 'negative', row_number() over (partition by j order by z, d), d, z, c from z where z < 0)
select cast(j as integer) as cluster, ranking, cast(nth as integer) as nth, 'x' || cast(d - 1 as varchar) as feature, {rnd('z', 'standardised', 4)}, {rnd('c', 'original', 4)} from r where nth <= {_TOP}""")
def center_features(spark, d):
    """The label means, as points among the components of the standardised vectors, mapped back and their features ranked."""
    rows = _vectors(spark, d)
    means = _means(rows)
    pca = reduce.fit_pca(rows.select("id", "x"), means.shape[1], None, standardise=True)
    found = reduce.center_features(pca, pca.project(means), _TOP)
    return rounded(spark.createDataFrame([tuple(r.values()) for r in found], "cluster int, ranking string, nth int, feature string, standardised double, original double"), 4)


@query(f"""with {_PLANE}, ax as (select *, b / sqrt(b * b + (l1 - a) * (l1 - a)) as u0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) as v0 from ev),
ay as (select *, sign(case when abs(u0) >= abs(v0) then u0 else v0 end) as s1, sign(case when abs(v0) >= abs(u0) then -v0 else u0 end) as s2 from ax),
ce as (select label as j, avg(x) as cx, avg(y) as cy from p join (select vec_id as i, label from embeddings) using (i) group by 1),
di as (select i, j, x, y, cx, cy, greatest((x - cx) * (x - cx) + (y - cy) * (y - cy), 1e-12) as d2 from p, ce),
me as (select *, (1 / d2) / sum(1 / d2) over (partition by i) as u from di),
co as (select j, any_value(cx) as cx, any_value(cy) as cy, sum(u * u * (x - cx) * (x - cx)) / sum(u * u) as a, sum(u * u * (x - cx) * (y - cy)) / sum(u * u) as b, sum(u * u * (y - cy) * (y - cy)) / sum(u * u) as c from me group by 1),
pr as (select j, s1 * ((cx - mx) * u0 + (cy - my) * v0) as x, s2 * ((cy - my) * u0 - (cx - mx) * v0) as y,
         u0 * u0 * co.a + 2 * u0 * v0 * co.b + v0 * v0 * co.c as a, s1 * s2 * (u0 * v0 * (co.c - co.a) + (u0 * u0 - v0 * v0) * co.b) as b, v0 * v0 * co.a - 2 * u0 * v0 * co.b + u0 * u0 * co.c as c from co, ay),
ei as (select *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) as e1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) as e2 from pr),
an as (select *, degrees(atan2(e1 - a, b)) as g from ei)
select cast(j as integer) as cluster, {rnd('x', 'x', 4)}, {rnd('y', 'y', 4)}, {rnd('4 * sqrt(e1)', 'width', 4)}, {rnd('4 * sqrt(e2)', 'height', 4)}, {rnd('case when g > 90 then g - 180 else g end', 'angle', 2)} from an""")
def covariance_ellipses(spark, d):
    """Fuzzy covariances around the label means on the first two coordinates, as ellipses of two deviations in the plane of the components."""
    plane = _vectors(spark, d).select("id", "label", F.slice("x", 1, 2).alias("x"))
    model = clustering.Clusters("fcm", _means(plane), 0.0, 0, True)
    rows = plane.select("id", "x")
    found = reduce.covariance_ellipses(reduce.fit_pca(rows, 2), model.centers, clustering.fuzzy_covariances(rows, model))
    frame = spark.createDataFrame([tuple(r.values()) for r in found], "cluster int, x double, y double, width double, height double, angle double")
    return frame.select("cluster", *[F.round(c, 2 if c == "angle" else 4).alias(c) for c in frame.columns[1:]])


_Z = f"""{_SOFT}, a as ({' union all '.join(f"select {j} as cluster, '{c}' as attribute, (sum(u{j} * {c}) / sum(u{j}) - avg({c})) / (case when stddev_pop({c}) > 1e-12 then stddev_pop({c}) else 1e0 end) as z from sg" for j in (0, 1) for c in _DOM)}),
rk as (select *, row_number() over (partition by cluster order by abs(z) desc, attribute) as n from a),
fo as (select avg(greatest(0e0, least(1e0, (held - {3 / len(_DOM)!r}) / (1 - {3 / len(_DOM)!r})))) as focus from (select cluster, sum(case when n <= 3 then abs(z) end) / greatest(sum(abs(z)), 1e-12) as held from rk group by 1)),
co as (select (1 - sum(p.z * q.z) / (greatest(sqrt(sum(p.z * p.z)), 1e-12) * greatest(sqrt(sum(q.z * q.z)), 1e-12))) / 2 as apart from a p join a q using (attribute) where p.cluster = 0 and q.cluster = 1),
en as (select greatest(0e0, least(1e0, 1 - avg(-(u0 * ln(greatest(u0, 1e-12)) + u1 * ln(greatest(u1, 1e-12)))) / ln(2e0))) as clear from sg),
pt as (select 0.5 * focus + 0.5 * apart as dominance, clear from fo, co, en)"""


@query(f"with {_Z} select (select count(*) from sg) as n, {rnd('dominance', 'dominance', 5)}, {rnd('clear', 'transparency', 5)}, {rnd('(dominance + clear) / 2', 'interpretability', 5)}, {rnd('(2 * dominance + clear) / 3', 'weighted', 5)} from pt")
def interpretability_parts(spark, d):
    """Dominance of features, transparency of degrees, and their plain and weighted mean, for two groups of users."""
    soft, _ = _user_clusters(spark, d)
    soft = soft.filter("u[1] is not null")
    dominance = profiles.dominance_clarity(segmentation.profile_z(soft, list(_DOM)))
    clear = profiles.transparency(validity.classification_entropy(soft.select("u")).first()["normalised_entropy"], True)
    parts = {"dominance": dominance, "transparency": clear, "expert": None}
    values = parts | {"interpretability": profiles.interpretability(parts), "weighted": profiles.interpretability(parts, {"dominance": 2.0})}
    return rounded(soft.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.lit(float(values[k])).alias(k) for k in ("dominance", "transparency", "interpretability", "weighted")]), 5)


@query(f"""with {_SOFT}, sz as (select label, count(*) as n from sg group by 1)
select case when min(n) >= {compliance.MIN_GROUP} then 'High' else 'Low' end as fuzzy_level, 'Low' as crisp_level, 'Low' as level_with_violation, 'High' as compliance_level, min(n) as smallest_cluster from sz""")
def privacy_levels(spark, d):
    """Privacy of the same groups as degrees, as crisp labels and with a forbidden feature, and the level of the allowed features."""
    soft, frame = _user_clusters(spark, d)
    sizes = [r["n"] for r in soft.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    allowed = compliance.assess(list(_DOM), None, None)
    broken = compliance.assess([*_DOM, "age", "gender"], None, None)
    levels = {
        "fuzzy_level": profiles.privacy(True, sizes, allowed.violations),
        "crisp_level": profiles.privacy(False, sizes, allowed.violations),
        "level_with_violation": profiles.privacy(True, sizes, broken.violations),
        "compliance_level": allowed.level,
    }
    least = soft.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest_cluster"))
    return least.select(*[F.lit(v).alias(k) for k, v in levels.items()], "smallest_cluster")


# Preparation of features.


@query("""select cast(count(*) as bigint) as n, round(sum(balance), 2) as balance, round(sum(logged), 4) as logged from
(select c_acctbal as balance, case when c_acctbal > 0 then ln(c_acctbal) end as logged, case when c_nationkey <> 0 then c_acctbal / c_nationkey end as part from customer) where balance is not null and logged is not null and part is not null""")
def non_finite_rows(spark, d):
    """Customers that have a number in every column, of balance, its logarithm and its part by nation."""
    rows = src.table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("balance"), F.log("c_acctbal").alias("logged"), F.try_divide("c_acctbal", "c_nationkey").cast("double").alias("part"))
    kept = scale.drop_non_finite(rows, ["balance", "logged", "part"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.round(F.sum("logged"), 4).alias("logged"))
