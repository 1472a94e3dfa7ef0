"""Queries on vectors: reduction, clustering, validity, stability and profiles.

Vectors are ``embeddings``.  Where SQL is to agree, centres come from the data:
the mean of each label, or the vectors of the first ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softseg.operators import clustering, counts, many, profiles, reduce, validity
from softseg.operators.vectors import argmax_label, squared_distances, vector_frame, with_rows
from softseg.operators.ward import ward_tree
from softseg.sources import driver_tables as src
from softseg.sources.store import materialise, side_by_side

from . import segmentation
from . import sql as S
from .catalogue import _fuzzy, _ind, query, rnd, rounded
from .config import config as make_config


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, x)."""
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def _means(rows: DataFrame) -> np.ndarray:
    """Mean vector of each label, by label."""
    c, _ = validity._centroids(rows)
    return np.stack([c[j] for j in sorted(c)])


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, clustering.Clusters]:
    rows = _vectors(spark, d)
    return rows, clustering.Clusters("fcm", _means(rows), 0.0, 0, True)


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    """(id, label, x, u, pred) by degrees around the label means."""
    rows, model = _model(spark, d)
    return with_rows(rows, model.degrees, "u").withColumn("pred", argmax_label(F.col("u"))), model.centers


@query(f"with {S.MEMBERS} select i as id, j as cluster, {rnd('u', 'u', 5)} from mem")
def fcm_predict(spark, d):
    frame, _ = _assigned(spark, d)
    return rounded(profiles.by_cluster(frame.select("id", "u")).select("id", "cluster", F.col("w").alias("u")), 5)


@query(f"with {S.MEMBERS} select {rnd('sum(u * u) / count(distinct i)', 'partition_coefficient')} from mem")
def partition_coefficient(spark, d):
    return rounded(validity.partition_coefficient(_assigned(spark, d)[0]))


@query(f"with {S.MEMBERS} select {rnd('-sum(u * ln(greatest(1e-12, least(1e0, u)))) / count(distinct i)', 'classification_entropy')}, {rnd('-sum(u * ln(greatest(1e-12, least(1e0, u)))) / count(distinct i) / ln(count(distinct j) * 1e0)', 'normalised_entropy')} from mem")
def classification_entropy(spark, d):
    return rounded(validity.classification_entropy(_assigned(spark, d)[0]))


@query(f"""with {S.MEMBERS}, sep as (select min(q) as s from (select sum((a.c - b.c) * (a.c - b.c)) as q from cen a join cen b on a.d = b.d and a.j < b.j group by a.j, b.j))
select {rnd('(select sum(u * u * d2) from mem) / ((select count(distinct i) from mem) * s)', 'xie_beni', 4)} from sep""")
def xie_beni(spark, d):
    frame, centers = _assigned(spark, d)
    return rounded(validity.xie_beni(frame, centers), 4)


def _one(spark: SparkSession, d: str, name: str, value: float, digits: int = 6) -> DataFrame:
    """A number over the whole table as a frame of one row."""
    return src.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(float(value)), digits).alias(name))


@query(f"""with {S.VECTORS}, own as (select dis.i, dis.j, sqrt(d2) as r from dis join (select distinct i, label from vec) l on l.i = dis.i and l.label = dis.j),
sc as (select j, avg(r) as s from own group by 1),
pr as (select a.j as a, b.j as b, sqrt(sum((a.c - b.c) * (a.c - b.c))) as m from cen a join cen b on a.d = b.d and a.j <> b.j group by 1, 2),
w as (select a, max((x.s + y.s) / m) as r from pr join sc x on x.j = a join sc y on y.j = b group by 1)
select (select count(*) from embeddings) as n, {rnd('avg(r)', 'davies_bouldin')} from w""")
def davies_bouldin(spark, d):
    return _one(spark, d, "davies_bouldin", validity.davies_bouldin(_vectors(spark, d)))


@query(f"""with {S.VECTORS}, mn as (select d, avg(v) as m from vec group by 1), sz as (select label as j, count(distinct i) as n from vec group by 1),
b as (select sum(n * (c - m) * (c - m)) as b from cen join mn using (d) join sz using (j)),
w as (select sum((v - c) * (v - c)) as w from vec join cen on cen.d = vec.d and cen.j = vec.label)
select (select count(*) from embeddings) as n, {rnd('b / ((select count(*) from sz) - 1) / (w / ((select count(*) from embeddings) - (select count(*) from sz)))', 'calinski_harabasz')} from b, w""")
def calinski_harabasz(spark, d):
    return _one(spark, d, "calinski_harabasz", validity.calinski_harabasz(_vectors(spark, d)))


_PAIRS = """e as (select vec_id as i, label, embedding::double[] as x from embeddings),
pr as (select a.i, a.label as own, b.label as other, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) as r from e a join e b on a.i <> b.i),
mm as (select i, own, other, avg(r) as m from pr group by 1, 2, 3),
sl as (select i, own, max(case when own = other then m end) as a, min(case when own <> other then m end) as b from mm group by 1, 2),
sv as (select i, own, case when a is null then 0e0 else (b - a) / greatest(a, b) end as s from sl)"""


@query(f"with {_PAIRS} select own as label, {rnd('avg(s)', 's')}, count(*) as n from sv group by 1")
def silhouette(spark, d):
    rows = validity.silhouette_rows(_vectors(spark, d))
    return rounded(rows.groupBy("label").agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("n")))


@query(f"""with {S.MEMBERS}, pd as (select i, arg_min(j, (d2, j)) as p from dis group by 1), {_PAIRS.replace("select vec_id as i, label,", "select vec_id as i, p as label,").replace("from embeddings)", "from embeddings join pd on vec_id = pd.i)")},
w as (select i, list_sort(list(u), 'DESC') as u from mem group by 1)
select count(*) as n, {rnd('sum((u[1] - u[2]) * s) / sum(u[1] - u[2])', 'fuzzy_silhouette')} from sv join w using (i)""")
def fuzzy_silhouette(spark, d):
    frame, _ = _assigned(spark, d)
    value = validity.fuzzy_silhouette(frame.drop("label").withColumnRenamed("pred", "label"))
    return _one(spark, d, "fuzzy_silhouette", value)


@query(f"""with {S.MEMBERS}, {_PAIRS.split("mm as")[0].replace("on a.i <> b.i", "on a.i % 100 = 0").replace("select a.i, a.label as own, b.label as other", "select a.i, b.i as o").rstrip().rstrip(",")},
ms as (select j, sum(u * u) as w from mem group by 1),
md as (select pr.i, j, sum(r * u * u) / any_value(w) as m from pr join mem on mem.i = pr.o join ms using (j) group by 1, 2),
ow as (select i, arg_max(j, (u, -j)) as own from mem group by 1),
ab as (select md.i, max(case when j = own then m end) as a, min(case when j <> own then m end) as b from md join ow using (i) group by 1)
select i as id, {rnd('(b - a) / (greatest(a, b) + 1e-12)', 's', 5)} from ab""")
def pairwise_fuzzy_silhouette(spark, d):
    """Silhouettes by distances weighted by squared degrees: the rows whose id is divisible by 100, among all rows."""
    frame, _ = _assigned(spark, d)
    return rounded(validity.pairwise_fuzzy_silhouette(frame, asked=frame.filter("id % 100 = 0")), 5)


@query(f"""with {S.VECTORS}, rk as (select i, sqrt(d2) as r, row_number() over (partition by i order by d2, j) as k from dis)
select a.i as id, {rnd('(b.r - a.r) / greatest(a.r, b.r)', 's', 5)} from rk a join rk b on a.i = b.i and a.k = 1 and b.k = 2""")
def prototype_silhouette(spark, d):
    rows, model = _model(spark, d)
    return rounded(validity.prototype_silhouette(rows, model.centers), 5)


@query(f"""with {S.MEMBERS}, pd as (select i, arg_min(j, (d2, j)) as p from dis group by 1),
c as (select label as a, p as b, count(*) as n from pd join (select distinct i, label from vec) using (i) group by 1, 2),
t as (select (select sum(n * (n - 1) / 2e0) from c) as s, (select sum(q * (q - 1) / 2e0) from (select sum(n) as q from c group by a)) as sa,
             (select sum(q * (q - 1) / 2e0) from (select sum(n) as q from c group by b)) as sb, (select sum(n) * (sum(n) - 1) / 2e0 from c) as t)
select {rnd('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)', 'adjusted_rand')} from t""")
def adjusted_rand(spark, d):
    frame, _ = _assigned(spark, d)
    return rounded(validity.adjusted_rand(frame, "label", "pred"))


@query(f"with {S.MEMBERS}, pd as (select i, arg_min(j, (d2, j)) as p from dis group by 1) select j as cluster, count(case when p = j then 1 end) as size, {rnd('count(case when p = j then 1 end) * 1e0 / count(*)', 'share')}, {rnd('sum(u)', 'mass', 4)}, {rnd('avg(u)', 'mass_share')}, {rnd('avg(case when p = j then u end)', 'mean_membership', 5)} from mem join pd using (i) group by 1")
def membership_distribution(spark, d):
    frame, _ = _assigned(spark, d)
    out = profiles.membership_distribution(frame.drop("label").withColumnRenamed("pred", "label"))
    return out.select("cluster", "size", F.round("share", 6).alias("share"), F.round("mass", 4).alias("mass"), F.round("mass_share", 6).alias("mass_share"), F.round("mean_membership", 5).alias("mean_membership"))


@query(f"""with {S.MEMBERS}, s as (select i, max(u) as a, list_sort(list(u), 'DESC')[2] as b from mem group by 1)
select {rnd('avg(case when b >= 0.1e0 then 1e0 else 0e0 end)', 'mixed_share')}, {rnd('avg(a)', 'mean_max')} from s""")
def overlap_report(spark, d):
    return rounded(profiles.overlap_summary(_assigned(spark, d)[0], 0.1))


@query(f"with {S.MEMBERS} select a.j as a, b.j as b, {rnd('avg(least(a.u, b.u))', 'overlap')} from mem a join mem b using (i) group by 1, 2")
def pairwise_overlap(spark, d):
    return rounded(profiles.pairwise_overlap(_assigned(spark, d)[0].select("u")))


@query(f"""with {S.MEMBERS}, s as (select i, max(u) as u from mem group by 1)
select case when u >= 0.8e0 then '>=0.8' when u >= 0.6e0 then '0.6-0.8' when u >= 0.4e0 then '0.4-0.6' when u >= 0.2e0 then '0.2-0.4' else '<0.2' end as band, count(*) as n from s group by 1""")
def membership_bands(spark, d):
    frame, _ = _assigned(spark, d)
    return frame.groupBy(counts.membership_band(F.array_max("u")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {S.MEMBERS}, p as (select vec_id as i, embedding[1]::double as x, embedding[2]::double as y from embeddings),
q as (select p.*, u, min(x) over () as lx, max(x) over () as hx, min(y) over () as ly, max(y) over () as hy from p join (select i, max(u) as u from mem group by 1) using (i)),
z as (select cast(least(9, floor((x - lx) / (hx - lx) * 10)) as integer) as bin_x, cast(least(9, floor((y - ly) / (hy - ly) * 10)) as integer) as bin_y, x, u from q)
select bin_x, bin_y, count(*) as n, {rnd('avg(u)', 'mean_u', 5)}, {rnd('sum(u * x) / sum(u)', 'weighted_x', 5)}, case when avg(u) < 0.4e0 then 'weak' when avg(u) >= 0.6e0 then 'align' else 'disconnect' end as zone from z group by 1, 2""")
def zone_grid(spark, d):
    frame, _ = _assigned(spark, d)
    points = frame.select(F.col("x")[0].alias("p"), F.col("x")[1].alias("q"), F.array_max("u").alias("m"))
    return rounded(counts.zone_grid(points, "p", "q", "m"), 5)


@query(f"""with {S.VECTORS}, c2 as (select j, max(case when d = 1 then c end) as cx, max(case when d = 2 then c end) as cy from cen where d <= 2 group by 1),
b as (select min(embedding[1])::double as lx, max(embedding[1])::double as hx, min(embedding[2])::double as ly, max(embedding[2])::double as hy from embeddings),
g as (select a, q, lx + a * (hx - lx) / 19e0 as gx, ly + q * (hy - ly) / 19e0 as gy from b, (select unnest(range(20)) as a), (select unnest(range(20)) as q)),
m as (select a, q, j, cx, 1e0 / greatest((gx - cx) * (gx - cx) + (gy - cy) * (gy - cy), 1e-12) as w from g, c2),
u as (select a, q, j, cx, w / sum(w) over (partition by a, q) as u from m)
select cast(a as integer) as grid_x, cast(q as integer) as grid_y, {rnd('max(u)', 'strength', 4)}, {rnd('sum(u * cx)', 'surface', 4)} from u group by 1, 2""")
def engagement_surface(spark, d):
    """Degrees of a 20 x 20 grid over the first two dimensions around the label means, and the centre-weighted surface."""
    rows = _vectors(spark, d)
    centers = _means(rows)[:, :2]
    box = rows.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    cells = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("grid_x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("grid_y"))
    at = lambda i, g: F.col(f"lo{i}") + F.col(g) * (F.col(f"hi{i}") - F.col(f"lo{i}")) / 19.0
    grid = with_rows(cells.select("grid_x", "grid_y", F.array(at(0, "grid_x"), at(1, "grid_y")).alias("x")), lambda x: clustering.memberships(squared_distances(x, centers), 2.0))
    surface = sum((F.col("u")[j] * float(c[0]) for j, c in enumerate(centers)), F.lit(0.0))
    return rounded(grid.select("grid_x", "grid_y", F.array_max("u").alias("strength"), surface.alias("surface")), 4)


_K3 = "v as (select i, d, v from vec), c0 as (select i as j, d, v as c from v where i < 3)"


def _steps(update: str, n: int) -> str:
    return ", ".join(update.format(p=i, n=i + 1) for i in range(n))


_FCM_STEP = """d{n} as (select i, j, greatest(sum((v - c) * (v - c)), 0e0) as d2 from v join c{p} using (d) group by 1, 2),
u{n} as (select i, j, case when min(d2) over (partition by i) <= 1e-12 then (case when d2 <= 1e-12 then 1e0 else 0e0 end) / sum(case when d2 <= 1e-12 then 1e0 else 0e0 end) over (partition by i)
                      else (1e0 / greatest(d2, 1e-12)) / sum(1e0 / greatest(d2, 1e-12)) over (partition by i) end as u from d{n}),
c{n} as (select j, d, sum(u * u * v) / sum(u * u) as c from u{n} join v using (i) group by 1, 2)"""
_KMEANS_STEP = """d{n} as (select i, j, sum((v - c) * (v - c)) as d2 from v join c{p} using (d) group by 1, 2),
l{n} as (select i, arg_min(j, (d2, j)) as j from d{n} group by 1),
c{n} as (select j, d, avg(v) as c from l{n} join v using (i) group by 1, 2)"""


def _from_first(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    """The vectors, and those of the first three ids as centres."""
    rows = _vectors(spark, d).select("id", "x")
    first = rows.filter("id < 3").orderBy("id").collect()
    return rows, np.array([r["x"] for r in first], float)


def _center_frame(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """Centres in long form, (cluster, d, c), from literals."""
    cells = F.array(*[F.struct(F.lit(j).alias("cluster"), F.lit(i + 1).alias("d"), F.lit(float(v)).alias("c")) for j, c in enumerate(centers) for i, v in enumerate(c)])
    return rows.limit(1).select(F.explode(cells).alias("p")).select("p.*")


@query(f"with {S.VECTORS}, {_K3}, {_steps(_FCM_STEP, 3)} select cast(j as integer) as cluster, cast(d as integer) as d, {rnd('c', 'c', 4)} from c3")
def fcm_fixed_iter(spark, d):
    """Three fuzzy c-means steps from the first three vectors."""
    rows, first = _from_first(spark, d)
    model = clustering.fcm(rows, 3, max_iter=3, tol=0.0, centers=first)
    return rounded(_center_frame(rows, model.centers), 4)


@query(f"with {S.VECTORS}, {_K3}, {_steps(_KMEANS_STEP, 3)} select cast(j as integer) as cluster, cast(d as integer) as d, {rnd('c', 'c', 4)} from c3")
def kmeans_fixed_iter(spark, d):
    rows, first = _from_first(spark, d)
    return rounded(_center_frame(rows, clustering.lloyd(rows, first, 3, -1.0).centers), 4)


_START_SQL = """f{s} as (select {s} as start, sum(u * u * d2) as objective from u3_{s} join d3_{s} using (i, j))"""


def _start_sql(s: int) -> str:
    """Three steps from the vectors of ids 3 s to 3 s + 2."""
    steps = f"c0_{s} as (select i - {3 * s} as j, d, v as c from v where i >= {3 * s} and i < {3 * s + 3})"
    for n in range(1, 4):
        steps += ", " + _FCM_STEP.format(p=f"{n - 1}_{s}", n=f"{n}_{s}")
    return steps + ", " + _START_SQL.format(s=s)


@query(f"with {S.VECTORS}, v as (select i, d, v from vec), {', '.join(map(_start_sql, range(4)))}, al as ({' union all '.join(f'select * from f{s}' for s in range(4))})"
       f" select start, {rnd('objective', 'objective', 4)}, objective = (select min(objective) from al) as best from al")  # fmt: skip
def fcm_fixed_starts(spark, d):
    """Four starts of three steps in the same three scans, and which has the least objective."""
    rows = _vectors(spark, d).select("id", "x")
    got = {r["id"]: r["x"] for r in rows.filter("id < 12").collect()}
    runs = many.fcm_runs(rows, [np.array([got[3 * s + j] for j in range(3)], float) for s in range(4)], max_iter=3, tol=0.0)
    best = many.best_of(runs)
    return rounded(spark.createDataFrame([(s, r.objective, r is best) for s, r in enumerate(runs)], "start int, objective double, best boolean"), 4)


_KS = range(2, 11)


@query(f"""with {S.VECTORS}, ks as (select unnest(range(2, 11)) as k),
dd as (select a.i, b.i as j, greatest(sum((a.v - b.v) * (a.v - b.v)), 0e0) as d2 from vec a join vec b using (d) where b.i < 10 group by 1, 2),
uu as (select k, i, j, d2, case when min(d2) over (partition by k, i) <= 1e-12 then (case when d2 <= 1e-12 then 1e0 else 0e0 end) / sum(case when d2 <= 1e-12 then 1e0 else 0e0 end) over (partition by k, i)
                           else (1e0 / greatest(d2, 1e-12)) / sum(1e0 / greatest(d2, 1e-12)) over (partition by k, i) end as u from dd join ks on j < k),
la as (select k, i, arg_max(j, (u, -j)) as l from uu group by 1, 2),
me as (select k, l, d, avg(v) as c from la join vec using (i) group by 1, 2, 3),
sz as (select k, l, count(*) as n from la group by 1, 2),
rr as (select k, l, i, sum((v - c) * (v - c)) as r2 from la join vec using (i) join me using (k, l, d) group by 1, 2, 3),
sc as (select k, l, avg(sqrt(r2)) as s, sum(r2) as w from rr group by 1, 2),
ga as (select a.k, a.l as a, b.l as b, sqrt(sum((a.c - b.c) * (a.c - b.c))) as g from me a join me b on a.k = b.k and a.d = b.d and a.l <> b.l group by 1, 2, 3),
db as (select k, avg(r) as db from (select ga.k, a, max((x.s + y.s) / g) as r from ga join sc x on x.k = ga.k and x.l = a join sc y on y.k = ga.k and y.l = b group by 1, 2) group by 1),
gm as (select d, avg(v) as m from vec group by 1),
be as (select k, sum(n * (c - m) * (c - m)) as b from me join gm using (d) join sz using (k, l) group by 1),
wi as (select k, sum(w) as w, count(*) as q from sc group by 1),
sp as (select k, min(g) as g from (select k, a.i, b.i as o, sum((a.v - b.v) * (a.v - b.v)) as g from vec a join vec b on a.d = b.d and a.i < b.i join ks on b.i < k where b.i < 10 group by 1, 2, 3) group by 1),
su as (select k, sum(u * u) as pc, -sum(u * ln(greatest(1e-12, least(1e0, u)))) as ce, sum(u * u * d2) as j from uu group by 1),
nn as (select count(*) as n from embeddings)
select cast(k as integer) as k, {rnd('j', 'objective', 4)}, {rnd('pc / n', 'partition_coefficient')}, {rnd('ce / n', 'classification_entropy')}, {rnd('ce / n / ln(k)', 'normalised_entropy')}, {rnd('j / (n * g)', 'xie_beni', 4)}, {rnd('db', 'davies_bouldin', 5)}, {rnd('b / (q - 1) / (w / (n - q))', 'calinski_harabasz', 4)}
from su join sp using (k) join db using (k) join be using (k) join wi using (k), nn""")
def k_criteria(spark, d):
    """Objective and six indices for k = 2 to 10 at given centres, the vectors of the first k ids: two scans for all of them."""
    rows = _vectors(spark, d).select("id", "x")
    first = np.array([r["x"] for r in rows.filter("id < 10").orderBy("id").collect()], float)
    table = many.validity_table(rows, [clustering.Clusters("fcm", first[:k], 0.0, 0, True) for k in _KS])
    digits = {"objective": 4, "xie_beni": 4, "davies_bouldin": 5, "calinski_harabasz": 4}
    frame = spark.createDataFrame([tuple(r.values()) for r in table], ", ".join(f"{n} {'int' if n == 'k' else 'double'}" for n in table[0]))
    return frame.select(*[F.col(c) if c == "k" else F.round(c, digits.get(c, 6)).alias(c) for c in frame.columns])


def _reduced(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, x): the components that hold nine tenths of the variance, written for the iterations."""
    rows = _vectors(spark, d)
    pca = reduce.fit_pca(rows, 0.9)
    return materialise(pca.transform(rows, "pc").select("id", "label", F.col("pc").alias("x")), "components")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return materialise(_vectors(spark, d), "vectors")


@query()
def pca_scores(spark, d):
    rows = _vectors(spark, d)
    return reduce.fit_pca(rows, 0.9).transform(rows, "pc").select("id", "pc")


@query()
def pca_variance(spark, d):
    rows = _vectors(spark, d)
    table = reduce.fit_pca(rows, 0.9).variance_table()
    cells = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(v).alias("share"), F.lit(c).alias("cumulative")) for i, v, c in table])
    return rounded(rows.limit(1).select(F.explode(cells).alias("p")).select("p.*"))


def _labels_of(model: clustering.Clusters, rows: DataFrame) -> DataFrame:
    return model.assign(rows.withColumnRenamed("label", "truth")).select("id", "label", F.array_max("u").alias("degree"))


#: Production values of the configuration: restarts of a run and of a sweep.
_RESTARTS, _SWEEP_RESTARTS = 30, 5


@query()
def fcm_restarts(spark, d):
    """The best of thirty runs of up to 300 steps each; all runs share their scans."""
    rows = _reduced(spark, d)
    return _labels_of(clustering.with_restarts("fcm", rows.drop("label"), 4, range(1, _RESTARTS + 1))[0], rows)


@query()
def pfcm(spark, d):
    rows = _reduced(spark, d)
    return _labels_of(clustering.pfcm(rows.drop("label"), 4), rows)


@query()
def gk(spark, d):
    rows = _reduced(spark, d)
    return _labels_of(clustering.gustafson_kessel(rows.drop("label"), 4), rows)


@query()
def kmeans(spark, d):
    rows = _whole(spark, d)
    return _labels_of(clustering.kmeans(rows.drop("label"), 4), rows)


@query()
def ward(spark, d):
    """Labels of all vectors for k = 2 to 12, cut from one exact tree."""
    rows = _whole(spark, d)
    leaves, _, _ = ward_tree(rows).cut(range(2, 13))
    return rows.select("id", "x").join(leaves.drop("leaf", "n"), "x").drop("x")


@query()
def membership_agreement(spark, d):
    rows = _reduced(spark, d).drop("label")
    runs = [clustering.fcm(rows, 3, seed=s) for s in (1, 2)]
    return _one(spark, d, "membership_agreement", validity.membership_agreement(*(r.assign(rows) for r in runs)), 4)


@query()
def k_selection(spark, d):
    """Criteria for k = 2 to 10 over all components and rows, five restarts of up to 300 steps, ten k-means starts."""
    rows = _reduced(spark, d).drop("label")
    metrics = validity.k_metrics(rows, _KS, _SWEEP_RESTARTS)
    best = validity.suggest_k(metrics)["recommended"]
    names = list(metrics[0])
    found = [(*(float(m[n]) for n in names), m["k"] == best) for m in metrics]
    return rounded(spark.createDataFrame(found, ", ".join(f"{n} double" for n in names) + ", recommended boolean"), 4)


def _user_clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Users by activity: two crisp groups as degrees, (user_id, u, label), and their indicators."""
    frame = _ind(spark, d)
    active = F.coalesce(F.try_divide("total_events_per_month", F.col("total_events_per_month") + 20.0), F.lit(0.0))
    soft = frame.select("*", F.array(F.lit(1.0) - active, active).alias("u"))
    return soft.withColumn("label", argmax_label(F.col("u"))), frame


_SOFT = f"{S.INDICATORS}, sf as (select ind.*, total_events_per_month / (total_events_per_month + 20e0) as u1 from ind), sg as (select *, 1e0 - u1 as u0, case when u1 > 1e0 - u1 then 1 else 0 end as label from sf)"


@query(f"with {_SOFT} select label as cluster, {', '.join(rnd(f'avg({c})', c) for c in profiles.PROFILE_INDICATORS)} from sg group by 1")
def cluster_feature_averages(spark, d):
    return rounded(profiles.feature_averages(_user_clusters(spark, d)[0]))


@query(f"with {_SOFT} " + " union all ".join(f"select {j} as cluster, {', '.join(rnd(f'sum(u{j} * {c}) / sum(u{j})', c) for c in profiles.PROFILE_INDICATORS)} from sg" for j in (0, 1)))
def cluster_feature_averages_weighted(spark, d):
    return rounded(profiles.feature_averages(_user_clusters(spark, d)[0], weighted=True))


_DOM = profiles.PROFILE_INDICATORS


@query(f"""with {_SOFT}, a as ({' union all '.join(f"select {j} as cluster, '{c}' as attribute, sum(u{j} * {c}) / sum(u{j}) as mean, avg({c}) as m, stddev_pop({c}) as s from sg" for j in (0, 1) for c in _DOM)}),
z as (select *, (mean - m) / (case when s > 1e-12 then s else 1e0 end) as z from a),
r as (select cluster, 'high' as direction, cast(row_number() over (partition by cluster order by z desc, attribute) as integer) as nth, attribute, z, mean from z
      union all select cluster, 'low', cast(row_number() over (partition by cluster order by z, attribute) as integer), attribute, z, mean from z)
select cluster, direction, nth, attribute, {rnd('z', 'z', 5)}, {rnd('mean', 'mean', 5)} from r where nth <= 3""")
def dominant_attributes(spark, d):
    soft, _ = _user_clusters(spark, d)
    return rounded(profiles.dominant_attributes(soft.select("u", *_DOM), _DOM, 3), 5)


@query()
def archetype_labels(spark, d):
    """Clusters of the fuzzy user vectors, named after the nearest archetypes, with their users."""
    engine, fuzzy = _fuzzy(spark, d)
    rows = materialise(vector_frame(fuzzy, engine.columns), "fuzzy-vectors")
    model = clustering.fcm(rows, 4)
    labelled = model.assign(rows).select(F.col("id").alias("user_id"), "label").join(_ind(spark, d), "user_id")
    means = {r["cluster"]: r.asDict() for r in profiles.feature_averages(labelled).collect()}
    names = profiles.label_archetypes(means)
    named = F.coalesce(*[F.when(F.col("label") == c, F.lit(n)) for c, (n, _) in names.items()])
    return labelled.groupBy("label", named.alias("archetype")).agg(F.count(F.lit(1)).alias("n_users"))


@query()
def method_comparison(spark, d):
    """Five methods on all rows: separation, stability over runs or subsamples, interpretability and privacy.

    Fuzzy methods take the components, crisp ones the whole vectors.
    """
    soft, whole = _reduced(spark, d).drop("label"), _whole(spark, d).drop("label")
    cfg, width = make_config(), len(whole.first()["x"])
    columns = [f"x{i}" for i in range(width)]
    values = materialise(whole.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)]), "values")

    def compared(method: str) -> tuple:
        rows = whole if method in ("kmeans", "ahc") else soft
        best, runs = clustering.with_restarts(method, rows, 3, range(1, 4))
        e = segmentation.evaluate(best, rows, runs, values, columns, cfg, [])
        return method, e["separation"], e["stability"]["mean_ari"], e["stability"]["min_ari"], e["interpretability"], e["privacy"], int(best.k), int(rows.count())

    found = side_by_side([lambda method=method: compared(method) for method in clustering.METHODS])
    return rounded(spark.createDataFrame(found, "method string, separation double, mean_ari double, min_ari double, interpretability double, privacy string, n_clusters int, n long"), 4)
