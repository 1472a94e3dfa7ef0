"""Attributes of users' positions, permissions and posts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseg.functions import scalars
from softseg.sources.schema import CaseTables
from softseg.sources.store import materialise


def hierarchy(users: DataFrame, title_col: str = "job_title", category_col: str | None = None, user_id_col: str = "user_id") -> DataFrame:
    """(user, hierarchy_score, role_category)."""
    score = scalars.title_score(F.col(title_col), F.col(category_col) if category_col else None)
    return users.select(user_id_col, score.alias("hierarchy_score")).withColumn("role_category", scalars.role_category(F.col("hierarchy_score")))


def engaging_posts(posts: DataFrame, stream_col: str = "stream_id") -> DataFrame:
    """``posts`` with ``engaging`` 0/1: more comments than its stream's rounded mean, and a video or more likes than the mean."""
    means = posts.groupBy(F.col(stream_col).alias("_stream")).agg(*[F.bround(F.avg(c), 0).alias(f"_mean_{c}") for c in ("comment_count", "like_count")])
    above = lambda c: F.col(c) > F.col(f"_mean_{c}")
    video = F.col("has_video") > 0 if "has_video" in posts.columns else F.lit(False)
    flag = F.col(stream_col).isNotNull() & above("comment_count") & (video | above("like_count"))
    # Means are combined in each task and there is one row for each stream, so however many posts a stream has, they stay where they are.
    found = posts.join(means, posts[stream_col] == means["_stream"], "left")
    return found.withColumn("engaging", F.coalesce(flag, F.lit(False)).cast("int")).drop("_stream", "_mean_comment_count", "_mean_like_count")


#: Kinds of query posts that meet all kinds of posts at once, and cosines that a task computes at once.
QUERY_BLOCK, CELLS = 1 << 14, 1 << 22
SIMILARITY_COLUMNS = ("comment_count", "like_count", "comment_like_count", "mention_count", "has_video", "engaging")


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of all rows of both; 0 for a row of zeros.  Whole numbers give exact products, so equal posts have equal cosines."""
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
    return np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm > 0)


def post_similarity(queries: DataFrame, posts: DataFrame, least: float = 0.99, columns: Sequence[str] = SIMILARITY_COLUMNS, block: int = QUERY_BLOCK) -> DataFrame:
    """(post_id, best, n_close) of every query post: its largest cosine with another post, and the posts whose cosine is at least ``least``.

    Posts of equal numbers are one kind, with their count; what is compared is
    kinds, so the work grows with the distinct numbers and not with the posts.
    Of each kind a query leaves out the posts of its own id, one as a rule: a
    kind of which none is left is no neighbour.  Kinds of queries meet all kinds
    block by block; a block is what the tasks share, and a task gives one row
    for each of them.
    """
    spark = posts.sparkSession
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if c in posts.columns]).alias("v")
    rows = posts.filter("post_id is not null").select("post_id", v)
    kinds = materialise(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()), "post-kinds")
    asked = materialise(queries.filter("post_id is not null").select("post_id", v), "similar-queries")
    same = rows.join(asked.select("post_id").distinct(), "post_id", "left_semi").groupBy("post_id", "v").agg(F.count(F.lit(1)).alias("n"))
    own = same.join(kinds.select("v", "kind"), "v").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("own"))
    none = F.array().cast("array<struct<kind: bigint, n: bigint>>")
    asked = materialise(asked.join(own, "post_id", "left").select("post_id", "v", F.coalesce("own", none).alias("own")), "similar-own")
    shapes = materialise(asked.select("v", "own").distinct().withColumn("nth", F.monotonically_increasing_id()), "similar-shapes")
    starts = sorted(r["nth"] for r in shapes.groupBy((F.col("nth") - F.col("nth") % block).alias("nth")).count().collect())
    found = None
    for start in starts:
        held = shapes.filter(F.col("nth").between(start, start + block - 1)).select("nth", "v", F.col("own.kind").alias("kind"), F.col("own.n").alias("n")).toPandas()
        flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in held[c]])
        left_out = (np.repeat(np.arange(len(held)), [len(x) for x in held["kind"]]), flat("kind"), flat("n"))
        shared = spark.sparkContext.broadcast((held["nth"].to_numpy(), np.array(held["v"].tolist(), float), left_out))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            nth, q, (at, kind, count) = shared.value
            best, close = np.full(len(nth), -np.inf), np.zeros(len(nth), np.int64)
            step = max(1, CELLS // max(1, len(nth)))
            for batch in batches:
                for i in range(0, len(batch), step):
                    part = batch.slice(i, step)
                    order = np.argsort(part.column(0).to_numpy())
                    n, kinds_ = part.column(2).to_numpy()[order], part.column(0).to_numpy()[order]
                    cosine = _cosines(q, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)[order])
                    close += (cosine >= least) @ n
                    place = np.minimum(np.searchsorted(kinds_, kind), len(kinds_) - 1)
                    here = kinds_[place] == kind
                    rows_, cols, less = at[here], place[here], count[here]
                    np.subtract.at(close, rows_, np.where(cosine[rows_, cols] >= least, less, 0))
                    gone = n[cols] <= less
                    cosine[rows_[gone], cols[gone]] = -np.inf
                    best = np.maximum(best, cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nth), pa.array(best), pa.array(close)], names=["nth", "best", "close"])

        part = kinds.select("kind", "v", "n").mapInArrow(run, "nth long, best double, close long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.limit(0).select("post_id", F.lit(0.0).alias("best"), F.lit(0).cast("bigint").alias("n_close"))
    each = found.groupBy("nth").agg(F.max("best").alias("best"), F.sum("close").alias("close"))
    each = shapes.join(each, "nth").select("v", "own", F.when(F.col("best") > float("-inf"), F.col("best")).alias("best"), "close")
    return asked.join(each, ["v", "own"]).groupBy("post_id").agg(F.max("best").alias("best"), F.sum("close").alias("n_close"))


def post_activity(posts: DataFrame, comments: DataFrame, reactions: DataFrame) -> DataFrame:
    """(user_id, post_id, n): posts, comments and reactions of every user on every post."""
    parts = [posts.select(F.col("author_id").alias("user_id"), "post_id"), comments.select(F.col("author_id").alias("user_id"), "post_id"), reactions.select("user_id", "post_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user_id", "post_id").agg(F.count(F.lit(1)).alias("n"))


def permission_matrix(permissions: DataFrame, user_id_col: str = "user_id") -> DataFrame:
    return permissions.groupBy(user_id_col, "stream_id").agg(F.max("can_access").alias("can_access"))


def stream_accessibility(users: DataFrame, streams: DataFrame, permissions: DataFrame, user_id_col: str = "user_id") -> DataFrame:
    """(user, accessible_streams, broadcast_stream_share).

    A stream is open if no permission names it; others need a permission of 1.
    Open streams are the same for all, so their counts are added; users and
    streams are never paired.
    """
    matrix = permission_matrix(permissions, user_id_col)
    named = permissions.select("stream_id").distinct()
    kind = (F.col("stream_type") == "broadcast").cast("int") if "stream_type" in streams.columns else F.lit(0)
    typed = streams.select("stream_id", kind.alias("broadcast"))
    n_open = typed.join(named, "stream_id", "left_anti").agg(F.count(F.lit(1)).alias("open"), F.coalesce(F.sum("broadcast"), F.lit(0)).alias("open_broadcast"))
    own = matrix.filter("can_access = 1").join(typed, "stream_id").groupBy(user_id_col).agg(F.count(F.lit(1)).alias("own"), F.sum("broadcast").alias("own_broadcast"))
    n = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    rows = users.select(user_id_col).join(own, user_id_col, "left").join(F.broadcast(n_open))
    return rows.select(user_id_col, n("open", "own").alias("accessible_streams"), scalars.share(n("open_broadcast", "own_broadcast"), n("open", "own")).alias("broadcast_stream_share"))


def heuristic_attributes(case: CaseTables) -> DataFrame:
    """Eight attributes per user."""
    key = case.user_id_col
    posts = engaging_posts(case.posts)
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    authored = posts.groupBy(F.col("author_id").alias(key)).agg(F.count(F.lit(1)).alias("posts_authored"), F.sum("engaging").alias("engaging_posts_authored"))
    acts = case.posts.select(F.col("author_id").alias(key)).unionByName(case.comments.select(F.col("author_id").alias(key))).unionByName(case.reactions.select(F.col("user_id").alias(key)))
    out = hierarchy(case.users, user_id_col=key)
    for part in (count(case.group_memberships, "group_memberships"), stream_accessibility(case.users, case.streams, case.stream_permissions, key), authored, count(acts, "post_interactions")):
        out = out.join(part, key, "left")
    return out.na.fill(0)
