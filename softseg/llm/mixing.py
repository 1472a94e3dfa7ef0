"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies.  Its whole
part is taken as it is; the fractional part is an inclusion probability, and
the flight phase of the cube method moves these probabilities to 0 or 1 along
the null space of the balancing constraints, so that the document total and
the token total of the source stay as they were.  Units move in threes: with
two constraints every three of them span a one-dimensional null space.

Blocks of bounded size fly on their own and leave at most two units each; the
left-over units form new blocks until one block per source remains, in which
landing settles what flight leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import row_digest, text_or_empty, word_count
from .rows import packed, row_key, unpacked
from .store import materialise

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_ROWS = 2_000
#: Lightest units of a source, whose landing looks at all their subsets.
LAST = 12
#: Pairs of units, at most, that landing changes for each other to come nearer to the token total.
SWAPS = 4
#: Sources up to this many are broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 10_000
SEED = 20


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are strictly between 0 and 1; sum(p) and sum(p * size) stay."""
    p, size = p.astype(float).copy(), size.astype(float)
    live = np.argsort(-size, kind="stable")
    live = live[(p[live] > 0) & (p[live] < 1)]
    while len(live) >= 3:
        n = len(live) // 3 * 3
        live = np.concatenate([_step(p, size, live[:n].reshape(-1, 3), rng), live[n:]])
    return p


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight and landing, from heavy to light units.

    The heavier half flies and lands first.  What its landing adds to the
    document and token totals or takes from them is taken back by the
    probabilities of the lighter half, whose turn is next; it is zero on
    average, so on average they stay.  The lightest units land on the subset
    that comes nearest to both totals, and a few swaps make up for what is left.
    """
    p, size = p.astype(float).copy(), size.astype(float)
    order = np.argsort(-size, kind="stable")
    order = every = order[(p[order] > 0) & (p[order] < 1)]
    aim = p[every] @ size[every]
    totals = lambda units: np.array([p[units].sum(), p[units] @ size[units]])
    owed = np.zeros(2)
    while len(order) > LAST:
        n = (len(order) + 1) // 2
        now, order = order[:n], order[n:]
        goal = totals(now)
        p[now] = landing(flight(p[now], size[now], rng), size[now], rng)
        owed += goal - totals(now)
        p[order], owed = _absorb(p[order], size[order], owed)
        order = order[(p[order] > 0) & (p[order] < 1)]
    if len(order):
        p[order] = nearest_subset(size[order], totals(order) + owed, rng)
    for _ in range(SWAPS):
        if not _swap(p, size, every, aim - p[every] @ size[every]):
            break
    return p


def _swap(p: np.ndarray, size: np.ndarray, units: np.ndarray, owed: float) -> bool:
    """Change a taken unit for one that isn't, of those pairs that whose sizes differ most nearly by the tokens owed; the number of documents stays."""
    taken, left = units[p[units] == 1], units[p[units] == 0]
    if abs(owed) < 1 or not len(taken) or not len(left):
        return False
    left = left[np.argsort(size[left], kind="stable")]
    at = np.searchsorted(size[left], size[taken] + owed)
    near = np.stack([np.clip(at - 1, 0, len(left) - 1), np.clip(at, 0, len(left) - 1)])
    error = np.abs(size[taken] + owed - size[left[near]])
    side, which = np.unravel_index(error.argmin(), error.shape)
    if error[side, which] >= abs(owed):
        return False
    p[taken[which]], p[left[near[side, which]]] = 0, 1
    return True


def _absorb(p: np.ndarray, size: np.ndarray, owed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities whose document and token totals are higher by ``owed``, and what they can't take.

    The change is the smallest that is linear in size.  Where both totals can't
    be had, because what is owed is heavier than so few documents, tokens come
    first.
    """
    for both in (True, False):
        q, rest = p.copy(), owed
        for _ in range(12):
            free = np.flatnonzero((q > 0) & (q < 1))
            if not len(free) or abs(rest[1]) < 1e-9 and (not both or abs(rest[0]) < 1e-9):
                break
            rows = np.stack([np.ones(len(free)), size[free]])
            change = np.linalg.lstsq(rows, rest, rcond=1e-12)[0] if both else np.full(len(free), rest[1] / max(rows[1].sum(), 1e-9))
            now = np.clip(q[free] + change, 0, 1)
            rest = rest - rows @ (now - q[free])
            q[free] = now
        if abs(rest[1]) < 1:
            break
    q[np.abs(q) < 1e-9], q[np.abs(q - 1) < 1e-9] = 0, 1
    return q, rest


def nearest_subset(size: np.ndarray, goal: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing problem of a few units: of all subsets, one whose tokens are nearest to ``goal``, a document counting as a tenth of a mean one."""
    picks = (np.arange(1 << len(size))[:, None] >> np.arange(len(size))) & 1
    error = np.abs(picks @ size - goal[1]) + 0.1 * size.mean() * np.abs(picks.sum(axis=1) - goal[0])
    return picks[rng.choice(np.flatnonzero(error <= error.min() + 1e-6))].astype(float)


def _step(p: np.ndarray, size: np.ndarray, threes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move each three along its null vector until one of its units is settled; the units still open, in order."""
    s, x = size[threes], p[threes]
    u = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], axis=1)
    u[~u.any(axis=1)] = (1.0, -1.0, 0.0)
    u /= np.abs(u).max(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf))
        down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf))
    far, back = up.min(axis=1), down.min(axis=1)
    go_up = rng.random(len(x)) * (far + back) < back
    x = x + np.where(go_up, far, -back)[:, None] * u
    hit = np.where(go_up, up.argmin(axis=1), down.argmin(axis=1))
    rows = np.arange(len(x))
    x[rows, hit] = np.round(x[rows, hit])
    x[np.abs(x) < 1e-9], x[np.abs(x - 1) < 1e-9] = 0, 1
    p[threes] = x
    flat = threes.ravel()
    return flat[(p[flat] > 0) & (p[flat] < 1)]


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle the last one or two units: of the designs that keep each probability, that with the least token error."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 1:
        p[open_] = rng.random(1) < p[open_]
    elif len(open_) == 2:
        (a, b), (sa, sb) = p[open_], size[open_]
        goal = a * sa + b * sb
        cost = {(i, j): abs(i * sa + j * sb - goal) for i in (0, 1) for j in (0, 1)}
        designs = []
        for both in (max(0.0, a + b - 1), min(a, b)):
            chance = {(1, 1): both, (1, 0): a - both, (0, 1): b - both, (0, 0): 1 - a - b + both}
            designs.append((sum(cost[k] * v for k, v in chance.items()), chance))
        chance = min(designs, key=lambda d: d[0])[1]
        keys = list(chance)
        at = rng.random() < np.cumsum([max(0.0, chance[k]) for k in keys])
        p[open_] = keys[int(at.argmax()) if at.any() else -1]
    return p


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, size) -> one row per source: source_no, source, source_size, n_docs, target.

    Sources by code point, null last, get ``weights`` in turn and share
    ``share`` times all sizes; no target exceeds ``cap`` times its source, and
    the rest is shared again by weight among the others.  That is the level at
    which capped sources and weighted ones together use up the total.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    everything = Window.partitionBy()
    per = per.withColumn("source_no", F.row_number().over(by_name)).withColumn("w", F.element_at(turn, (F.col("source_no") - 1) % len(weights) + 1))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    per = per.withColumn("turn", F.row_number().over(Window.orderBy(F.col("most") / F.col("w"), "source_no")))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first source, by most room to least, whose cap is above the level that is left for it.
    level = F.min(F.when(F.col("most") > F.col("level") * F.col("w"), F.struct("turn", "level"))).over(everything)["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("w")))
    return per.select("source_no", "source", "source_size", "n_docs", target.alias("target"))


def _fly(blocks: DataFrame, last: bool) -> DataFrame:
    """One flight over every block, and the landing too if it is the last."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h", "_row"], ascending=False, kind="stable")
        rng = np.random.default_rng([SEED, *(int(k) & 0xFFFFFFFF for k in key)])
        size = rows["size"].to_numpy(float)
        rows["p"] = (settle if last else flight)(rows["p"].to_numpy(float), size, rng)
        return rows[["_row", "source_no", "h", "size", "p"]]

    return blocks.groupBy("source_no", "block").applyInPandas(run, "_row long, source_no int, h long, size long, p double")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, digest), one row per input row.

    ``size`` is the number of words, ``taken`` = ``copies`` x ``size``; copies
    are 0, 1 or 2.  Null texts have size 0, a null source is a source of its
    own (last), null ids are allowed, repeated rows are units of their own, and
    an empty table gives no rows.  The same table read in the same splits gives
    the same result.
    """
    text = text_or_empty(text_col)
    sizes = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(text).alias("size"),
            row_digest(text).alias("digest"),
        ),
        "mix-sizes",
    )
    targets = materialise(source_targets(sizes), "mix-targets")
    n_sources = targets.count()
    named = targets.withColumnRenamed("source", "_source")
    side = F.broadcast(named) if n_sources <= BROADCAST_SOURCES else named
    pi = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(pi + 1e-9)
    units = sizes.join(side, sizes["source"].eqNullSafe(side["_source"])).withColumn("whole", whole.cast("int"))
    h = F.when(F.col("id").isNull(), F.xxhash64("_row")).otherwise(F.xxhash64("id"))
    units = units.withColumn("p", F.greatest(pi - F.col("whole"), F.lit(0.0))).withColumn("h", h)
    open_ = units.filter("p > 1e-9").select("_row", "source_no", "h", "size", "p", F.ceil(F.col("n_docs") / block_rows).alias("blocks"))
    settled, most = [], (targets.agg(F.max(F.ceil(F.col("n_docs") / block_rows))).first()[0] or 1)
    while True:
        flown = materialise(_fly(open_.withColumn("block", F.pmod("h", "blocks")), most == 1), "mix-flight")
        settled.append(flown.filter("p = 0 or p = 1"))
        if most == 1:
            break
        left = flown.filter("p > 0 and p < 1")
        counts = left.groupBy("source_no").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        fewer = counts.agg(F.max("blocks")).first()[0] or 1
        most = max(1, min(most - 1, fewer))
        open_ = left.join(F.broadcast(counts) if n_sources <= BROADCAST_SOURCES else counts, "source_no").withColumn("blocks", F.least("blocks", F.lit(most)))
    picked = settled[0]
    for more in settled[1:]:
        picked = picked.union(more)
    picked = picked.filter("p = 1").select("_row", F.lit(1).alias("one"))
    copies = F.col("whole") + F.coalesce("one", F.lit(0))
    return units.join(picked, "_row", "left").select(
        "id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "digest"
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, all columns."""
    copies = mix(docs, id_col, source_col, text_col)
    repeats = copies.groupBy(row_key(F.col("id"), F.col("digest")).alias("key")).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    keyed = packed(docs, key=row_key(F.col(f"`{id_col}`"), row_digest(text_or_empty(text_col))))
    # Rows that repeat id and text share the copies that were taken of them; join and numbering find them in place.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    own = F.floor(F.col("_sum") / F.col("_n")) + F.when(F.col("_nth") <= F.col("_sum") % F.col("_n"), 1).otherwise(0)
    taken = keyed.join(repeats.filter("_sum > 0"), "key").withColumn("_nth", nth).withColumn("_own", own.cast("int")).filter("_own > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_own")))))
