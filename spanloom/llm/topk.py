"""Exact top-k by inner product: cover trees over queries and data, searched together."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.shared import small_batches, written

#: Distinct vectors of one data block and of one query block; blocks are what one tree holds.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Points below which a node is not divided further.
LEAF = 192


class CoverTree:
    """Nodes around points: each holds a centre, the radius that covers its points, and children around far points.

    A node of more than ``LEAF`` points is divided by centres that are more than half its radius apart, each point going to
    its nearest centre; so radii fall from level to level as in a cover tree.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.centre, self.radius, self.children, self.members = [], [], [], []
        self.build(np.arange(len(points)))

    def build(self, own: np.ndarray) -> int:
        node, x = len(self.centre), self.points[own]
        centre = x.mean(axis=0)
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        radius = float(far.max()) if len(own) else 0.0
        self.centre.append(centre), self.radius.append(radius), self.children.append([]), self.members.append(own)
        if len(own) <= LEAF or radius == 0:
            return node
        near, label, heads = np.full(len(own), np.inf), np.zeros(len(own), dtype=np.int64), 0
        at = int(far.argmax())
        while heads < 16 and (heads < 2 or near[at] > radius / 2):
            d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
            label[d < near], heads = heads, heads + 1
            near = np.minimum(near, d)
            at = int(near.argmax())
        groups = [own[label == i] for i in range(heads)]
        if max(map(len, groups)) == len(own):
            return node
        self.children[node] = [self.build(g) for g in groups if len(g)]
        return node


def bound(q: CoverTree, a: int, d: CoverTree, b: int) -> float:
    """No point below ``a`` has a greater inner product with a point below ``b``."""
    x, y = q.centre[a], d.centre[b]
    return float(x @ y + q.radius[a] * np.sqrt(y @ y) + d.radius[b] * np.sqrt(x @ x) + q.radius[a] * d.radius[b])


def search(queries: np.ndarray, data: np.ndarray, ids: list[np.ndarray], k: int, worst: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each query's k best (score, id) among the data; only those that can enter the best, ties to the smaller id.

    ``worst`` holds scores below which a query needs nothing. Both trees are walked together, the most promising pair
    first: a pair of nodes is dropped if its bound is below the worst kth score of the query node's points.

    The data's entries, one for each id, are numbered in order of id, so ``score * entries - number`` orders by score
    and then by id in one number. Where that could pass 2 ** 53, Python's integers take the place of doubles.
    """
    owner = np.repeat(np.arange(len(data)), [len(x) for x in ids])
    flat = np.concatenate(ids)
    order = np.argsort(flat, kind="stable")
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.arange(len(flat))
    at = np.split(number, np.cumsum([len(x) for x in ids])[:-1])
    widest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    exact = np.float64 if (widest + 1) * len(flat) < 2 ** 53 else object
    qs, ds = queries.astype(exact), data.astype(exact)
    qt, dt = CoverTree(queries), CoverTree(data)
    kth = worst.astype(np.float64).copy()
    best = np.full((len(queries), k), -np.inf)
    best = best.astype(object) if exact is object else best
    n, pending = len(flat), [(0, 0)]
    while pending:
        a, b = pending.pop()
        own = qt.members[a]
        if bound(qt, a, dt, b) * (1 + 1e-9) + 1e-6 < kth[own].min():
            continue
        ca, cb = qt.children[a], dt.children[b]
        if ca or cb:
            pairs = [(c, b) for c in ca] if ca and (not cb or qt.radius[a] >= dt.radius[b]) else [(a, c) for c in cb]
            pending += sorted(pairs, key=lambda p: bound(qt, p[0], dt, p[1]))
            continue
        scores = qs[own] @ ds[dt.members[b]].T
        rows = np.flatnonzero(scores.max(axis=1) >= kth[own])
        if not len(rows):
            continue
        entries = [at[m] for m in dt.members[b]]
        keys = np.repeat(scores[rows], [len(x) for x in entries], axis=1) * n - np.concatenate(entries).astype(exact)
        both = np.concatenate([best[own[rows]], keys], axis=1)
        both = -np.sort(-both, axis=1)[:, :k] if exact is object else -np.partition(-both, k - 1, axis=1)[:, :k]
        best[own[rows]] = both
        least = both.min(axis=1)
        kth[own[rows]] = np.maximum(kth[own[rows]], [-np.inf if x == -np.inf else float(-(-int(x) // n)) for x in least])
    out = []
    for row in best:
        whole = sorted((int(x) for x in row if x != -np.inf), reverse=True)
        scores = [-(-x // n) for x in whole]
        out.append([(-s, int(flat[order[s * n - x]])) for s, x in zip(scores, whole)])
    return out


def quantised(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) for every component as double; vectors with a null or non-finite component are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    good = F.col(column).isNotNull() & ~F.exists(F.col("x"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.withColumn("x", x).filter(good).select(F.col("vec_id").cast("long"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _least(rows: DataFrame, keys: list[str], k: int, order: list) -> DataFrame:
    """The k first rows of each key; the window's limit applies before the shuffle too."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def top_k(vectors: DataFrame, column: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k other rows with the
    greatest integer inner product of the quantised vectors; ties go to the smaller vec_id.

    Equal vectors are one point that carries its k + 1 smallest ids, and equal query vectors are searched once for
    their k + 1 best; each query row then leaves itself out. So a vector that a third of all rows share is one point.
    Points are dealt to blocks by a hash; every query block meets every data block, each pair in a task of its own as
    two cover trees. A first round meets one data block for each query block and gives each query's kth score so far, by
    which the other pairs prune.

    Vectors that are null, or hold null or non-finite components, take no part; those of different lengths never meet; a
    null vec_id takes no part. Rows repeating a vec_id are one row if their vectors are equal; a query leaves out all rows of
    its id. Fewer than k others give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = written(quantised(vectors, column, scale).filter("vec_id is not null").withColumn("point", F.sha2(F.array_join("v", ","), 256)))
    slim = rows.select("point", "vec_id").distinct()
    dealt = _least(slim.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))), ["point", "part"], k + 1, ["vec_id"])
    ids = _least(dealt.drop("part"), ["point"], k + 1, ["vec_id"]).groupBy("point").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    each = rows.groupBy("point").agg(F.first("v").alias("v"))
    points = written(each.join(ids, "point"), slim=True)
    asked = slim.filter(F.col("vec_id") % every == 0)
    queries = written(asked.select("point").distinct().join(each, "point"), slim=True)
    blocks = max(1, -(-points.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    data = points.select(F.pmod(F.xxhash64("point"), F.lit(blocks)).alias("block"), "point", "v", "ids")
    wanted = queries.select(F.pmod(F.xxhash64("point"), F.lit(query_blocks)).alias("query_block"), "point", "v")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for size in sorted(set(left["v"].map(len)) & set(right["v"].map(len))):
                q, d = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
                got = search(np.stack(q["v"].to_numpy()).astype(np.int64).reshape(len(q), size), np.stack(d["v"].to_numpy()).astype(np.int64).reshape(len(d), size),
                             list(d["ids"]), k + 1, q["worst"].to_numpy())
                out += [(p, i, -s) for p, found in zip(q["point"], got) for s, i in found]
        return pd.DataFrame(out, columns=["point", "vec_id", "score"]).astype({"vec_id": "int64", "score": "int64"})

    def meet(left, right):
        return left.groupBy("query_block", "block").cogroup(right.groupBy("query_block", "block")).applyInPandas(run, "point string, vec_id long, score long")

    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    every_query = F.sequence(F.lit(0), F.lit(query_blocks - 1))
    own = F.pmod("query_block", F.lit(blocks))
    none = F.lit(-1.0e300).alias("worst")
    first = written(meet(wanted.select("query_block", own.cast("long").alias("block"), "point", "v", none),
                         data.select(F.explode(F.filter(every_query.cast("array<long>"), lambda q: F.pmod(q, F.lit(blocks)) == F.col("block"))).alias("query_block"), F.col("block").cast("long"), "point", "v", "ids")))
    so_far = first.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    left = wanted.join(so_far, "point", "left").select("query_block", "point", "v", F.when(F.col("n") > k, F.col("least").cast("double")).otherwise(none).alias("worst"), F.explode(every_block.cast("array<long>")).alias("block"))
    right = data.select(F.explode(every_query.cast("array<long>")).alias("query_block"), F.col("block").cast("long"), "point", "v", "ids")
    rest = meet(left.filter(F.col("block") != own), right.filter(F.col("block") != own))
    best = _least(first.unionAll(rest), ["point"], k + 1, [F.desc("score"), "vec_id"])
    gathered = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("best"))
    mine = F.slice(F.filter("best", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    answers = asked.withColumnRenamed("vec_id", "query_id").join(written(gathered, slim=True), "point")
    return answers.select("query_id", F.posexplode(mine).alias("place", "s")).select("query_id", (F.col("place") + 1).alias("rank"), "s.vec_id", (-F.col("s.neg")).alias("score"))
