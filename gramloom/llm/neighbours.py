"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Equal vectors are one point, with the ids of its smallest ``K`` + 1 rows, which is all that any query can
return. Vectors get one more component that gives all the same norm, so the largest inner product is the
nearest point. A tree parts its points at the median along the difference of two random ones, down to
leaves of ``LEAF`` points. The trees are fitted on the driver to at most ``SAMPLE`` points (the ones with
the smallest hash, a bound that doesn't grow with the input), and every point is then filed in a leaf of each
tree.

A query walks all trees with one priority queue: the leaf whose path left the query's side by the
smallest margin comes next, whichever tree it is in. How many leaves a query visits is chosen at the fit: the
fewest for which sample queries find ``RECALL`` of their true neighbours in the sample. The points in
these leaves are scored exactly, in double precision from left to right, where they are filed: a group has about
``SHARD_POINTS`` points of one tree's leaves and a block of the queries that visit them, and gives each query's best
only. Leaves that outgrow a shard are dealt over several, and so are the queries, so neither the points nor
the queries of a group grow with the input; scores are computed for ``SLICE`` queries at a time. The number of
scores is a share of points times queries that the data decide: where vectors have no structure, no search by
leaves finds nine tenths of the neighbours without visiting a large part of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without
vec_id, take no part, neither do vectors of another length than most (the shorter of two equally
frequent ones counts); repeated rows are rows of their own, except that a query leaves out all rows with
its own vec_id; an empty table gives an empty result; extra columns are ignored. Ties go to the smaller
vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Store, lookup_join, table

K, EVERY, TREES, LEAF, SAMPLE, RECALL, SHARD_POINTS, SHARD_QUERIES, SLICE, PROBES = 20, 20, 16, 128, 32_768, 0.95, 20_000, 20_000, 256, 200


@dataclass
class Tree:
    """Inner nodes; a child below 0 is leaf ~child."""

    directions: np.ndarray
    medians: np.ndarray
    children: np.ndarray
    root: int
    leaves: int

    def file(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.full(len(points), self.root, np.int64)
        while len(todo := np.flatnonzero(at >= 0)):
            for k in np.unique(at[todo]):
                own = todo[at[todo] == k]
                at[own] = self.children[k][(points[own] @ self.directions[k] >= self.medians[k]).astype(int)]
        return ~at


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    directions, medians, children, leaves = [], [], [], 0

    def part(own: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(8):
            a, b = points[rng.choice(own, 2, replace=False)]
            d = a - b
            if not (norm := np.linalg.norm(d)):
                continue
            along = points[own] @ (d / norm)
            middle = np.median(along)
            right = along >= middle
            if right.any() and not right.all():
                return d / norm, middle, right
        return None

    def node(own: np.ndarray) -> int:
        nonlocal leaves
        found = part(own) if len(own) > leaf else None
        if found is None:
            leaves += 1
            return ~(leaves - 1)
        k = len(directions)
        directions.append(found[0])
        medians.append(found[1])
        children.append((0, 0))
        children[k] = (node(own[~found[2]]), node(own[found[2]]))
        return k

    root = node(np.arange(len(points)))
    return Tree(np.array(directions).reshape(-1, points.shape[1]), np.array(medians), np.array(children, np.int64).reshape(-1, 2), root, leaves)


def visit(forest: list[Tree], query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that a query visits, best first, from one queue for all trees."""
    margins = [(t.directions @ query - t.medians).tolist() for t in forest]
    children = [t.children for t in forest]
    queue, found = [(0.0, i, t.root) for i, t in enumerate(forest)], []
    while queue and len(found) < leaves:
        far, i, k = heapq.heappop(queue)
        while k >= 0:
            m = margins[i][k]
            left, right = children[i][k]
            near, other = (right, left) if m >= 0 else (left, right)
            heapq.heappush(queue, (max(far, abs(m)), i, int(other)))
            k = int(near)
        found.append((i, ~k))
    return found


def fit(sample: np.ndarray, k: int, trees: int, leaf: int, recall: float, seed: int = 7) -> tuple[list[Tree], int]:
    """A forest and the number of leaves to visit; the sample's points have the added component."""
    rng = np.random.default_rng(seed)
    forest = [grow(sample, leaf, rng) for _ in range(trees)]
    filed = [t.file(sample) for t in forest]
    probes = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
    most = sum(t.leaves for t in forest)
    ranks = []  # of the visits at which the true neighbours are found
    for p in probes:
        q = sample[p].copy()
        q[-1] = 0.0
        scores = sample @ q
        scores[p] = -np.inf
        true = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        order = {x: n for n, x in enumerate(visit(forest, q, most))}
        ranks += [min(order[i, int(f[x])] for i, f in enumerate(filed)) for x in true]
    return forest, (int(np.quantile(ranks, recall)) + 1 if ranks else most)


def nearest(rows: DataFrame, store: Store, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    spark = rows.sparkSession
    v = F.col("v")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = store.keep(given.filter(F.coalesce(sound, F.lit(False))), "vectors")
    sizes = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return given.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, total = sizes["d"], sizes["n"]
    given = given.filter(F.size("v") == dim)
    # a point is named by its smallest id; a third of all rows may be one point, so each task passes on k + 1 ids only
    first = given.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    points = store.keep(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    n_points = points.count()
    some = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("v").toArrow().column(0).combine_chunks()
    some = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = float(points.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, norm**2 - (x * x).sum(1, keepdims=True)))])

    forest, leaves = fit(lifted(some), k, trees, leaf, recall)
    per_shard = [max(1, int(np.ceil(t.leaves / max(1.0, n_points / SHARD_POINTS)))) for t in forest]
    shared = spark.sparkContext.broadcast((forest, leaves, per_shard))  # bounded by the sample
    # a leaf's points may be more than a shard's, and all queries may visit one shard
    deal = max(1, -(-n_points // (SHARD_POINTS * min(t.leaves for t in forest))))
    # each distinct query asks once, for one more than k, as its own row is among them
    asked = store.keep(_named(given, points, every, total), "asked")
    queries = store.keep(points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "v"), "queries")
    blocks = max(1, -(-queries.count() // SHARD_QUERIES))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _, per = shared.value
        for batch in batches:
            for i, t in enumerate(forest):
                at = t.file(lifted(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at // per[i]), pa.array(at), batch.column(0), batch.column(1)], ["tree", "shard", "leaf", "point", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, leaves, per = shared.value
        for batch in batches:
            out: dict[tuple[int, int], dict[int, list[int]]] = {}
            x = matrix(batch.column(1))
            lift = np.hstack([x, np.zeros((len(x), 1))])
            for n in range(len(x)):
                for i, f in visit(forest, lift[n], leaves):
                    out.setdefault((i, f // per[i]), {}).setdefault(n, []).append(f)
            rows = [(i, s, n, f) for (i, s), q in out.items() for n, f in q.items()]
            where = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), batch.column(0).take(where), batch.column(1).take(where), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["tree", "shard", "point", "v", "leaves"])

    index = points.select("point", "v").mapInArrow(file, "tree long, shard long, leaf long, point long, v array<double>")
    asks = queries.mapInArrow(ask, "tree long, shard long, point long, v array<double>, leaves array<bigint>")
    part = lambda n, salt: F.pmod(F.xxhash64("point", F.lit(salt)), F.lit(n)).cast("int")
    every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["tree", "shard"]
    if deal > 1 or blocks > 1:
        keys += ["part", "block"]
        index = index.withColumn("part", part(deal, 1)).withColumn("block", every_(blocks))
        asks = asks.withColumn("block", part(blocks, 2)).withColumn("part", every_(deal))

    def meet(key: tuple, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.empty(0, np.int64), "point": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(have) or not len(want):
            return empty
        have = have.sort_values(["leaf", "point"], kind="stable")
        x, q, name = np.stack(have.v.to_numpy()), np.stack(want.v.to_numpy()), have.point.to_numpy()
        names, begin = np.unique(have.leaf.to_numpy(), return_index=True)
        begin = dict(zip(names.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(have)])))
        out = []
        for n, leaves in enumerate(want.leaves):
            if n % SLICE == 0:
                near = x @ q[n : n + SLICE].T
            at = np.concatenate([np.arange(*begin[f]) for f in leaves if f in begin] or [np.empty(0, np.int64)]).astype(np.int64)
            if len(at) > 2 * k + 2:  # a margin over the k + 1 that count, for rounding
                at = at[np.argpartition(-near[at, n % SLICE], 2 * k + 1)[: 2 * k + 2]]
            score = np.add.accumulate(x[at] * q[n], axis=1)[:, -1]
            best = np.lexsort((name[at], -score))[: k + 1]
            out.append((np.full(len(best), want.point.iloc[n]), name[at][best], score[best]))
        return pd.DataFrame(dict(zip(("query", "point", "score"), (np.concatenate(c) for c in zip(*out)))))

    groups = sum(-(-t.leaves // n) for t, n in zip(forest, per_shard)) * deal * blocks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 4)
    index, asks = (x.repartition(tasks, *keys) for x in (index, asks))
    found = store.keep(index.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "query long, point long, score double"), "found")
    # a point has the same score in every tree
    best = found.dropDuplicates(["query", "point"]).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))).filter(F.col("r") <= k + 1)
    ids = best.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = ids.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy(F.col("query").alias("point")).agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    lists = store.keep(lists.join(asked.groupBy("point").agg(F.count("*").alias("asks")), "point"), "lists")
    store.only("asked", "lists")
    out = lookup_join(asked, lists, ["point"], "asks", asked.count())
    out = out.withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k))
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _named(given: DataFrame, points: DataFrame, every: int, total: int) -> DataFrame:
    """(vec_id, point) of the queries."""
    asks = given.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    count = asks.groupBy("v").agg(F.count("*").alias("asks"))
    return lookup_join(asks, points.select("v", "point").join(count, "v"), ["v"], "asks", total).select("vec_id", "point")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of ``embeddings``, among all."""
    return nearest(table(spark, sf_dir, "embeddings"), Store(spark, "neighbours"))
