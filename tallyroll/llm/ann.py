"""Nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most ``sample_rows`` vectors, those with the least hashes. Every
vector is then sent down to a leaf. A query keeps the nodes it has not opened in a priority queue by distance
and visits the leaves in the order in which they come up. How many leaves a query visits is calibrated: some
queries are first compared with every vector, and the visits are widened until enough of their true
neighbours lie in visited leaves. Visited leaves meet their queries in one grouped job; a leaf with many
vectors or many queries is dealt out in cells of bounded size, so each cell fits one task.

Equal vectors are one point with their ``k + 1`` least ids, cut map-side, so copies of one vector do not pile
up. Rows with a null id and vectors that are null, zero, hold null or non-finite components, or have another
length than the most frequent one take no part. Ids are identities: rows that repeat count once. Ties go to the
smaller id. Fewer candidates than ``k`` give fewer rows, an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.llm.common import stored

CELL_ROWS = 20_000
CELL_QUERIES = 2_000
SLACK = 1e-9


@dataclass
class Tree:
    """Centres of each inner node's children; a child below zero is leaf number -child - 1."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, points: np.ndarray, branching: int, leaf_rows: int, rng: np.random.Generator) -> int:
        """Cluster the points below a new node and return its number."""
        label, centre = clusters(points, branching, rng) if len(points) > leaf_rows else (None, None)
        if label is None or len(centre) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.children[node] = [self.grow(points[label == i], branching, leaf_rows, rng) for i in range(len(centre))]
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = squared(points[rows], self.centres[node]).argmin(axis=1)
            for i, child in enumerate(self.children[node]):
                own = rows[near == i]
                if child < 0:
                    out[own] = -child - 1
                elif len(own):
                    todo.append((child, own))
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, nearest unopened node first."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -node - 1
                continue
            for d, child in zip(squared(query[None], self.centres[node])[0].tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None]


def clusters(points: np.ndarray, k: int, rng: np.random.Generator, turns: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """k-means: label of each point, and the centres that have any."""
    centres = points[rng.integers(len(points))][None]
    near = squared(points, centres)[:, 0]
    while len(centres) < k and near.max() > 1e-12:
        weight = np.maximum(near, 0)
        centres = np.vstack([centres, points[rng.choice(len(points), p=weight / weight.sum())][None]])
        near = np.minimum(near, squared(points, centres[-1:])[:, 0])
    for _ in range(turns):
        label = squared(points, centres).argmin(axis=1)
        used = np.unique(label)
        centres = np.array([points[label == i].mean(axis=0) for i in used])
    label = squared(points, centres).argmin(axis=1)
    used, label = np.unique(label, return_inverse=True)
    return label, centres[used]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def matrix(column: pa.ListArray | pd.Series) -> np.ndarray:
    """Rows of a list column as doubles."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores and of all that come as near as rounding reaches."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, -k)[-k] - SLACK)


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    recall: float = 0.95,
    sample_rows: int = 20_000,
    calibration_queries: int = 200,
    branching: int = 16,
    leaf_rows: int = 200,
) -> DataFrame:
    """(query_id, rank, <id>, score) for the rows that meet ``queries``, against every other row."""
    spark, own = rows.sparkSession, k + 1
    good = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = good.filter(F.col("id").isNotNull() & usable("v"))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = length["n"] if length else 1
    key = F.concat(F.hex(F.xxhash64("v")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "v")))
    good = stored(good.filter(F.size("v") == length).withColumn("point", key), "vectors")
    by_id = Window.partitionBy("point").orderBy("id")
    points = good.withColumn("_n", F.dense_rank().over(by_id)).filter(F.col("_n") <= own)
    points = points.groupBy("point").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))
    points = stored(points, "points")

    sample = points.orderBy(F.xxhash64("point"), "point").limit(sample_rows).select("v").toPandas()["v"]
    tree = Tree()
    if len(sample):
        tree.grow(unit(matrix(sample)), branching, leaf_rows, np.random.default_rng(11))
    tree.leaves = max(1, tree.leaves)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = tree.assign(unit(matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=["point", "v", "ids", "leaf"])

    kind = points.schema["v"].dataType.simpleString()
    placed = stored(points.mapInArrow(index, f"point string, v {kind}, ids array<bigint>, leaf long"), "index")
    asked = good.filter("asks").select("point", "v").groupBy("point").agg(F.any_value("v").alias("v"))
    asked = stored(asked, "queries")

    visits = calibrated(tree, placed, asked, k, recall, calibration_queries)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = [[leaf for leaf, _ in zip(tree.best_bins(q), range(visits))] for q in unit(matrix(b.column(1)))]
                row = np.repeat(np.arange(len(b)), [len(f) for f in found])
                leaves = pa.array([leaf for f in found for leaf in f], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), leaves], names=["q", "qv", "leaf"])

    asking = stored(asked.mapInArrow(bins, f"q string, qv {kind}, leaf long"), "visits")
    # One row per leaf, at most as many as sampled vectors.
    sizes = placed.groupBy("leaf").count().withColumnRenamed("count", "n").join(asking.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")), "leaf")
    sizes = sizes.select("leaf", F.ceil(F.col("n") / CELL_ROWS).cast("long").alias("n"), F.ceil(F.col("m") / CELL_QUERIES).cast("long").alias("m"))
    sizes = F.broadcast(sizes)
    left = placed.join(sizes, "leaf").withColumns({"a": F.pmod(F.xxhash64("point"), F.col("n")), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))})
    right = asking.join(sizes, "leaf").withColumns({"b": F.pmod(F.xxhash64("q"), F.col("m")), "a": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))})
    cell = ["leaf", "a", "b"]

    def compare(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or asks.empty:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        x, y, ids = matrix(vectors["v"]), matrix(asks["qv"]), vectors["ids"].to_numpy()
        norm_x, norm_y, unit_x = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1)), unit(x)
        out = []
        for q, vec, norm in zip(asks["q"], y, norm_y):
            near = top(unit_x @ (vec / norm), own)
            score = (x[near] * vec).sum(axis=1) / (norm_x[near] * norm)
            pairs = sorted((-s, i) for s, r in zip(score.tolist(), near) for i in ids[r])
            out += [(q, i, -s) for s, i in pairs[:own]]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    found = left.select(*cell, "v", "ids").groupBy(*cell).cogroup(right.select(*cell, "q", "qv").groupBy(*cell)).applyInPandas(compare, "q string, id long, score double")
    order = [F.desc("score"), F.asc("id")]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("_n") <= own)
    found = stored(found.groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("near")), "near")
    ask_ids = good.filter("asks").select(F.col("id").alias("query_id"), "point").distinct()
    others = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    ranked = F.slice(F.array_sort(F.transform(others, lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id")))), 1, k)
    answers = ask_ids.join(found, F.col("point") == F.col("q")).select("query_id", F.posexplode(ranked).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_column), (-F.col("x.s")).alias("score"))


def calibrated(tree: Tree, placed: DataFrame, asked: DataFrame, k: int, recall: float, number: int) -> int:
    """Leaf visits that reach ``recall`` over ``number`` queries, each compared with every vector."""
    chosen = asked.orderBy(F.xxhash64("point"), "point").limit(number).toPandas()
    if chosen.empty:
        return 1
    queries, names = unit(matrix(chosen["v"])), chosen["point"].tolist()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch the best of each query; the query's own point is no neighbour."""
        for b in batches:
            if not len(b):
                continue
            scores, points, leaves = queries @ unit(matrix(b.column(1))).T, b.column(0).to_pylist(), b.column(2).to_pylist()
            out = [(i, float(scores[i, r]), points[r], leaves[r]) for i in range(len(names)) for r in top(scores[i], k + 1) if points[r] != names[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["q", "score", "point", "leaf"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("q", pa.int64()), ("score", pa.float64()), ("point", pa.string()), ("leaf", pa.int64())]))

    true = placed.select("point", "v", "leaf").mapInArrow(exact, "q long, score double, point string, leaf long")
    true = true.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "point"))).filter(F.col("_n") <= k)
    wanted = true.select("q", "leaf").collect()  # at most k rows for each chosen query
    places = [{leaf: i for i, leaf in enumerate(tree.best_bins(q))} for q in queries]
    needed = np.array([places[r["q"]][r["leaf"]] + 1 for r in wanted])
    visits = 1
    while visits < tree.leaves and len(needed) and (needed <= visits).mean() < recall:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves)
