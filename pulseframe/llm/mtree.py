"""Exact search for the largest inner products with M-trees.

Vectors of whole numbers get one more coordinate that makes all of them equally long; then the
nearest vectors by distance are those with the largest inner products, and a metric tree finds
them. Rows are dealt by hash to trees of bounded size. A tree is a set of pages; a page has a
routing vector, a covering radius and its distance from the routing vector above, and a leaf
also the distance of each vector from its own. Search opens the page with the least possible
distance first. A page or a vector is passed over without computing its distance if the stored
distances and the triangle inequality show that it can't be near enough.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseframe.llm.components import saved

TREE_ROWS = 4096
QUERY_ROWS = 4096
LEAF = 256
FANOUT = 32


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with a last coordinate that gives all the same squared length."""
    square = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(longest - square, 0))[:, None]], axis=1)


def build(vectors: np.ndarray, longest: float, leaf: int = LEAF, fanout: int = FANOUT) -> dict:
    """Pages of a tree over the rows: for each its routing row, radius, distance from the page
    above, and either pages below or rows with their distances."""
    points = lifted(vectors.astype(float), longest)
    pages: dict[str, list] = {"center": [], "radius": [], "above": [], "below": [], "rows": [], "far": []}

    def distance(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[center]) ** 2).sum(axis=1))

    def add(rows: np.ndarray, center: int, above: float) -> int:
        far = distance(rows, center)
        page = len(pages["center"])
        for name, value in zip(pages, (center, float(far.max()), above, None, None, None)):
            pages[name].append(value)
        if len(rows) <= leaf or far.max() == 0:
            pages["rows"][page], pages["far"][page] = rows, far
            return page
        # The pivots are spread: each is the row farthest from those before it.
        pivots, nearest = [int(rows[far.argmax()])], distance(rows, int(rows[far.argmax()]))
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < fanout and nearest.max() > 0:
            pivots.append(int(rows[nearest.argmax()]))
            apart = distance(rows, pivots[-1])
            owner[apart < nearest] = len(pivots) - 1
            nearest = np.minimum(nearest, apart)
        below = []
        for i, pivot in enumerate(pivots):
            mine = rows[owner == i]
            below.append(add(mine, pivot, float(distance(np.array([pivot]), center)[0])))
        pages["below"][page] = np.array(below)
        return page

    if len(points):
        middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        add(np.arange(len(points)), middle, 0.0)
    return {k: np.array(v) if k in ("center", "radius", "above") else v for k, v in pages.items()}


def search(
    tree: dict, ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, longest: float, k: int
) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, id)``, ties to the smaller id, without the query's own id."""
    if not len(ids):
        return []
    own = float((query * query).sum())
    slack = 1e-7 * (1 + math.sqrt(longest) + math.sqrt(own))
    best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
    limit = math.inf

    def far_from(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = vectors[rows] @ query
        return scores, np.sqrt(np.maximum(own + longest - 2.0 * scores, 0))

    top = float(far_from(tree["center"][:1])[1][0])
    pages = [(max(0.0, top - tree["radius"][0]), 0, top)]
    while pages:
        least, page, apart = heapq.heappop(pages)
        if least > limit + slack:
            break
        if tree["below"][page] is not None:
            below = tree["below"][page]
            # What the distances stored say about pages below, before any is computed.
            below = below[np.abs(apart - tree["above"][below]) - tree["radius"][below] <= limit + slack]
            if len(below):
                _, far = far_from(tree["center"][below])
                for child, d in zip(below.tolist(), far.tolist()):
                    if (bound := max(0.0, d - tree["radius"][child])) <= limit + slack:
                        heapq.heappush(pages, (bound, child, d))
            continue
        rows = tree["rows"][page]
        rows = rows[np.abs(apart - tree["far"][page]) <= limit + slack]
        scores, _ = far_from(rows)
        names = ids[rows]
        if len(best) == k:
            near = scores >= best[0][0]
            scores, names = scores[near], names[near]
        for score, name in zip(scores.tolist(), names.tolist()):
            if name == query_id:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -name))
            elif (score, -name) > best[0]:
                heapq.heapreplace(best, (score, -name))
        if len(best) == k:
            limit = math.sqrt(max(0.0, own + longest - 2.0 * best[0][0]))
    return [(s, -n) for s, n in sorted(best, reverse=True)]


def top_inner_products(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    tree_rows: int = TREE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: the ``k`` largest inner products of
    each query with the rows of another id, ties to the smaller id.

    Both tables have a whole-number id and ``vector_col array<long>`` of moderate size (inner
    products below 2**53). Rows with a null id or vector, or a null in it, take no part; shorter
    vectors are filled with zeros. Queries and rows are held in blocks, and each block of queries
    meets each tree; neither grows with the tables. Equal rows are hits of their own,
    equal queries are one; an id with several vectors asks for the best of them all. Fewer rows
    give fewer hits. Trees are written to the shared folder.
    """
    whole = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    )
    vectors, queries = whole(vectors), whole(queries).distinct()
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    asked = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    trees, blocks = max(1, math.ceil(facts[0] / tree_rows)), max(1, math.ceil(asked[0] / query_rows))
    width, longest = max(facts[1] or 0, asked[1] or 0), float(facts[2] or 0)

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((table.num_rows, width), np.int64)
        for row, v in enumerate(table.column("v").to_pylist()):
            out[row, : len(v)] = v
        return table.column("id").to_numpy(), out

    def planted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, rows = matrix(table)
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        tree = pickle.dumps((build(rows, longest), ids, rows))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "pages": pa.array([tree], pa.binary())})

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "asked": pa.array([pickle.dumps(matrix(table))], pa.binary())})

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, asked in zip(batch.column(0), batch.column(1)):
                (tree, ids, rows), (names, wanted) = pickle.loads(pages.as_py()), pickle.loads(asked.as_py())
                rows = rows.astype(float)
                found = [
                    (int(name), hit, int(score))
                    for name, query in zip(names.tolist(), wanted.astype(float))
                    for score, hit in search(tree, ids, rows, name, query, longest, k)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"]
                )

    forest = vectors.withColumn("tree", F.pmod(F.xxhash64("id", "v"), F.lit(trees))).groupBy("tree")
    forest = saved(spark, forest.applyInArrow(planted, "tree long, pages binary"), "trees")
    asked_blocks = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).groupBy("block")
    asked_blocks = saved(spark, asked_blocks.applyInArrow(packed, "block long, asked binary"), "queries")
    every = forest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = every.join(asked_blocks, "block").repartition(trees * blocks, "tree", "block")
    hits = pairs.select("pages", "asked").mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
