"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of 64 random projections, laid one after the other, and
orders the vectors of a label by that number. Vectors that point nearly the same way agree in
the first bits, so they come to lie near each other; every vector is compared with the next
``WINDOW`` in that order. What one pass cuts apart, another with other projections brings
together; the number of passes grows with the logarithm of the table so that a pair at the
threshold is missed by all of them in a thousandth of cases (:func:`passes_for`).

Pairs are verified by their cosine where they are met, and each task keeps of them only the
edges of a forest. The union of all passes gives components. A window is bounded and a group of
near copies is not, so links are counted afterwards: two linked vectors lie in one component, and
the vectors of a component are compared with each other block by block, without a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.components import components, saved

COSINE = 0.98
#: Neighbours after it that each vector is compared with in a pass.
WINDOW = 64
#: Share of pairs at the threshold that all passes may miss where directions are spread evenly.
MISSED = 0.001
SEED = 42
#: Rows of a sort task, and vectors of a block that are compared with each other at once.
TASK_ROWS = 1 << 17
BLOCK = 1024
#: Vectors turned into one matrix at a time.
SLICE = 2048


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """How many passes leave at most ``missed`` of the pairs at the threshold unmet.

    A bit differs with probability arccos(cosine) / pi. Among so many vectors those that agree in
    the first log2(vectors / window) + 1 bits fit a window, so a pass meets a pair if these agree.
    """
    bits = 1 + max(0.0, math.log2(max(1, vectors) / window))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return max(2, math.ceil(math.log(missed) / math.log(1 - met)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def projection_keys(unit: np.ndarray, passes: int, seed: int = SEED) -> np.ndarray:
    """For each row and pass, 64 signs of random projections as a number, first sign on top."""
    dim = unit.shape[1]
    out = np.empty((len(unit), passes), np.int64)
    for n in range(passes):
        planes = np.random.default_rng([seed, n, dim]).standard_normal((dim, 64))
        bits = np.packbits(unit @ planes > 0, axis=1)
        out[:, n] = np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def window_links(unit: np.ndarray, group: np.ndarray, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, at most ``window`` apart, that reach the cosine."""
    found = [(np.zeros(0, np.int64),) * 2]
    for low in range(0, len(unit) - 1, window):
        some = unit[low : low + window]
        a, b = np.nonzero(some @ unit[low : low + 2 * window].T >= cosine)
        near = (b > a) & (b - a <= window)
        a, b = a[near] + low, b[near] + low
        same = group[a] == group[b]
        found.append((a[same], b[same]))
    return tuple(np.concatenate(x) for x in zip(*found))


def forest(a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to the first one of its component, for rows that have an edge."""
    label = np.arange(rows)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            other = np.flatnonzero(label != np.arange(rows))
            return other, label[other]
        label = new


def _keyed(passes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for low in range(0, len(rows), SLICE):
                    some = batch.take(pa.array(rows[low : low + SLICE]))
                    keys = projection_keys(_matrix(some.column(3), dim), passes)
                    for n in range(passes):
                        columns = [pa.array(np.full(some.num_rows, n, np.int32)), *some.columns, pa.array(keys[:, n])]
                        yield pa.RecordBatch.from_arrays(columns, names=["pass", "dim", "label", "node", "vector", "key"])

    return keyed


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row that changes where any of the columns does."""
    changed = np.zeros(len(columns[0]), bool)
    for column in columns:
        codes = column.dictionary_encode().indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _near(rows: pa.RecordBatch, cosine: float, window: int, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted rows ``pass, dim, label, node, vector`` whose second row is ``fresh`` or after."""
    dims, group = rows.column(1).to_numpy(), _runs([rows.column(i) for i in (0, 1, 2)])
    found = [(np.zeros(0, np.int64),) * 2]
    cuts = np.flatnonzero(np.diff(dims, prepend=-1, append=-1))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        unit = _matrix(rows.column(4).slice(low, high - low), int(dims[low]))
        a, b = window_links(unit, group[low:high], cosine, window)
        found.append((a + low, b + low))
    a, b = (np.concatenate(x) for x in zip(*found))
    return a[b >= fresh], b[b >= fresh]


def _edges(rows: pa.RecordBatch, cosine: float, window: int, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    node = rows.column(3).to_numpy()
    a, b = forest(*_near(rows, cosine, window, fresh), rows.num_rows)
    return node[a], node[b]


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0]


SORTED = ["pass", "dim", "label", "node", "vector"]


def projection_edges(
    spark: SparkSession, classes: DataFrame, vectors: int, cosine: float = COSINE, window: int = WINDOW, passes: int | None = None
) -> DataFrame:
    """``a, b``: verified links that join the nodes met in any pass.

    ``classes`` has ``dim int, label, node long, vector array``; it is read once. Rows of all
    passes are sorted in one exchange by ranges, so no label or key has to fit a task. The
    first and last rows of each range are compared across its border afterwards.
    """
    passes = passes or passes_for(vectors, cosine, window)
    kind = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    row = f"pass int, dim int, label {kind['label']}, node long, vector {kind['vector']}"
    tasks = max(1, math.ceil(vectors * passes / TASK_ROWS))
    keyed = classes.select("dim", "label", "node", "vector").mapInArrow(_keyed(passes), f"{row}, key long")
    order = ["pass", "dim", "label", "key", "node"]
    ranged = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*SORTED)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        first: list[pa.RecordBatch] = []
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < window:
                first.append(batch.slice(0, window - seen))
            seen += batch.num_rows
            fresh = held.num_rows if held else 0
            rows = _joined([held, batch]) if held else batch
            a, b = _edges(rows, cosine, window, fresh)
            if len(a):
                yield edge_rows(rows.schema, a, b)
            held = rows.slice(max(0, rows.num_rows - window))
        if held:
            yield border_rows(_joined(first), part - 1, 1)
            yield border_rows(held, part, 0)

    names = ["a", "b", "border", "side", "place", *SORTED]

    def edge_rows(schema: pa.Schema, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), *(schema.field(i).type for i in range(5)))]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=names)

    def border_rows(rows: pa.RecordBatch, border: int, side: int) -> pa.RecordBatch:
        n = rows.num_rows
        own = [pa.array(np.full(n, border, np.int64)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *own, *rows.columns], names=names)

    found = saved(spark, ranged.mapInArrow(compared, f"a long, b long, border long, side int, place int, {row}"), "passes")

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("place", "ascending")])
        fresh = int((table.column("side").to_numpy() == 0).sum())
        a, b = _edges(_joined(table.select(SORTED).to_batches()), cosine, window, fresh) if fresh < table.num_rows else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    borders = found.where("border IS NOT NULL").groupBy("border").applyInArrow(across, "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(borders)


def link_counts(spark: SparkSession, members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``node, n``: for each node the rows of other nodes of its component that it links with.

    ``members`` has ``root, node, copies long, dim int, vector``. A component is dealt into blocks
    of about ``block`` nodes, and each block is compared with itself and with every later one. No
    pair leaves a task: out come one count per node and pair of blocks.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # Another seed than that of the exchange, or a block's rows would gather by it.
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("root", "blocks", "block", "dim").agg(F.collect_list(F.struct("node", "copies", "vector")).alias("rows"))
    blocks = saved(spark, blocks, "blocks")

    def parts(cell: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, copies, vector = cell.flatten()
        return node.to_numpy(), copies.to_numpy(), _matrix(vector, dim)

    def of_rows(column: pa.Array, i: int) -> pa.StructArray:
        return column.slice(i, 1).flatten()

    def counted(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["node", "n"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2]
            for i, dim in enumerate(batch.column(0).to_pylist()):
                node, copies, unit = parts(of_rows(batch.column(1), i), dim)
                near = unit @ unit.T >= cosine
                np.fill_diagonal(near, False)
                out.append((node, near @ copies))
            yield counted(out)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2]
            for i, dim in enumerate(batch.column(0).to_pylist()):
                one, other = (parts(of_rows(batch.column(k), i), dim) for k in (1, 2))
                near = one[2] @ other[2].T >= cosine
                out += [(one[0], near @ other[1]), (other[0], near.T @ one[1])]
            yield counted(out)

    own = blocks.select("dim", "rows").mapInArrow(inside, "node long, n long")
    later = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))
    asked = blocks.where("block < blocks - 1").select("root", "dim", "rows", later.alias("block"))
    other = blocks.where("block > 0").select("root", "block", "dim", F.col("rows").alias("others"))
    met = asked.join(other, ["root", "block", "dim"]).select("dim", "rows", "others").mapInArrow(between, "node long, n long")
    return own.unionByName(met).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(
    spark: SparkSession,
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """``id_col, n_links long, component_id, kept boolean``: one row for each row of ``table``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine
    is ``cosine`` or more. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest id reachable by links, its own included (null if all are null), and ``kept`` tells
    whether that is the row's own id. A vector that is null, empty, zero, or holds a null or a
    component that is not finite links with nothing, nor does one without label. Rows may
    repeat: equal vectors of a label link and are compared once. An empty table gives no rows.
    Other columns are left out, whatever their names.
    """
    source = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    # 128 bits name a vector of a label; the second half is null for rows that take no part.
    marked = source.withColumns(
        {
            "mark": F.when(usable, F.xxhash64("label", "vector")).otherwise(F.xxhash64(F.lit(1), "id")),
            "more": F.when(usable, F.xxhash64(F.lit(2), "vector", "label")),
        }
    )
    kept = marked.where(F.col("more").isNotNull()).groupBy("mark", "more", "label", "vector")
    kept = kept.agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = saved(
        spark, kept.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}), "classes"
    )
    edges = projection_edges(spark, classes, classes.count(), cosine, window)
    roots = saved(spark, components(spark, edges).withColumnRenamed("a", "node"), "roots")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
    members = classes.join(roots, "node")
    counts = link_counts(spark, members.select("root", "node", "copies", "dim", "vector"), cosine, block)
    first = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = members.select("node", "root").join(counts, "node").join(first, "root").select("node", "n", "component_id")
    # Of all vectors only those with a copy or a link have more to tell than their own id.
    told = (
        classes.select("node", "mark", "more", "copies", "first_id")
        .join(linked, "node", "left")
        .where("copies > 1 OR n IS NOT NULL")
        .select(
            "mark",
            "more",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.when(F.col("n").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.lit(True).alias("told"),
        )
    )
    out = marked.select("id", "mark", "more").join(told, ["mark", "more"], "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM e WHERE sqrt(list_inner_product(v, v)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
