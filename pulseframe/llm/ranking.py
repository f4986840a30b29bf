"""Ranked lexical search by hashed max-sketches.

Every document is turned into its distinct terms with their counts, and into two sketches: arrays
of four to eight places per distinct term, where a part of each term's hash names a place and the
place keeps the greatest count that fell on it, rounded up to one of 256 levels. An impact grows
with the count, so what a sketch says of a query's term is never too little, and the lesser of the
two is closer: the sums over a batch of queries, looked up together, are upper bounds of the
scores. Documents are then scored exactly in order of falling bounds, until the bound is below the
lowest score that still counts; terms and counts of the others are never looked at.

Scores are whole numbers, so results are the same for every partitioning. Terms are told apart
by 64-bit hashes: among n different ones, n * n / 2**65 pairs are expected to be taken as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulseframe.llm.components import saved
from pulseframe.llm.wordhash import LOWER, WordHashes

TOP = 10
#: Bytes that make up terms, after A-Z are lowered: digits, letters and all beyond ASCII.
TERM_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Text, and number, of the documents that make one row of the index at most, but for one long document.
GROUP_BYTES = 1 << 18
GROUP_DOCS = 256
#: Places of a sketch per distinct term, at least.
PLACES = 4
#: Bits of a hash that the places of each sketch are taken from on.
SHIFTS = (0, 32)
#: Queries whose bounds are computed as one product, and bounds of queries that one job looks up.
QUERY_BLOCK = 256
JOB_QUERIES = 4096
JOB_TERMS = 4 << 20
#: Places looked up at once: documents times terms of a block.
CELLS = 1 << 19
#: Documents that are scored exactly before the bound is compared again.
STEP = 32
#: The levels that counts are rounded up to: all up to 127, then eight to each doubling, then any.
LEVELS = np.array([*range(128), *(math.ceil(127 * 2 ** (k / 8)) for k in range(1, 128)), 2**62], np.int64)
#: No impact is greater.
MOST = 10**6


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def _counted(texts: list[bytes], find: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms and distinct terms of each text; hash and count of each distinct term, ordered in a text by hash."""
    data = b"\n".join(texts).translate(LOWER)
    starts, _, hashes = find(data)
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    n = np.diff(np.searchsorted(starts, firsts))
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return n, np.bincount(owner[at], minlength=len(texts)), hashes[at], np.diff(at, append=len(hashes))


def sketch_sizes(distinct: np.ndarray) -> np.ndarray:
    """Powers of two, at least ``PLACES`` for each distinct term."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(PLACES * distinct, 1))).astype(np.int64)


def sketched(distinct: np.ndarray, hashes: np.ndarray, counts: np.ndarray, shift: int) -> np.ndarray:
    """A sketch of each text, one after the other: at each place the level of the greatest count."""
    sizes = sketch_sizes(distinct)
    offset = np.cumsum(sizes) - sizes
    places = np.repeat(offset, distinct) + ((hashes >> np.uint64(shift)) & np.repeat(sizes - 1, distinct).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    np.maximum.at(out, places, np.searchsorted(LEVELS, counts).astype(np.uint8))
    return out


def term_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table in the shared folder, some hundred documents to a row: their ids, numbers
    of terms, distinct terms with counts, and sketches. Every document is in it, whole."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, press = WordHashes(TERM_BYTES), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            low = size = 0
            for row, text in enumerate(texts):
                size += len(text)
                if size >= GROUP_BYTES or row + 1 - low == GROUP_DOCS or row == len(texts) - 1:
                    n, distinct, hashes, counts = _counted(texts[low : row + 1], find)
                    sketches = np.concatenate([sketched(distinct, hashes, counts, shift) for shift in SHIFTS])
                    # Counts are small and sketches mostly empty, so both shrink to little.
                    binary = [x.tobytes() for x in (distinct.astype(np.int32), hashes)]
                    binary += [press.compress(x.tobytes()) for x in (counts.astype(np.int32), sketches)]
                    columns = [
                        pa.ListArray.from_arrays(pa.array([0, row + 1 - low], pa.int32()), batch.column(0).slice(low, row + 1 - low)),
                        pa.array([n.tolist()], pa.list_(pa.int64())),
                        pa.array([int((n > 0).sum())], pa.int64()),
                        pa.array([int(n.sum())], pa.int64()),
                        *(pa.array([x], pa.binary()) for x in binary),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["ids", "n", "filled", "terms", "distinct", "hashes", "counts", "sketches"])
                    low, size = row + 1, 0

    schema = f"ids array<{kind}>, n array<long>, filled long, terms long, distinct binary, hashes binary, counts binary, sketches binary"
    return saved(spark, source.mapInArrow(indexed, schema), "terms")


@dataclass
class Queries:
    """A block of queries: their distinct terms by hash and what each term adds to each query."""

    numbers: list[int]
    terms: np.ndarray
    weights: np.ndarray  # a row for each term, a column for each query

    def __post_init__(self) -> None:
        self.single = self.weights.astype(np.float32)
        self.own = [(np.flatnonzero(w), w[w > 0]) for w in self.weights.T]

    @classmethod
    def of(cls, numbers: list[int], rows: list[dict[int, int]], weight: dict[int, int]) -> Queries:
        terms = sorted({t for row in rows for t in row if t in weight})
        place = {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(terms), len(rows)), np.int64)
        for q, row in enumerate(rows):
            for t, times in row.items():
                if t in weight:
                    weights[place[t], q] = weight[t] * times
        return cls(numbers, np.array(terms, np.uint64), weights)


class Best:
    """The highest-scoring documents met so far, for each query of a block."""

    def __init__(self, queries: int, top: int) -> None:
        self.top = top
        self.rows: list[list[tuple[int, bool, object]]] = [[] for _ in range(queries)]
        #: Lower scores no longer count; equal ones may, by a smaller id.
        self.least = np.ones(queries, np.int64)

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[query] + [(-int(s), i is None, i) for s, i in zip(scores, ids)]
        # Nulls come last and are not compared.
        rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        self.rows[query] = rows[: self.top]
        if len(rows) >= self.top:
            self.least[query] = max(1, -self.rows[query][-1][0])


class Group:
    """The documents of one row of the index."""

    def __init__(self, row: dict, filled: int, terms: int) -> None:
        self.ids = row["ids"]
        self.m = np.array([25 + 75 * n * filled // terms for n in row["n"]], np.int64)
        self.distinct = np.frombuffer(row["distinct"], np.int32).astype(np.int64)
        self.sizes = sketch_sizes(self.distinct)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        whole = lambda name, size: zstandard.ZstdDecompressor().decompress(row[name], max_output_size=max(1, int(size)))
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.counts = np.frombuffer(whole("counts", 4 * len(self.hashes)), np.int32)
        self.sketches = np.frombuffer(whole("sketches", len(SHIFTS) * self.sizes.sum()), np.uint8).reshape(len(SHIFTS), -1)
        self.stops = np.cumsum(self.distinct)

    def bounds(self, queries: Queries, docs: slice) -> np.ndarray:
        """Upper bounds of the scores of some documents and all queries, from the sketches alone."""
        offset, mask = self.offsets[docs, None], (self.sizes[docs, None] - 1).astype(np.uint64)
        levels = None
        for shift, sketch in zip(SHIFTS, self.sketches):
            here = sketch[((queries.terms >> np.uint64(shift))[None, :] & mask).astype(np.int64) + offset]
            levels = here if levels is None else np.minimum(levels, here)
        by_level = np.full((len(offset), 256), MOST, np.float32)
        by_level[:, :255] = impact(LEVELS[None, :255], self.m[docs, None])
        impacts = by_level.ravel()[levels + (np.arange(len(offset)) << 8)[:, None]]
        # Single precision is wrong by far less than a ten thousandth.
        return (impacts @ queries.single) * np.float32(1.0001)


class Exact:
    """Exact scores of some documents of a group; terms of a document are looked up when it is first asked for."""

    def __init__(self, group: Group, queries: Queries, docs: slice) -> None:
        self.group, self.queries, self.first = group, queries, docs.start
        self.impacts = np.zeros((docs.stop - docs.start, len(queries.terms)), np.int32)
        self.known = np.zeros(len(self.impacts), bool)

    def __call__(self, docs: np.ndarray, query: int) -> np.ndarray:
        """Scores of the documents at these places of the slice."""
        group = self.group
        for d in docs[~self.known[docs]].tolist():
            whole = self.first + d
            part = slice(group.stops[whole] - group.distinct[whole], group.stops[whole])
            own = group.hashes[part]
            at = np.searchsorted(self.queries.terms, own)
            at[at == len(self.queries.terms)] = 0
            has = self.queries.terms[at] == own
            self.impacts[d, at[has]] = impact(group.counts[part][has].astype(np.int64), group.m[whole])
        self.known[docs] = True
        places, weights = self.queries.own[query]
        return self.impacts[docs[:, None], places].astype(np.int64) @ weights


def search_group(group: Group, queries: Queries, best: Best) -> int:
    """Improves ``best`` by the documents of a group; returns how many pairs were scored exactly."""
    step = max(1, CELLS // len(queries.terms))
    cuts = [*range(0, len(group.m), step), len(group.m)]
    return sum(_search(group, queries, best, slice(low, high)) for low, high in zip(cuts[:-1], cuts[1:]))


def _search(group: Group, queries: Queries, best: Best, part: slice) -> int:
    bounds, exact = group.bounds(queries, part), Exact(group, queries, part)
    scored = 0
    for q in np.flatnonzero((bounds >= best.least).any(axis=0)).tolist():
        mine = bounds[:, q]
        docs = np.flatnonzero(mine >= best.least[q])
        docs = docs[np.argsort(-mine[docs], kind="stable")]
        for low in range(0, len(docs), STEP):
            some = docs[low : low + STEP]
            some = some[mine[some] >= best.least[q]]
            if not len(some):
                break  # bounds only fall from here
            scores = exact(some, q)
            scored += len(some)
            good = scores >= best.least[q]
            if good.any():
                best.add(q, scores[good], [group.ids[part.start + d] for d in some[good].tolist()])
    return scored


def _searched(blocks: list[Queries], filled: int, terms: int, top: int, id_type: pa.DataType):
    blocks = [b for b in blocks if len(b.terms)]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(b.numbers), top) for b in blocks]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                group = Group(row, filled, terms)
                for queries, found in zip(blocks, best):
                    search_group(group, queries, found)
        rows = [(b.numbers[q], -s, i) for b, f in zip(blocks, best) for q, r in enumerate(f.rows) for s, _, i in r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_type)],
            names=["query", "score", "id"],
        )

    return searched


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of the sorted term hashes occurs; the others are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                hashes = np.frombuffer(cell.as_py(), np.uint64)
                at = np.searchsorted(terms, hashes)
                at[at == len(terms)] = 0
                total += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = index.select("hashes").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {int(terms[r.term]): r.df for r in found.collect()}


def ranked_search(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``item_id_col, rank int, id_col, score long``: the ``top`` documents of each item.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z lowered. A document's
    score sums, over the item's terms with repeats, the term's weight floor(1000 ln((2N+2) /
    (2df+1))) times (10^9 tf) div (1000 tf + 8m), where m is 25 + 75 n N div L, N counts the
    documents with a term, L all their terms and n the document's. Only scores above zero count;
    equal ones stand by id, nulls last. Null and empty texts have no terms. Each row of ``docs``
    is a document, also where rows repeat; rows of ``items`` alike in id and text are one item,
    and an id with several texts gets a list for each. Empty tables give no rows. Other columns
    are left out, whatever their names.

    Items are taken in jobs of ``JOB_QUERIES``, whose distinct terms alone come to the driver; the
    index is written once and read by every job.
    """
    kinds = {"item": items.schema[item_id_col].dataType, "id": docs.schema[id_col].dataType}
    schema = f"item {kinds['item'].simpleString()}, rank int, id {kinds['id'].simpleString()}, score long"
    index = term_index(spark, docs, id_col, text_col)
    total = index.agg(F.sum("filled").alias("filled"), F.sum("terms").alias("terms")).first()
    asked = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total.terms or not size["bytes"]:
        return spark.createDataFrame([], schema).withColumnsRenamed({"item": item_id_col, "id": id_col})
    jobs = max(math.ceil(size["n"] / JOB_QUERIES), math.ceil(size["bytes"] / JOB_TERMS))
    item_type, id_type = kinds["item"].simpleString(), to_arrow_type(kinds["id"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = WordHashes(TERM_BYTES)
        for batch in batches:
            rows = [_counted([t or b""], find)[2:] for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.view(np.int64).tolist() for h, _ in rows], pa.list_(pa.int64())),
                    pa.array([c.tolist() for _, c in rows], pa.list_(pa.int64())),
                ],
                names=["item", "terms", "times"],
            )

    def one_job(job: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("text", "item"), F.lit(jobs)) == job).distinct() if jobs > 1 else asked.distinct()
        rows = mine.mapInArrow(split, f"item {item_type}, terms array<long>, times array<long>").collect()
        terms = [dict(zip(np.array(r.terms, np.int64).view(np.uint64).tolist(), r.times)) for r in rows]
        every = np.array(sorted({t for row in terms for t in row}), np.uint64)
        weight = {
            t: math.floor(1000 * math.log((2 * total.filled + 2) / (2 * df + 1)))
            for t, df in (document_frequencies(index, every) if len(every) else {}).items()
        }
        parts = [list(range(low, min(low + QUERY_BLOCK, len(rows)))) for low in range(0, len(rows), QUERY_BLOCK)]
        blocks = [Queries.of(part, [terms[q] for q in part], weight) for part in parts]
        work = _searched(blocks, total.filled, total.terms, top, id_type)
        found = index.select("ids", "n", "distinct", "hashes", "counts", "sketches").mapInArrow(
            work, f"query long, score long, id {kinds['id'].simpleString()}"
        )
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        named = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"query long, item {item_type}")
        return found.join(F.broadcast(named), "query").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")

    found = reduce(DataFrame.unionByName, [one_job(job) for job in range(jobs)])
    return found.withColumnsRenamed({"item": item_id_col, "id": id_col})


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) q GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) q
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(total.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, total GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
