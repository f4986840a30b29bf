"""Texts alike in four fifths of their word shingles: SimHash and MinHash bands name pairs, whole texts decide.

The shingles of a text are its distinct runs of five words; two texts link where the shared ones
are at least 0.8 of all that either has (Jaccard). Each text gets the least hash of its shingles
under 144 permutations, in 24 bands of six. Texts that agree in a band lie in one bucket: at
similarity 0.8 a pair misses all buckets with probability (1 - 0.8^6)^24 = 0.0007, above that less
often. Buckets with the same members, as most bands of a group give, count once.

SimHash fingerprints of the shingles, linked at three or fewer differing bits (:mod:`pulseframe.llm.simhash`),
name pairs first. Few pairs near 0.8 differ by so few bits, so the bands name the others.

Every text of a bucket is compared with the bucket's smallest one, which joins a group of
copies however large it is. Where the members of a bucket then lie in several components, all pairs
of different components whose signatures agree well enough are compared, block by block if the
bucket is large; only the edges of a forest leave a task. No pair of a bucket is left out for its
size. Only pairs whose whole texts reach 0.8 link, so no texts are joined on an estimate.

Equal texts are joined first, by a 64-bit hash: among n different texts n * n / 2**65 pairs are
expected to be taken as equal wrongly (0.003 for 300 million).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import simhash
from pulseframe.llm.components import components, saved

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6
SEED = 42
#: Texts of one bucket, and bytes of them, that one task compares with each other.
LARGEST_BUCKET = 512
BLOCK_BYTES = 16 << 20
#: Signatures agree in fewer places than this by chance alone at similarity 0.8: 4.5 deviations.
LEAST_ALIKE = 0.65

_random = np.random.default_rng(SEED)
_FACTORS, _TERMS, _MIXED, _PLACES = (
    _random.integers(0, 2**64 - 1, n, dtype=np.uint64) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS, SHINGLE)
)


class Words(dict):
    """Hashes of words, each made once."""

    KNOWN = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: bytes, known: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of ``shingle`` words; a shorter text is one run."""
    words = text.lower().split()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    count = len(words) - size + 1 if words else 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out += hashes[i : i + count] * _PLACES[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0  # it cannot be reached
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def signature(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least hash under each permutation."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for start in range(0, len(found), 512):
        np.minimum(least, (found[start : start + 512, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return (least >> np.uint64(20)).astype(np.uint16)


def with_signature(texts: DataFrame) -> DataFrame:
    """``node, signature binary`` for each row of ``node, text``."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            rows = [signature(shingles(column[i].as_py(), known)).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["node", "signature"])

    return texts.select("node", "text").mapInArrow(marked, "node long, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def band_keys(signed: DataFrame) -> DataFrame:
    """``key, node`` for each band of each row of ``node, signature``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = _signatures(batch.column(1)).astype(np.uint64) + np.uint64(1)
            mixed = (places * _MIXED).reshape(-1, BANDS, ROWS)
            mixed ^= mixed >> np.uint64(31)
            keys = (mixed * _FACTORS.reshape(BANDS, ROWS)).sum(axis=2, dtype=np.uint64)
            nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return signed.select("node", "signature").mapInArrow(keyed, "key long, node long")


def buckets(signed: DataFrame) -> DataFrame:
    """``key, n, least``: buckets of several nodes, with how many and the smallest; one of those alike."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"mark{n}") for n in range(2)]
    found = band_keys(signed).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), *marks).where("n > 1")
    return found.groupBy("n", "least", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "n", "least")


def worth_comparing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree well enough; each signature travels once per pair."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = (_signatures(batch.column(2)) == _signatures(batch.column(3))).mean(axis=1) >= LEAST_ALIKE
                yield batch.select([0, 1]).filter(pa.array(good))

    one = signed.select(F.col("node").alias("a"), F.col("signature").alias("one"))
    other = signed.select(F.col("node").alias("b"), F.col("signature").alias("other"))
    both = pairs.join(other, "b").join(one, "a").select("a", "b", "one", "other")
    return both.mapInArrow(kept, "a long, b long")


class Groups:
    """Sets that grow together."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, self.top = np.unique(labels, return_index=True, return_inverse=True)
        self.top = first[self.top]

    def join(self, a: int, b: int) -> None:
        self.top[self.top == self.top[b]] = self.top[a]


def block_links(
    places: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: Callable[[int], np.ndarray], similar: float
) -> list[tuple[int, int]]:
    """Rows to link so that every two rows of different labels that are similar come to hang together.

    Most alike signatures go first; rows that already hang together are not compared. Where there
    are two sides, only rows of different sides are.
    """
    pairs = []
    both = len(set(sides.tolist())) > 1
    for i in range(len(places) - 1):
        other = labels[i + 1 :] != labels[i]
        if both:
            other &= sides[i + 1 :] != sides[i]
        rest = np.flatnonzero(other) + i + 1
        alike = (places[rest] == places[i]).mean(axis=1)
        pairs += [(-x, i, j) for x, j in zip(alike.tolist(), rest.tolist()) if x >= LEAST_ALIKE]
    groups, links = Groups(labels), []
    for _, i, j in sorted(pairs):
        if groups.top[i] != groups.top[j] and similarity(sets(i), sets(j)) >= similar:
            groups.join(i, j)
            links.append((i, j))
    return links


def links_between(rows: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """``a, b``: links among the rows ``key, low, high, block, node, label, signature, text`` of each
    ``key, low, high``, whole texts compared."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        known, memory = Words(), {}
        nodes, text = rows.column(4).to_numpy(), rows.column(7).cast(pa.large_binary())

        def sets(i: int) -> np.ndarray:
            if i not in memory:
                memory[i] = shingles(text[i].as_py(), known)
            return memory[i]

        places = _signatures(rows.column(6)).astype(np.uint8)
        links = block_links(places, rows.column(5).to_numpy(), rows.column(3).to_numpy(), sets, similar)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist(), batch.num_rows]
            if held and any(held[0].column(i)[0].as_py() != keys[i][0] for i in range(3)):
                yield found(_whole(held))
                held = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                held.append(batch.slice(low, high - low))
                if high < batch.num_rows:
                    yield found(_whole(held))
                    held = []
        if held:
            yield found(_whole(held))

    order = ["key", "low", "high"]
    ordered = rows.select(*order, "block", "node", "label", "signature", "text").repartition(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(compared, "a long, b long")


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _dealt(members: DataFrame, largest_bucket: int) -> DataFrame:
    """Members of the buckets that hold several components, a row for each two blocks they are compared in."""
    several = members.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    )
    blocks = F.greatest(F.ceil(F.col("n") / largest_bucket), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    several = several.where("least != most").select("key", blocks.alias("blocks"))
    dealt = members.drop("n").join(several, "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "label")


def fingerprinted(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``a, b``: each node of ``node, text`` and the smallest that its fingerprint hangs together with,
    by the SimHash of :mod:`pulseframe.llm.simhash` over the shingles used here. Rows may repeat."""
    groups = simhash.simhash_dedup(spark, texts, "node", "text", SHINGLE)
    return groups.where("node != component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b")).distinct()


def links(
    spark: SparkSession,
    texts: DataFrame,
    largest_bucket: int = LARGEST_BUCKET,
    similar: float = SIMILARITY,
    near: DataFrame | None = None,
) -> DataFrame:
    """``a, b``: links of the distinct ``texts`` of ``node, text`` that join all nodes that the buckets let
    link, and the pairs ``near``, if given, that are similar."""
    signed = saved(spark, with_signature(texts), "signatures")
    members = saved(spark, band_keys(signed).join(buckets(signed), "key"), "buckets")
    pairs = members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    pairs, named = worth_comparing(pairs, signed), members.select("node")
    if near is not None:
        pairs = pairs.unionByName(near).distinct()
        named = named.union(near.select("a")).union(near.select("b"))
    texts = saved(spark, texts.join(named.distinct(), "node", "left_semi"), "compared")
    first = saved(spark, linked(pairs, texts, similar), "links")
    roots = components(spark, first).select(F.col("a").alias("node"), "root")
    labelled = members.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    labelled = labelled.join(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "node")
    rest = _dealt(labelled.select("key", "node", "label", "bytes"), largest_bucket).join(signed, "node").join(texts, "node")
    return first.unionByName(links_between(rest, similar))


def linked(pairs: DataFrame, texts: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` whose texts, of ``node, text``, are so similar; whole texts are compared."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, node, mine = Words(), None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ones, others = (batch.column(i).cast(pa.large_binary()) for i in (2, 3))
            good = np.zeros(len(a), bool)
            for i, x in enumerate(a.tolist()):
                if x != node:
                    node, mine = x, shingles(ones[i].as_py(), known)
                good[i] = similarity(mine, shingles(others[i].as_py(), known)) >= similar
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("one"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("other"))
    both = pairs.join(other, "b").join(one, "a").select("a", "b", "one", "other")
    return both.sortWithinPartitions("a").mapInArrow(verified, "a long, b long")


def one_of_each(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest_bucket: int = LARGEST_BUCKET
) -> DataFrame:
    """The rows of ``docs``, with their own columns, that stay: one of each component of links.

    That is the row with the smallest id (nulls come last); of rows alike in it, any one. Null
    texts count as empty, and texts without words are all alike. Extra columns stay, whatever their
    names but ``__node``, ``__id`` and ``__kept``.
    """
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__node", F.xxhash64(text))
    prints = saved(spark, marked.select(F.col(id_col).alias("id"), F.col("__node").alias("node")), "nodes")
    texts = marked.select(F.col("__node").alias("node"), text.alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    near = saved(spark, fingerprinted(spark, marked.select(F.col("__node").alias("node"), text.alias("text"))), "near")
    roots = components(spark, links(spark, texts, largest_bucket, near=near)).withColumnRenamed("a", "node")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))
    stay = (
        prints.distinct()
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min(order).alias("kept"))
        .select(F.col("kept.id").alias("__id"), F.col("kept.node").alias("__kept"))
    )
    same: Column = (F.col("__node") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__id"))
    return marked.join(stay, same).dropDuplicates(["__node", "__id"]).select(*[F.col(f"`{c}`") for c in names])
