"""SimHash fingerprints linked at a few differing bits, by fuzzy hashing with the Golay code.

The perfect binary Golay code covers every 23-bit word within distance 3 of exactly one
codeword. The indices of all codewords within distance 4 of a word (one, or six) are its
keys, and two words at distance 1 always share one: the codeword nearest to the first.

A 64-bit fingerprint is cut into five segments. If two fingerprints differ in at most three
bits, two segments agree, and of any two others one differs in at most one bit. So the keys
of a fingerprint are, for each pair of segments, the pair as it is with each Golay index of
the first and of the second remaining segment: 20 choices and about 106 keys of 38 bits,
which fingerprints share by chance once in a billion pairs. Those that share a key are
compared.

Texts with equal fingerprints are joined first, so that copies cost nothing. Keys held by
more fingerprints than one task should compare are left to another exact way: each of their
fingerprints names its neighbours at one and two bits, and all that name the same neighbour,
one of them at a single bit, differ in three bits at most from that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.components import components, saved

SHINGLE = 3
BITS = 3
SEED = 42
#: Fingerprints of one key that one task compares with each other.
LARGEST_GROUP = 2048
#: Generator polynomial of the code.
GOLAY = 0xC75
SEGMENT = 13
SEGMENTS = 5


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
        count = 1
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])
        joined = b" ".join(words)
        count = len(words) - shingle + 1
        digest = xxhash.xxh64_digest
        hashes = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), stops[shingle - 1 :].tolist())]
        )
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if count > 4096:
        ones = np.concatenate([np.bincount(table[:, i], minlength=256) @ _BITS_OF for i in range(8)])
    else:
        ones = np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """All rows and columns, and the fingerprint as a signed ``long``. A null text has none of
    the words, like an empty one: fingerprint zero. A column of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            prints = np.fromiter(
                (fingerprint(texts[i].as_py() or b"", shingle) for i in range(batch.num_rows)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField(name, LongType())]))


def golay_offsets() -> list[np.ndarray]:
    """For each of the 2048 syndromes, the words of weight 4 at most that have it."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            found[syndrome(word)].append(word)
    return [np.array(x, np.int64) for x in found]


def syndrome(word: int) -> int:
    """Remainder of the word by the generator polynomial."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def golay_indices() -> np.ndarray:
    """For each word of a segment, the indices of the codewords within distance 4; -1 fills rows of one."""
    offsets = golay_offsets()
    out = np.full((1 << SEGMENT, 6), -1, np.int64)
    for word in range(1 << SEGMENT):
        near = (word ^ offsets[syndrome(word)]) >> 11
        out[word, : len(near)] = near
    return out


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """``key long, fp long`` for each fingerprint of the column ``fp``."""
    choices = [
        (i, k, j) for i, k in combinations(range(SEGMENTS), 2) for j in [x for x in range(SEGMENTS) if x not in (i, k)][:2]
    ]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indices = golay_indices()
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(start, 4096).to_numpy()
                parts = [(fp >> (SEGMENT * i)) & ((1 << SEGMENT) - 1) for i in range(SEGMENTS)]
                # The last segment is a bit shorter; the shift has repeated the sign there.
                parts[-1] &= (1 << (64 - SEGMENT * (SEGMENTS - 1))) - 1
                for number, (i, k, j) in enumerate(choices):
                    near = indices[parts[j]]
                    alike = (number << 2 * SEGMENT | parts[i] << SEGMENT | parts[k]) << 12
                    row, _ = real = np.nonzero(near >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((alike[:, None] | near)[real]), pa.array(fp[row])], names=["key", "fp"]
                    )

    return prints.select("fp").mapInArrow(keyed, "key long, fp long")


def group_edges(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one group as their links do, at most one for each."""
    edges = []
    rest = fp.view(np.uint64)  # bits of negative numbers would be counted by absolute value
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for start in range(0, len(front), 256):
                apart = np.bitwise_count(front[start : start + 256, None] ^ rest[None, :])
                reached |= (apart <= bits).any(axis=0)
            front, rest = rest[reached], rest[~reached]
            edges += [(root.view(np.int64).item(), x) for x in front.view(np.int64).tolist()]
    return edges


def _grouped(keys: DataFrame, largest_group: int, bits: int) -> DataFrame:
    """``a, b`` for the edges within each key's rows, and ``a`` alone for the fingerprints of larger groups."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowded = None  # the key whose rows are too many to be held
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield edges_of(key[:whole], fp[:whole], crowded)
            key, fp = key[whole:], fp[whole:]
            if len(key) > largest_group or (len(key) and key[0] == crowded):
                crowded = key[0]
                yield edges_of(key, fp, crowded)
                key, fp = key[:0], fp[:0]
        yield edges_of(key, fp, crowded)

    def edges_of(key: np.ndarray, fp: np.ndarray, crowded: int | None) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
        sizes = np.diff(cuts)
        large = sizes > largest_group
        if crowded is not None:
            large |= key[cuts[:-1]] == crowded
        first = cuts[:-1][(sizes == 2) & ~large]
        near = first[np.bitwise_count((fp[first] ^ fp[first + 1]).view(np.uint64)) <= bits]
        edges = [*zip(fp[near].tolist(), fp[near + 1].tolist())]
        middle = (sizes > 2) & ~large
        for at, size in zip(cuts[:-1][middle].tolist(), sizes[middle].tolist()):
            edges += group_edges(fp[at : at + size], bits)
        edges = sorted(set(edges)) + [(x, None) for x in np.unique(fp[np.repeat(large, sizes)]).tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"]
        )

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compared, "a long, b long")


def _around(prints: DataFrame) -> DataFrame:
    """``middle, fp, apart``: every word within two bits of each fingerprint."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        flips = np.concatenate([[np.uint64(0)], single, single[i] | single[j]]).view(np.int64)
        apart = np.repeat(np.array([0, 1, 2], np.int32), [1, 64, len(i)])
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                fp = batch.column(0).slice(start, 16).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((fp[:, None] ^ flips).ravel()),
                        pa.array(np.repeat(fp, len(flips))),
                        pa.array(np.tile(apart, len(fp))),
                    ],
                    names=["middle", "fp", "apart"],
                )

    return prints.select("fp").mapInArrow(named, "middle long, fp long, apart int")


def _large_groups(prints: DataFrame) -> DataFrame:
    around = _around(prints)
    roots = (
        around.groupBy("middle")
        .agg(F.min(F.when(F.col("apart") <= 1, F.col("fp"))).alias("root"), F.count("*").alias("n"))
        .where("root IS NOT NULL AND n > 1")
    )
    return around.join(roots, "middle").where("fp != root").select(F.col("root").alias("a"), F.col("fp").alias("b")).distinct()


def fingerprint_edges(prints: DataFrame, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """``a, b``: edges that join the distinct fingerprints in ``fp`` just as all links do."""
    spark = prints.sparkSession
    # One row becomes a hundred, so rows are dealt to as many tasks as the keys need; a plain
    # repartition by fp would be taken for the one that made fp distinct and left out.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = fuzzy_keys(prints.select("fp").repartition(tasks, F.xxhash64("fp")))
    found = saved(spark, _grouped(keys, largest_group, BITS), "groups")
    return found.where("b IS NOT NULL").unionByName(_large_groups(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()))


def near_duplicate_groups(spark: SparkSession, prints: DataFrame, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """``fp, first_id``: for each fingerprint the smallest id in its component.

    ``prints`` has columns ``id`` and ``fp``; it is read twice, so pass a written table.
    Fingerprints link at three or fewer differing bits; components follow chains of links.
    Rows may repeat. Null ids count for none but share the component of their fingerprint.
    """
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(spark, fingerprint_edges(nodes, largest_group)).withColumnRenamed("a", "fp")
    nodes = nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = nodes.groupBy("root").agg(F.min("first_id").alias("first_id"))
    return nodes.select("fp", "root").join(first, "root").select("fp", "first_id", "root")


def simhash_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``id_col, fingerprint long, component_id``: one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links of three or fewer differing bits
    (null if all ids there are null). Texts without words have fingerprint zero and link
    like any other. An empty table gives no rows. Other columns are left out.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = with_fingerprint(source, "text", shingle, "fp").select("id", "fp")
    prints = saved(spark, prints, "fingerprints")
    groups = near_duplicate_groups(spark, prints)
    out = prints.join(groups, "fp")
    return out.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("first_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that stay: one of each component.

    That is the row with the smallest id (nulls come last), and of these the one with the smallest
    fingerprint; of rows alike in both, any one.
    """
    names = docs.columns
    marked = with_fingerprint(docs, text_col, SHINGLE, "__fp")
    prints = saved(spark, marked.select(F.col(id_col).alias("id"), F.col("__fp").alias("fp")), "fingerprints")
    groups = near_duplicate_groups(spark, prints)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("fp"))
    stay = (
        prints.distinct().join(groups, "fp").groupBy("root").agg(F.min(order).alias("kept")).select(
            F.col("kept.id").alias("__id"), F.col("kept.fp").alias("__kept")
        )
    )
    same: Column = (F.col("__fp") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__id"))
    return marked.join(stay, same).dropDuplicates(["__fp", "__id"]).select(*[F.col(f"`{c}`") for c in names])
