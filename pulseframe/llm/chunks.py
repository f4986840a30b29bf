"""Documents read together as chunks, and hash sets exchanged between chunks and buckets.

A chunk is a few megabytes of whole documents, compressed once for the shuffle. Operators
that must know whether something occurs elsewhere turn each chunk into one sorted set of
64-bit hashes, send each hash once to the bucket that owns its range, and get back a flag
in the same order. Rebuilding the set from the chunk gives the same order, whatever the
order of rows, so nothing but flags has to return and lost tasks can be run again. The
hot value of a corpus reaches its bucket once per chunk, not once per occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
LARGEST_CHUNK_BYTES = 128 << 20
#: Chunks grow once there would be more than this many, up to the largest size.
CHUNKS = 4096


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; one scan of the column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def chunk_count(total: int) -> int:
    """Number of chunks, and of buckets, for so many bytes of text."""
    return max(1, math.ceil(total / chunk_size(total)))


def chunk_size(total: int) -> int:
    """Bytes of text in a chunk, for so many in all."""
    return min(LARGEST_CHUNK_BYTES, max(CHUNK_BYTES, total // CHUNKS))


def chunked(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunk long, ids array, sizes array<long>, blob binary``: each row holds some documents that were
    read one after the other, texts as UTF-8 (null: empty) joined and compressed.

    Chunks are cut where rows are read, at about ``size`` bytes or where a batch ends, so nothing is
    shuffled for them and rows that repeat gather in none. They are numbered by task: write them
    before they are read twice.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            low = held = 0
            for row, text in enumerate(texts):
                held += len(text)
                if held >= size or row == len(texts) - 1:
                    some = texts[low : row + 1]
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column(0).slice(low, len(some)))
                    columns = [
                        pa.array([number], pa.int64()),
                        ids,
                        pa.array([[len(t) for t in some]], pa.list_(pa.int64())),
                        pa.array([press.compress(b"".join(some))], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "blob"])
                    number, low, held = number + 1, row + 1, 0

    return source.mapInArrow(packed, f"chunk long, ids array<{id_type}>, sizes array<long>, blob binary")


def unpacked(table: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """Ids and texts of a chunk's documents."""
    press = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    for sizes, blob in zip(table.column("sizes"), table.column("blob")):
        sizes = sizes.as_py()
        data = press.decompress(blob.as_py(), max_output_size=max(1, sum(sizes)))
        at = 0
        for size in sizes:
            texts.append(data[at : at + size])
            at += size
    ids = table.column("ids").combine_chunks()
    return (ids.flatten() if isinstance(ids, pa.ListArray) else pa.concat_arrays([c.flatten() for c in ids.chunks])), texts


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``bucket, start, stop`` of each bucket that has some of the sorted hashes."""
    if not len(hashes):
        return []
    owner = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1), append=owner[-1:] + np.uint64(1)))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def among(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``members``."""
    if not len(members):
        return np.zeros(len(values), bool)
    at = np.searchsorted(members, values)
    at[at == len(members)] = 0
    return members[at] == values


def merged_runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true values."""
    edges = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covering(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``length`` from one of ``starts``."""
    steps = np.zeros(total + 1, np.int32)
    steps[starts] += 1
    np.subtract.at(steps, np.minimum(starts + length, total), 1)
    return np.cumsum(steps[:-1]) > 0


def sent_hashes(chunk: int, hashes: np.ndarray, often: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """Columns ``bucket, chunk, hashes, often``: a chunk's sorted set, by the bucket that owns it."""
    blocks = by_bucket(hashes, buckets)
    return {
        "bucket": pa.array([b for b, _, _ in blocks], pa.int64()),
        "chunk": pa.array([chunk] * len(blocks), pa.int64()),
        "hashes": pa.array([hashes[s:t].tobytes() for _, s, t in blocks], pa.binary()),
        "often": pa.array([np.packbits(often[s:t]).tobytes() for _, s, t in blocks], pa.binary()),
    }


def repeated_flags(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """``chunk, bucket, flags``: for each hash sent to a bucket, whether it came more than once."""
    blocks = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("hashes")]
    often = [
        b[np.unpackbits(np.frombuffer(o.as_py(), np.uint8), count=len(b)).astype(bool)]
        for b, o in zip(blocks, table.column("often"))
    ]
    ordered = np.sort(np.concatenate(blocks))
    repeated = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *often]))
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
            "flags": pa.array([np.packbits(among(b, repeated)).tobytes() for b in blocks], pa.binary()),
        }
    )


def received_flags(answers: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The flags of a chunk's sorted set, from the answers of its buckets."""
    flagged = np.zeros(len(hashes), bool)
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist()))
    for bucket, start, stop in by_bucket(hashes, buckets):
        flagged[start:stop] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=stop - start)
    return flagged
