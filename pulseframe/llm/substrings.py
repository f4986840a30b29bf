"""Repeated token windows: Rabin-Karp hashes of every window, counted across the corpus.

Every window of a fixed number of words gets a 64-bit rolling hash. Each chunk of documents
sends the distinct hashes of its windows to the buckets that own them; a bucket counts them
and returns one bit per hash. Windows whose hash occurs more than once cover the words to
remove; overlapping and adjoining windows merge into maximal intervals.

Two different windows are taken as equal if their 64-bit hashes agree: among n windows that
is expected n * n / 2**65 times (0.0005 times among 135 million).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.chunks import (
    chunk_count,
    chunk_size,
    chunked,
    covering,
    merged_runs,
    mixed,
    received_flags,
    repeated_flags,
    sent_hashes,
    text_bytes,
    unpacked,
)
from pulseframe.llm.components import saved

WINDOW = 35
#: Odd, so that powers have inverses among 64-bit numbers.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 20
SPACES = b"\t\n\v\f\r "


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of the text, from prefix sums; the powers reach over the text."""
    data = np.frombuffer(text, np.uint8)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    edges = np.diff(space[data].astype(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return starts, mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


class WordHasher:
    """Word hashes of texts, a bounded slice at a time, cut where there is a space."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, in order, and the number of words of each text."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        waiting: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) >= SLICE_BYTES:
                self._some(texts, waiting, parts, counts)
                waiting, size = [], 0
                for piece in _slices(text):
                    parts.append(self._one(piece)[1])
                    counts[i] += len(parts[-1])
                continue
            waiting.append(i)
            size += len(text)
            if size >= SLICE_BYTES:
                self._some(texts, waiting, parts, counts)
                waiting, size = [], 0
        self._some(texts, waiting, parts, counts)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts

    def _one(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < len(text):
            reach = max(len(text), 2 * SLICE_BYTES)
            self.up, self.down = powers(BYTE_BASE, reach), powers(pow(BYTE_BASE, -1, 1 << 64), reach)
        return word_hashes(text, self.up, self.down)

    def _some(self, texts: list[bytes], which: list[int], parts: list[np.ndarray], counts: np.ndarray) -> None:
        if which:
            starts, hashes = self._one(b"\n".join(texts[i] for i in which))
            parts.append(hashes)
            firsts = np.cumsum([0, *(len(texts[i]) + 1 for i in which)])
            counts[which] = np.diff(np.searchsorted(starts, firsts))


def _slices(text: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(text):
        stop = at + SLICE_BYTES
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        out.append(text[at:stop])
        at = stop
    return out


def window_hashes(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window that lies in one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(len(words)) + window <= ends)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # A window is put together from runs of 1, 2, 4, ... words.
    total, taken, run, length = np.zeros(len(starts), np.uint64), 0, words, 1
    while True:
        scale = np.uint64(pow(WORD_BASE, length, 1 << 64))
        if window & length:
            total = total * scale + run[starts + taken]
            taken += length
        if 2 * length > window:
            return starts, mixed(total)
        run = run[:-length] * scale + run[length:]
        length *= 2


def _set_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    words, counts = WordHasher()(texts)
    starts, hashes = window_hashes(words, counts, window)
    distinct, index, times = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts, starts, (distinct, times), index


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that starts anywhere else too.

    Words are runs of bytes other than space, tab, newline, vertical tab, form feed and
    carriage return, unchanged. Returns one row per row of ``docs``: ``id_col, n_words long,
    n_removed long, spans array<struct<start long, stop long>>`` (maximal intervals of words)
    and ``kept_text string``, the other words joined by single spaces. Null and empty texts
    have no words; an empty table gives no rows. Rows that repeat an id or a text each count
    as a document. Other columns are left out, whatever their names. Chunks and what buckets tell
    of them are written to the shared folder, so lost executors repeat little work.
    """
    total = text_bytes(docs, text_col)
    count = chunk_count(total)
    spark = docs.sparkSession
    chunks = saved(spark, chunked(docs, chunk_size(total), id_col, text_col), "chunks")
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(row, 1)])
                _, _, (hashes, times), _ = _set_of(unpacked(table)[1], window)
                yield from pa.table(sent_hashes(table.column("chunk")[0].as_py(), hashes, times > 1, count)).to_batches()

    def removed(table: pa.Table, flags: pa.Table) -> pa.Table:
        ids, texts = unpacked(table)
        counts, starts, (hashes, _), index = _set_of(texts, window)
        flagged = received_flags(flags, hashes, count)
        gone = covering(starts[flagged[index]], window, int(counts.sum()))
        ends = np.cumsum(counts)
        n_removed, spans, kept = [], [], []
        for text, stop, n in zip(texts, ends, counts):
            mine = gone[stop - n : stop]
            words = text.split()
            n_removed.append(int(mine.sum()))
            if n_removed[-1]:
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(*merged_runs(mine))])
                words = compress(words, ~mine)
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table(
            {
                "id": ids,
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    schema = f"id {id_type}, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept_text string"
    blocks = chunks.mapInArrow(sent, "bucket long, chunk long, hashes binary, often binary")
    flags = blocks.groupBy("bucket").applyInArrow(repeated_flags, "chunk long, bucket long, flags binary")
    flags = saved(spark, flags, "flags")
    kept = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(removed, schema)
    return kept.withColumnRenamed("id", id_col)

