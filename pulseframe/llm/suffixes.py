"""Exact removal of repeated byte strings with Burrows-Wheeler transforms of bounded blocks.

A string of ``minimum`` bytes is keyed by the smallest hash among its substrings of ``ANCHOR``
bytes, which depends on nothing else. Neighbouring windows mostly share their key, so a text
falls into segments, one for each run of windows with the same key, and equal windows always
meet under one key. Equal segments count as one string with its multiplicity, and keys met only
once need no more work.

The different segments of a key go together into a block, whose transform is expanded by
:func:`pulseframe.llm.bwt.shares_prefix`: it tells which suffixes share ``minimum`` bytes. If a
key has more different segments than fit a block, as for a passage that stands in very many
places, its windows are told apart by a 64-bit hash each and counted instead, so no block grows
with the corpus. Segments also are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.bwt import shares_prefix
from pulseframe.llm.chunks import (
    CHUNKS,
    CHUNK_BYTES,
    LARGEST_CHUNK_BYTES,
    by_bucket,
    chunk_count,
    merged_runs,
    mixed,
    received_flags,
    repeated_flags,
    sent_hashes,
    text_bytes,
)
from pulseframe.llm.components import saved
from pulseframe.llm.substrings import BYTE_BASE, powers

MINIMUM = 400
ANCHOR = 200
#: Symbols of a block, and of the segments of one key.
BLOCK_SYMBOLS = 1 << 20
SLICE = 1 << 20
#: Row groups of the tables of chunks and segments, of which a reader holds one at a time.
GROUP_BYTES = 8 << 20
UNIQUE, REPEATED, SUPPLIED, CROWDED = range(4)


class Anchors:
    """Segments of the texts of a chunk."""

    def __init__(self, minimum: int, anchor: int) -> None:
        self.minimum, self.anchor = minimum, anchor
        self.up = powers(BYTE_BASE, SLICE + minimum)
        self.down = powers(pow(BYTE_BASE, -1, 1 << 64), SLICE + minimum)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Offset, bytes and which places start a window in one text, a slice at a time."""
        stops = np.cumsum(sizes)
        valid = np.zeros(len(data) + 1, np.int8)
        long = sizes >= self.minimum
        valid[(stops - sizes)[long]] += 1
        valid[(stops - self.minimum + 1)[long]] -= 1
        valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
        for low in range(0, max(0, len(data) - self.minimum + 1), SLICE):
            part = data[low : low + SLICE + self.minimum - 1]
            yield low, part, valid[low : low + len(part) - self.minimum + 1]

    def segments(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, number of windows, key and content hash of each segment, and whether its key
        stands in it more than once, so that it may repeat a window within itself."""
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)]
        for low, part, valid in self.windows(data, sizes):
            sums = self.sums(part)
            each = mixed((sums[self.anchor :] - sums[: -self.anchor]) * self.down[: len(part) - self.anchor + 1])
            width = self.minimum - self.anchor + 1
            least = _sliding_minimum(each, width)
            joined = np.zeros(len(valid) + 1, bool)
            joined[1:-1] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
            start, last = np.flatnonzero(valid & ~joined[:-1]), np.flatnonzero(valid & ~joined[1:])
            length = last - start + self.minimum
            content = (sums[start + length] - sums[start]) * self.down[start]
            content = mixed(content + mixed(length.astype(np.uint64)))
            # Smallest hashes are no longer spread evenly; mixing does that again.
            again = _stands_again(each, least, width, start, last)
            found.append((start + low, last - start + 1, mixed(~least[start]), content, again))
        return tuple(np.concatenate(x) for x in zip(*found))

    def window_hashes(self, data: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Hash of the window at each wanted place, in order."""
        found = [np.zeros(0, np.uint64)]
        for low, part, valid in self.windows(data, sizes):
            if len(at := wanted[(wanted >= low) & (wanted < low + len(valid))] - low):
                sums = self.sums(part)
                found.append(mixed((sums[at + self.minimum] - sums[at]) * self.down[at]))
        return np.concatenate(found)


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _stands_again(each: np.ndarray, least: np.ndarray, width: int, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the smallest hash of each run of windows stands at two places in it. Of two equal
    windows in a run, one place is the first of a window and another the last of one."""
    here = np.zeros(len(each), bool)
    here[: len(least)] = least == each[: len(least)]
    here[width - 1 :] |= least == each[width - 1 :]
    places = np.flatnonzero(here)
    values, rank = np.unique(each[places], return_inverse=True)
    ordered = np.sort(rank << 32 | places)
    mine = np.searchsorted(values, least[start])
    mine[mine == len(values)] = 0
    found = np.searchsorted(ordered, mine << 32 | last + width) - np.searchsorted(ordered, mine << 32 | start)
    return (found > 1) & (values[mine] == least[start]) if len(values) else np.zeros(len(start), bool)


def _array(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def _chunk_row(texts: list[bytes], anchors: Anchors) -> list[bytes]:
    data = b"".join(texts)
    start, windows, key, content, again = anchors.segments(
        np.frombuffer(data, np.uint8), np.array([len(t) for t in texts], np.int64)
    )
    _, first, pair, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((content[first], key[first]))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    small = np.int32  # a chunk is smaller than 2 GB, as a text is
    first = first[order]
    often = (times[order] > 1).astype(np.uint8) | again[first].astype(np.uint8) << 1
    parts = (start.astype(small), place[pair], key[first], content[first], windows[first].astype(small), often)
    return [zstandard.ZstdCompressor(level=3).compress(data), *(p.tobytes() for p in parts)]


PARTS = "blob starts pairs keys contents pair_windows often".split()


def _as_chunks(source: DataFrame, chunk_bytes: int, minimum: int, anchor: int) -> DataFrame:
    """Rows of ``id, text`` as chunks with their segments, without a shuffle."""
    id_type = source.schema["id"].dataType.simpleString()

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(minimum, anchor)
        base = TaskContext.get().partitionId() << 32
        number = 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            low = size = 0
            for row, text in enumerate(texts):
                size += len(text)
                if size >= chunk_bytes or row == len(texts) - 1:
                    some = texts[low : row + 1]
                    ids = batch.column(0).slice(low, len(some))
                    columns = [
                        pa.array([base + number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids),
                        pa.array([[len(t) for t in some]], pa.list_(pa.int64())),
                        *(pa.array([x], pa.binary()) for x in _chunk_row(some, anchors)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", *PARTS])
                    number, low, size = number + 1, row + 1, 0

    binaries = ", ".join(f"{p} binary" for p in PARTS)
    return source.mapInArrow(collected, f"chunk long, ids array<{id_type}>, sizes array<long>, {binaries}")


def _judged(key: tuple[pa.Scalar, ...], table: pa.Table, minimum: int) -> pa.Table:
    """``chunk, bucket, codes``: what is to be done with each segment sent to a bucket."""
    sizes = [len(c.as_py()) // 8 for c in table.column("keys")]
    join = lambda name, kind: np.concatenate([_array(c, kind) for c in table.column(name)])
    keys, contents, lengths, often = join("keys", np.uint64), join("contents", np.uint64), join("pair_windows", np.int32), join("often", np.uint8)
    chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
    order = np.lexsort((chunk, contents, keys))
    key_of = np.cumsum(np.diff(keys[order], prepend=~keys[order[:1]]) != 0) - 1
    first = np.diff(contents[order], prepend=~contents[order[:1]]) != 0
    times = np.bincount(key_of, 1 + (often[order] > 0))
    symbols = np.bincount(key_of, np.where(first, lengths[order] + minimum, 0))
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.where(
        times[key_of] < 2, UNIQUE, np.where(symbols[key_of] > BLOCK_SYMBOLS, CROWDED, np.where(first, SUPPLIED, REPEATED))
    )
    cuts = np.cumsum([0, *sizes])
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": pa.array([key[0].as_py()] * len(sizes), pa.int64()),
            "codes": pa.array([codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def _codes(answers: pa.Table, name: str, keys: np.ndarray, buckets: int) -> list[bytes]:
    by = {b: c for b, c in zip(answers.column("bucket").to_pylist(), answers.column(name).to_pylist()) if c is not None}
    return [by[b] for b, _, _ in by_bucket(keys, buckets)]


def _crowded_starts(starts: np.ndarray, windows: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    s, n = starts[crowded], windows[crowded].astype(np.int64)
    return np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())


def _shared_ranges(table: pa.Table, sent: pa.Table, minimum: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Content hash to the runs of windows that occur elsewhere too."""
    all_contents = np.concatenate([_array(c, np.uint64) for c in table.column("contents")])
    often = np.concatenate([_array(c, np.uint8) for c in table.column("often")])
    distinct, inverse = np.unique(all_contents, return_inverse=True)
    several = np.bincount(inverse, 1 + (often & 1)) > 1
    many = dict(zip(distinct.tolist(), several.tolist()))
    strings: list[tuple[int, int, bytes]] = []
    press = zstandard.ZstdDecompressor()
    for keys, contents, lengths, blob in zip(*(sent.column(c) for c in ("keys", "contents", "pair_windows", "blob"))):
        sizes = (_array(lengths, np.int32) + minimum - 1).tolist()
        data, at = press.decompress(blob.as_py(), max_output_size=max(1, sum(sizes))), 0
        for k, c, n in zip(_array(keys, np.uint64).tolist(), _array(contents, np.uint64).tolist(), sizes):
            strings.append((k, c, data[at : at + n]))
            at += n
    strings.sort(key=lambda x: x[:2])
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    block: list[tuple[int, bytes]] = []
    size = 0
    for i, (k, c, text) in enumerate(strings):
        block.append((c, text))
        size += len(text) + 1
        if i + 1 == len(strings) or strings[i + 1][0] != k:
            ahead = i + 1
            room = 0
            while ahead < len(strings) and strings[ahead][0] == strings[i + 1][0]:
                room += len(strings[ahead][2]) + 1
                ahead += 1
            if size + room > BLOCK_SYMBOLS or ahead == i + 1:
                _expand(block, minimum, many, out)
                block, size = [], 0
    return out


def _expand(block: list[tuple[int, bytes]], minimum: int, many: dict[int, bool], out: dict) -> None:
    """Symbol 1 separates strings; bytes follow from 2 on."""
    symbols = np.ones(sum(len(t) + 1 for _, t in block), np.uint16)
    at, places = 0, []
    for _, text in block:
        places.append(at)
        symbols[at : at + len(text)] = np.frombuffer(text, np.uint8)
        symbols[at : at + len(text)] += 2
        at += len(text) + 1
    shared = shares_prefix(symbols, minimum)
    for (content, text), at in zip(block, places):
        windows = len(text) - minimum + 1
        # A string met several times shares all its prefixes with its own copies.
        mine = np.ones(windows, bool) if many[content] else shared[at : at + windows]
        out[content] = merged_runs(mine)


def suffix_array_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    minimum: int = MINIMUM,
    anchor: int = ANCHOR,
    as_text: bool = False,
) -> DataFrame:
    """Removes each byte covered by a string of ``minimum`` bytes that starts anywhere else too.

    Texts are UTF-8 bytes (null: none); matches never cross documents but may lie in one.
    Strings are judged on the input. Returns one row per row of ``docs``: ``id_col, n_bytes
    long, n_removed long, spans array<struct<start long, stop long>>`` (maximal removed runs)
    and ``kept binary``, or with ``as_text`` a string that leaves out characters of which some
    bytes are removed. Rows that repeat an id or a text each count as a document. An empty
    table gives no rows. Other columns are left out, whatever their names. Chunks, segments
    and strings are written to the shared folder, so lost executors repeat little work.
    """
    total = text_bytes(docs, text_col)
    buckets = chunk_count(total)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    chunk_bytes = min(LARGEST_CHUNK_BYTES, max(CHUNK_BYTES, total // CHUNKS))
    chunks = saved(spark, _as_chunks(source, chunk_bytes, minimum, anchor), "chunks", GROUP_BYTES)

    def judged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _judged(key, table, minimum)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, contents, lengths, often in zip(*batch.columns):
                parts = [_array(keys, np.uint64), _array(contents, np.uint64), _array(lengths, np.int32), _array(often, np.uint8)]
                blocks = by_bucket(parts[0], buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in blocks], pa.int64()),
                        pa.array([chunk.as_py()] * len(blocks), pa.int64()),
                        *(pa.array([p[s:t].tobytes() for _, s, t in blocks], pa.binary()) for p in parts),
                    ],
                    names=["bucket", "chunk", "keys", "contents", "pair_windows", "often"],
                )

    def given(table: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0] for c in table.column_names}
        chunk = row["chunk"].as_py()
        keys, contents, lengths = _array(row["keys"], np.uint64), _array(row["contents"], np.uint64), _array(row["pair_windows"], np.int32)
        starts, pairs = _array(row["starts"], np.int32).astype(np.int64), _array(row["pairs"], np.int32)
        codes = np.frombuffer(b"".join(_codes(answers, "codes", keys, buckets)), np.uint8)
        sizes = np.array(row["sizes"].as_py(), np.int64)
        data = zstandard.ZstdDecompressor().decompress(row["blob"].as_py(), max_output_size=max(1, int(sizes.sum())))
        first = np.zeros(len(keys), np.int64)
        first[pairs[::-1]] = starts[::-1]
        out = {c: [] for c in ("crowded", "bucket", "chunk", "keys", "contents", "pair_windows", "blob", "hashes", "often")}
        supplied = codes == SUPPLIED
        for bucket, s, t in by_bucket(keys, buckets):
            mine = np.flatnonzero(supplied[s:t]) + s
            if len(mine):
                text = b"".join([data[first[i] : first[i] + lengths[i] + minimum - 1] for i in mine.tolist()])
                new = (False, bucket, chunk, keys[mine].tobytes(), contents[mine].tobytes(), lengths[mine].tobytes())
                for name, value in zip(out, (*new, zstandard.ZstdCompressor(level=1).compress(text), None, None)):
                    out[name].append(value)
        places = _crowded_starts(starts, lengths[pairs], codes[pairs] == CROWDED)
        hashes, times = np.unique(
            Anchors(minimum, anchor).window_hashes(np.frombuffer(data, np.uint8), sizes, places), return_counts=True
        )
        sent = sent_hashes(chunk, hashes, times > 1, buckets)
        for b, h, o in zip(*(sent[c].to_pylist() for c in ("bucket", "hashes", "often"))):
            for name, value in zip(out, (True, b, chunk, None, None, None, None, h, o)):
                out[name].append(value)
        kinds = [pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    def found(table: pa.Table, sent: pa.Table) -> pa.Table:
        ranges = _shared_ranges(table, sent, minimum) if sent.num_rows else {}
        none = (np.zeros(0, np.int64),) * 2
        out = {"chunk": [], "bucket": [], "counts": [], "lows": [], "highs": []}
        for chunk, bucket, contents in zip(*(table.column(c) for c in ("chunk", "bucket", "contents"))):
            mine = [ranges.get(c, none) for c in _array(contents, np.uint64).tolist()]
            out["chunk"].append(chunk.as_py())
            out["bucket"].append(bucket.as_py())
            out["counts"].append(np.array([len(a) for a, _ in mine], np.int32).tobytes())
            out["lows"].append(np.concatenate([none[0], *(a for a, _ in mine)]).astype(np.int32).tobytes())
            out["highs"].append(np.concatenate([none[0], *(b for _, b in mine)]).astype(np.int32).tobytes())
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0] for c in table.column_names if c != "ids"}
        keys = _array(row["keys"], np.uint64)
        starts, pairs = _array(row["starts"], np.int32).astype(np.int64), _array(row["pairs"], np.int32)
        windows = _array(row["pair_windows"], np.int32)[pairs]
        sizes = np.array(row["sizes"].as_py(), np.int64)
        data = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(row["blob"].as_py(), max_output_size=max(1, int(sizes.sum()))), np.uint8
        )
        by_kind = {k: answers.filter(pc.equal(answers.column("kind"), k)) for k in (0, 1, 2)}
        codes = np.frombuffer(b"".join(_codes(by_kind[0], "codes", keys, buckets)), np.uint8)
        read = lambda name: np.frombuffer(b"".join(_codes(by_kind[1], name, keys, buckets)), np.int32)
        counts, lows, highs = read("counts"), read("lows"), read("highs")
        offset = np.cumsum(counts) - counts
        times = counts[pairs]
        pick = np.repeat(offset[pairs] - np.cumsum(times) + times, times) + np.arange(times.sum())
        base = np.repeat(starts, times)
        steps = np.bincount(base + lows[pick], minlength=len(data) + 1)
        steps -= np.bincount(base + highs[pick] + (minimum - 1), minlength=len(data) + 1)
        places = _crowded_starts(starts, windows, codes[pairs] == CROWDED)
        if len(places):
            hashes, index = np.unique(Anchors(minimum, anchor).window_hashes(data, sizes, places), return_inverse=True)
            at = places[received_flags(by_kind[2], hashes, buckets)[index]]
            steps += np.bincount(at, minlength=len(data) + 1)
            steps -= np.bincount(at + minimum, minlength=len(data) + 1)
        gone = np.cumsum(steps[:-1]) > 0
        n_removed, spans, kept = [], [], []
        stop = 0
        for size in sizes.tolist():
            text, mine = data[stop : stop + size], gone[stop : stop + size]
            stop += size
            n_removed.append(int(mine.sum()))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(*merged_runs(mine))] if n_removed[-1] else [])
            rest = (text[~mine] if n_removed[-1] else text).tobytes()
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
        ids = table.column("ids").combine_chunks()
        return pa.table(
            {
                "id": ids.flatten() if isinstance(ids, pa.ListArray) else ids.chunk(0).flatten(),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
            }
        )

    pairs = chunks.select("chunk", "keys", "contents", "pair_windows", "often").mapInArrow(
        dealt, "bucket long, chunk long, keys binary, contents binary, pair_windows binary, often binary"
    )
    codes = saved(spark, pairs.groupBy("bucket").applyInArrow(judged, "chunk long, bucket long, codes binary"), "codes")
    sent = saved(
        spark,
        chunks.drop("ids", "often")
        .groupBy("chunk")
        .cogroup(codes.groupBy("chunk"))
        .applyInArrow(
            given,
            "crowded boolean, bucket long, chunk long, keys binary, contents binary, pair_windows binary, blob binary, "
            "hashes binary, often binary",
        ),
        "segments",
        GROUP_BYTES,
    )
    strings = sent.where("NOT crowded").select("bucket", "keys", "contents", "pair_windows", "blob")
    ranges = (
        pairs.select("bucket", "chunk", "contents", "often")
        .groupBy("bucket")
        .cogroup(strings.groupBy("bucket"))
        .applyInArrow(found, "chunk long, bucket long, counts binary, lows binary, highs binary")
    )
    flags = (
        sent.where("crowded")
        .select("bucket", "chunk", "hashes", "often")
        .groupBy("bucket")
        .applyInArrow(repeated_flags, "chunk long, bucket long, flags binary")
    )
    answers = (
        codes.withColumn("kind", F.lit(0))
        .unionByName(ranges.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(flags.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    )
    done = (
        chunks.drop("contents", "often")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            removed,
            f"id {id_type}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, "
            f"kept {'string' if as_text else 'binary'}",
        )
    )
    return done.withColumnRenamed("id", id_col)
