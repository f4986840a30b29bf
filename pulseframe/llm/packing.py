"""Best-fit packing: documents as token pieces, pieces into sequences of bounded length.

Tokens are made once per document; only piece lengths move. Pieces are dealt by hash to
groups of a fixed expected size, so the number of groups grows with the input, and each
group is packed by bounded-space online best-fit: a fixed number of open bins, held in a
bitset keyed by free space. A piece goes to the bin with the least free space that takes
it. If none does and all bins are in use, the fullest closes and a new one opens.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 1024
#: Documents whose pieces are packed together, on average.
GROUP_DOCUMENTS = 16_384
#: A task's table of encoded words is set back at this size to those met since the last time.
KNOWN_WORDS = 400_000
LONGEST_KNOWN_WORD = 64
#: Texts whose new words are encoded together.
TEXTS = 256
#: Words in a line; the tokenizer takes more than twice the time for twice as long a line.
LINE_WORDS = 64
WORD_END = "</w>"
#: Marks at the end of a word that follow a letter or digit. Begun with a mark, it takes half the time.
END_MARKS = re.compile(rb"[.,!?;:*$%&#](?<=[A-Za-z0-9].)[.,!?;:*$%&#]*(?![^ \t-\r])")


@cache
def _tokenizer(path: str) -> tuple:
    """The tokenizer and which of its ids end a word, loaded once by a worker for all its tasks."""
    # The tasks of an executor share its cores already; threads would each keep memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
    return tokenizer, ends


class _Words(dict):
    """Word bytes to their ids as little-endian 32-bit numbers, filled on demand."""

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        tokenizer, self.ends = _tokenizer(tokenizer_path)
        self.encode, self.encode_batch = tokenizer.encode, tokenizer.encode_batch_fast

    def __missing__(self, word: bytes) -> bytes:
        packed = np.array(self.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_KNOWN_WORD:
            self[word] = packed
        return packed

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. New words that are letters throughout are encoded in lines:
        each is one word to the tokenizer too, and only its last id marks a word's end."""
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        words = [_plain(text).split() for text in texts]
        new = {w for w in set().union(*words) if w not in self}
        # The older table is far larger than a batch of new words: it must not be gone through.
        self.update((w, self.older[w]) for w in [w for w in new if w in self.older])
        simple, others = [], []
        for w in new:
            if len(w) <= LONGEST_KNOWN_WORD and w not in self.older:
                (simple if _letters(w) else others).append(w)
        if others:
            found = self.encode_batch([w.decode() for w in others], add_special_tokens=False)
            self.update((w, np.array(one.ids, "<u4").tobytes()) for w, one in zip(others, found, strict=True))
        if simple:
            lines = [b" ".join(simple[i : i + LINE_WORDS]).decode() for i in range(0, len(simple), LINE_WORDS)]
            found = self.encode_batch(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(line.ids, "<u4") for line in found])
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            self.update(zip(simple, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        return [b"".join(map(self.__getitem__, w)) for w in words]


def _plain(text: bytes) -> bytes:
    """The text with the same ids but fewer words: capitals lowered, and marks at the end of a
    word set apart. Left alone are texts with special tokens, and capitals where one of them
    may take an accent that stands behind it."""
    if b"<|" in text:
        return text
    if b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return END_MARKS.sub(rb" \g<0>", text)


def _letters(word: bytes) -> bool:
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and max(text) <= "\xff"


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Each document's ids followed by ``end_id``, cut into pieces of ``capacity`` ids.

    Returns ``id_col, piece int, start long, length long, ids_crc32 long`` and, if asked,
    ``ids array<int>``; other columns are left out, whatever their names. Null and empty
    texts are the single id ``end_id``. Repeated rows and ids give their pieces each time.

    The tokenizer must lower-case, drop white space, split letters from marks and end words
    with ``</w>``; then a text's ids are those of its words, each encoded once per task.
    The path must exist on every executor.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            some = (texts.slice(i, TEXTS).to_pylist() for i in range(0, len(texts), TEXTS))
            groups = (words.packed([text or b"" for text in part]) for part in some)
            for row, packed in enumerate(chain.from_iterable(groups)):
                packed += end
                for number, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    owner.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").tolist())
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    made = source.mapInArrow(pieces, schema + (", ids array<int>" if with_ids else ""))
    return made.withColumnRenamed("id", id_col)


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin number and offset of each length, in order of arrival."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = opened = in_use = 0
    bins, offsets = [], []
    for length in lengths:
        if length > capacity:
            raise ValueError(f"a length of {length} exceeds the capacity of {capacity}")
        fitting = bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if in_use == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                in_use -= 1
            chosen, free = opened, capacity
            opened += 1
            in_use += 1
        bins.append(chosen)
        offsets.append(capacity - free)
        free -= length
        if free:
            by_free[free].append(chosen)
            bits |= 1 << free
        else:
            in_use -= 1
    return bins, offsets


def pack(
    items: DataFrame,
    expected_items: int,
    length_col: str = "length",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group_items: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """Adds ``sequence_id long`` and ``offset long`` to items of known lengths.

    ``expected_items``, how many items shorter than ``capacity`` there are at most, sets the number of
    groups, one for every ``group_items``. Items as long as ``capacity`` fill a sequence of their own
    and join no group. Groups are dealt by a hash of the row and its place, so rows that repeat are
    spread, too; within a group items arrive in the order of a hash over all their columns. Offsets
    leave no gap. A null or negative length counts as 0; one above ``capacity`` fails. An empty table
    gives no rows. Columns already named ``sequence_id`` or ``offset`` are replaced.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    groups = max(1, math.ceil(expected_items / group_items))
    placed = items.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("item"),
        F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("length"),
        F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("arrival"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn(
        # A full item gets a negative number of its own, which is its sequence's as well.
        "group",
        F.when(F.col("length") == capacity, -1 - F.col("place")).otherwise(F.pmod(F.xxhash64("arrival", "place"), F.lit(groups))),
    )
    item_type = placed.schema["item"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group and arrival, full items first; a group is packed once its last row is met."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            full = int(np.searchsorted(batch.column(2).to_numpy(), 0))
            if full:
                zeros = pa.array(np.zeros(full, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, full), batch.column(2).slice(0, full), zeros], names=names_out)
            batch = batch.slice(full)
            if not batch.num_rows:
                continue
            group = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
            if held and held[0].column(2)[0].as_py() != group[0]:
                yield of_group(held)
                held = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                held.append(batch.slice(low, high - low))
                if high < batch.num_rows:
                    yield of_group(held)
                    held = []
        if held:
            yield of_group(held)

    def of_group(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        bins, offsets = best_fit(rows.column(1).to_pylist(), capacity, open_bins)
        base = rows.column(2)[0].as_py() << 32
        columns = [rows.column(0), pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names_out)

    names_out = ["item", "sequence_id", "offset"]
    dealt = placed.select("item", "length", "group", "arrival").repartition("group").sortWithinPartitions("group", "arrival", "length")
    done = dealt.select("item", "length", "group").mapInArrow(packed, f"item {item_type}, sequence_id long, offset long")
    return done.select("item.*", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Pieces of :func:`token_pieces` with their place from :func:`pack`."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity)
    return pack(pieces, docs.count(), "length", capacity, open_bins)
