"""Phrase collocations from count streams in prefix and suffix order.

Counting: chunks of documents send the distinct words and word pairs they hold, as 64-bit hashes
with counts, to the buckets that own them; a bucket adds up and answers which are frequent. Longer
phrases are sent in a second round, only where every pair in them is frequent, so that the many
phrases met once or twice never travel. One chunk supplies the words of each frequent phrase.

Estimation: the frequent phrases with their counts form two streams. In prefix order, sorted by
their words, a phrase follows its first words and precedes its extensions to the right, so one
pass with a stack as deep as the longest phrase meets the counts of all its left parts. In suffix
order, sorted by their words from the last on, another pass meets those of all right parts and
extensions to the left. Both are cut into ranges by their order, and a range is given the few
phrases that its first one starts with. A lockstep merge of the two streams brings left, right
and whole counts together: no table of phrases is built or looked up anywhere.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.chunks import by_bucket, chunk_count, mixed, text_bytes
from pulseframe.llm.components import saved
from pulseframe.llm.wordhash import LOWER, WordHashes

LEAST = 100
LONGEST = 5
TOP = 2000
#: Text of a chunk; the next few megabytes keep its arrays within a few hundred.
CHUNK_BYTES = 4 << 20
#: Phrases of a stream that one task passes over.
STREAM_ROWS = 1 << 17
#: Parts that a language's best phrases are drawn from before they are ranked as a whole.
PARTS = 256
UNKNOWN = "und"
BREAKS = b".,;:!?\n\v\f\r"
WORD_BYTES = bytes(c for c in range(256) if c not in BREAKS + b" \t")
RARE, FREQUENT, SUPPLY = range(3)
_FACTORS = np.random.default_rng(13).integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _as_chunks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``chunk, langs, owners, sizes, blob``: lowered texts of some documents, compressed, and for each its
    language's place in ``langs``. Chunks are cut where rows are read, so no text is shuffled for it."""
    source = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            low = size = 0
            for row, text in enumerate(texts):
                size += len(text)
                if size >= CHUNK_BYTES or row == len(texts) - 1:
                    names = sorted(set(langs[low : row + 1]))
                    place = {name: i for i, name in enumerate(names)}
                    owners = np.array([place[x] for x in langs[low : row + 1]], np.int32)
                    sizes = np.array([len(t) + 1 for t in texts[low : row + 1]], np.int64)
                    blob = press.compress(b"\n".join(texts[low : row + 1]).translate(LOWER))
                    columns = [pa.array([base + number]), pa.array([names], pa.list_(pa.string()))]
                    columns += [pa.array([x], pa.binary()) for x in (owners.tobytes(), sizes.tobytes(), blob)]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "langs", "owners", "sizes", "blob"])
                    number, low, size = number + 1, row + 1, 0

    return source.mapInArrow(chunked, "chunk long, langs array<string>, owners binary, sizes binary, blob binary")


class Chunk:
    """The words of a chunk, and the hashes of the phrases that start at each."""

    def __init__(self, row: dict) -> None:
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.langs = row["langs"]
        self.data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, int(sizes.sum())))
        self.starts, self.stops, hashes = WordHashes(WORD_BYTES)(self.data)
        firsts = np.searchsorted(self.starts, np.cumsum([0, *sizes[:-1]]))
        self.lang = np.repeat(np.frombuffer(row["owners"], np.int32), np.diff(firsts, append=len(hashes)))
        marks = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        self.words = mixed(hashes + marks[self.lang]) if len(hashes) else hashes
        breaks = np.zeros(256, bool)
        breaks[list(BREAKS)] = True
        passed = np.cumsum(breaks[np.frombuffer(self.data, np.uint8)], dtype=np.int32)
        #: Whether a word goes on the piece of the word before.
        self.joined = np.zeros(len(hashes), bool)
        if len(hashes):
            self.joined[1:] = passed[self.starts[1:]] == passed[self.stops[:-1] - 1]

    def phrases(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the phrases of so many words from each place on."""
        if length == 1:
            return self.words[places]
        out = np.full(len(places), length, np.uint64)
        for j in range(length):
            out += self.words[places + j] * _FACTORS[j]
        return mixed(out)

    def pairs(self) -> np.ndarray:
        return np.flatnonzero(self.joined) - 1

    def sent(self, first: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and hashes of the phrases of a round: words and pairs, or, given the sorted
        hashes of the first round and their codes, longer ones of frequent pairs alone."""
        pairs = self.pairs()
        if first is None:
            found = [(np.arange(len(self.words)), 1), (pairs, 2)]
        else:
            good = np.zeros(len(self.words) + LONGEST, bool)
            hashes, codes = first
            good[pairs] = codes[np.searchsorted(hashes, self.phrases(pairs, 2))] > RARE
            whole, found = good, []
            for length in range(3, LONGEST + 1):
                whole = whole[:-1] & good[length - 2 :]
                found.append((np.flatnonzero(whole), length))
        places = np.concatenate([p for p, _ in found])
        lengths = np.repeat([n for _, n in found], [len(p) for p, _ in found])
        return places, lengths, np.concatenate([self.phrases(p, n) for p, n in found])

    def text(self, place: int, length: int) -> list[str]:
        return [self.data[a:b].decode() for a, b in zip(self.starts[place : place + length], self.stops[place : place + length])]


def _sent(chunk: int, hashes: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    distinct, counts = np.unique(hashes, return_counts=True)
    blocks = by_bucket(distinct, buckets)
    return {
        "bucket": pa.array([b for b, _, _ in blocks], pa.int64()),
        "chunk": pa.array([chunk] * len(blocks), pa.int64()),
        "hashes": pa.array([distinct[s:t].tobytes() for _, s, t in blocks], pa.binary()),
        "counts": pa.array([counts[s:t].astype(np.int32).tobytes() for _, s, t in blocks], pa.binary()),
    }


def _judged(key: tuple[pa.Scalar, ...], table: pa.Table, least: int) -> pa.Table:
    """``chunk, bucket, codes, totals``: of each hash sent whether it is frequent, and with what total for the
    chunk that is to supply its words, the one with the lowest number."""
    hashes = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("hashes")]
    counts = np.concatenate([np.frombuffer(b.as_py(), np.int32) for b in table.column("counts")]).astype(np.int64)
    sizes = [len(b) for b in hashes]
    every = np.concatenate(hashes)
    order = np.lexsort((np.repeat(table.column("chunk").to_numpy(), sizes), every))
    first = np.ones(len(order), bool)
    first[1:] = every[order][1:] != every[order][:-1]
    group = np.cumsum(first) - 1
    totals = np.bincount(group, counts[order]).astype(np.int64)[group]
    codes, total = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    codes[order] = np.where(totals < least, RARE, np.where(first, SUPPLY, FREQUENT))
    total[order] = totals
    cuts = np.cumsum([0, *sizes])
    parts = [(codes[a:b], total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": pa.array([key[0].as_py()] * len(sizes), pa.int64()),
            "codes": pa.array([c.tobytes() for c, _ in parts], pa.binary()),
            "totals": pa.array([t[c == SUPPLY].tobytes() for c, t in parts], pa.binary()),
        }
    )


def _answered(answers: pa.Table, distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a chunk's sorted hashes, and the totals of those it is to supply."""
    by = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("codes").to_pylist(), answers.column("totals").to_pylist())))
    rows = [by[b] for b, _, _ in by_bucket(distinct, buckets)]
    codes, totals = (b"".join(x) for x in zip(*rows)) if rows else (b"", b"")
    return np.frombuffer(codes, np.uint8), np.frombuffer(totals, np.int64)


def frequent_phrases(
    spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """``lang, words array<string>, f long``: every phrase of up to five words that occurs ``least`` times
    in its language, with its count; and ``lang, n long``: the words of each language."""
    buckets = chunk_count(text_bytes(docs, text_col))
    chunks = saved(spark, _as_chunks(docs, lang_col, text_col), "chunks")
    sent_schema, answer_schema = "bucket long, chunk long, hashes binary, counts binary", "chunk long, bucket long, codes binary, totals binary"

    def judged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _judged(key, table, least)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = pa.table(_sent(row["chunk"], Chunk(row).sent()[2], buckets))
                yield from table.to_batches()

    def row_of(table: pa.Table) -> dict:
        return table.slice(0, 1).to_pylist()[0]

    def answers_of(chunk: Chunk, answers: pa.Table):
        hashes = chunk.sent()[2]
        distinct = np.unique(hashes)
        return distinct, *_answered(answers, distinct, buckets)

    def second_round(table: pa.Table, answers: pa.Table) -> pa.Table:
        row = row_of(table)
        chunk = Chunk(row)
        distinct, codes, _ = answers_of(chunk, answers)
        return pa.table(_sent(row["chunk"], chunk.sent((distinct, codes))[2], buckets))

    def supplied(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(row_of(table))
        out: list[tuple[str, list[str] | None, int]] = [
            (chunk.langs[i], None, n) for i, n in enumerate(np.bincount(chunk.lang, minlength=len(chunk.langs)).tolist())
        ]
        rounds = [answers.filter(pa.compute.equal(answers.column("round"), n)) for n in (1, 2)]
        first = None
        for mine in rounds:
            places, lengths, hashes = chunk.sent(first)
            distinct, at = np.unique(hashes, return_index=True)
            codes, totals = _answered(mine, distinct, buckets)
            for i, total in zip(at[codes == SUPPLY].tolist(), totals.tolist()):
                out.append((chunk.langs[chunk.lang[places[i]]], chunk.text(int(places[i]), int(lengths[i])), total))
            first = distinct, codes
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64())
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(("lang", "words", "f"), kinds))})

    one = saved(spark, chunks.mapInArrow(first_round, sent_schema).groupBy("bucket").applyInArrow(judged, answer_schema), "round1")
    two = chunks.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(second_round, sent_schema)
    two = saved(spark, two.groupBy("bucket").applyInArrow(judged, answer_schema), "round2")
    both = one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    found = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(supplied, "lang string, words array<string>, f long")
    found = saved(spark, found, "phrases")
    sizes = found.where("words IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    return found.where("words IS NOT NULL"), sizes


def part_counts(spark: SparkSession, phrases: DataFrame, tasks: int) -> DataFrame:
    """One pass over the stream in the order of ``words``: ``lang, words, f, n, parts, whole``.

    ``parts`` holds the counts of the first 1, 2, ... words of each phrase. Rows without ``f``
    name a phrase that some extension by one word is as frequent as.
    """
    order = ["lang", "words"]
    row = "lang string, words array<string>, f long, n long"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64))], names=["lang", "words", "f", "n", "part"])

    ranged = phrases.select("lang", "words", "f", "n").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    stream = saved(spark, ranged.mapInArrow(numbered, f"{row}, part long"), "stream")
    # What the first phrase of a range starts with stands in ranges before it: at most four phrases.
    firsts = stream.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first")).select("part", "first.*").where("size(words) > 1")
    firsts = firsts.select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.slice("words", 1, k))).alias("words"))
    # Four rows for each task of this stage, so their number is bounded by that of the tasks.
    firsts = firsts.select(F.col("part").alias("of"), F.col("lang").alias("its_lang"), F.col("words").alias("its_words"))
    before = stream.select(*order, "f").join(F.broadcast(firsts), F.expr("lang = its_lang AND words = its_words"))
    before = before.select("of", "its_lang", "its_words", F.col("f").alias("its_f"))

    def passed(table: pa.Table, before: pa.Table) -> pa.Table:
        rows = [(r["lang"], tuple(r["words"]), r["f"], r["n"]) for r in table.to_pylist()]
        rows += [(r["its_lang"], tuple(r["its_words"]), r["its_f"], None) for r in before.to_pylist()]
        rows.sort(key=lambda r: r[:2])
        out, stack = [], []
        for lang, words, f, n in rows:
            while stack and (stack[-1][0] != lang or words[: len(stack[-1][1])] != stack[-1][1]):
                stack.pop()
            if n is not None:
                out.append((lang, words, f, n, [s[2] for s in stack]))
                if len(words) > 2 and stack[-1][2] == f:
                    out.append((lang, words[:-1], None, None, None))
            stack.append((lang, words, f))
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table({x: pa.array([r[i] for r in out], k) for i, (x, k) in enumerate(zip(("lang", "words", "f", "n", "parts"), kinds))})

    return stream.groupBy("part").cogroup(before.groupBy("of")).applyInArrow(passed, f"{row}, parts array<long>")


def _best_cut(a: int, n: int, lefts: list[int], rights: list[int]) -> tuple[int, int, int]:
    """Score, left and right count of the lowest-scoring cut, the first of equal ones."""
    found = [(1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(zip(lefts, reversed(rights)))]
    score, _, left, right = min(found)
    return score, left, right


def collocations(
    spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of each language.

    A-Z are lowered, texts split at ``.,;:!?`` and line ends into pieces, and pieces at spaces and
    tabs into words. Candidates are phrases of two to five words within pieces that occur ``a >=
    least`` times, overlaps included. Cut in two, with ``l`` and ``r`` occurrences of the parts
    among ``n`` words of the language, a candidate scores floor(1000 a n / (l r)); its lowest cut
    counts, the first of equal ones. Candidates all of whose occurrences lie in those of one longer
    candidate are left out. Ranks go by score, then by ``a``, both falling, then by phrase.

    Null texts are empty, a null language is ``und``, every row of ``docs`` counts, also where rows
    repeat. Empty tables, and languages without such phrases, give no rows. Other columns are left
    out, whatever their names. Numbers are exact, whatever their size.
    """
    phrases, sizes = frequent_phrases(spark, docs, lang_col, text_col, least)
    counted = phrases.join(sizes, "lang")
    tasks = max(1, math.ceil(phrases.count() / STREAM_ROWS))
    lefts = part_counts(spark, counted, tasks).withColumn("side", F.lit(0))
    rights = part_counts(spark, counted.withColumn("words", F.reverse("words")), tasks)
    rights = rights.withColumn("words", F.reverse("words")).withColumn("side", F.lit(1))
    order = ["lang", "words", "side"]
    merged = lefts.unionByName(rights).where("size(words) > 1").repartitionByRange(tasks, "lang", "words").sortWithinPartitions(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, int, bytes, int, int, int]]] = {}

        def whole(rows: list[dict]) -> None:
            both = [r for r in rows if r["f"] is not None]
            if len(both) != len(rows):
                return  # some extension is as frequent
            left, right = both
            score, l, r = _best_cut(left["f"], left["n"], left["parts"], right["parts"])
            mine = best.setdefault(left["lang"], [])
            mine.append((-score, -left["f"], " ".join(left["words"]).encode(), l, r, left["n"]))
            if len(mine) >= 4 * top:
                mine[:] = heapq.nsmallest(top, mine)

        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and (rows[0]["lang"], rows[0]["words"]) != (row["lang"], row["words"]):
                    whole(rows)
                    rows = []
                rows.append(row)
        if rows:
            whole(rows)
        out = [(lang, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, mine in best.items() for x in heapq.nsmallest(top, mine)]
        names = ["lang", "phrase", "a", "l", "r", "n", "score"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.string() if i < 2 else pa.int64()) for i in range(7)], names=names
        )

    found = merged.select("lang", "words", "f", "n", "parts", "side").mapInArrow(
        merge, "lang string, phrase string, a long, l long, r long, n long, score long"
    )
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # In parts first, so that no task ranks what all tasks found of a large language.
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*by))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
              FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) q WHERE len(w) >= k) q) q
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1) q),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, j,
    CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN total t ON t.lang = c.lang),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i
        FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2) q) q),
kept AS (
  SELECT * FROM cut c WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrases i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
