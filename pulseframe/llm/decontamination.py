"""Benchmark decontamination by winnowing, in DataFrame and SQL functions alone.

Both sides keep, of every window of consecutive k-gram hashes, the rightmost smallest. A
shared span of ``k + window - 1`` words holds the same hashes on both sides, so the same one
is kept: no shared span of that length can be missed. Kept hashes are joined, and each hit
is extended word by word to both sides, which also undoes chance collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a benchmark window; shorter items are one window.
SPAN = 10
GRAM = 5
#: Keys of the benchmark, and their bytes, up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that the built-in lowering might change though they are not A-Z.
OTHER_CASE = r"[^\x00-\x7F\p{Ll}]"


def words(text: Column) -> Column:
    """Words of a text: letters A-Z lowered, split at ASCII characters that are not letters or digits.

    The built-in lowering is several times as fast as a translation and the same where all
    letters beyond ASCII are small ones.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(text.rlike(OTHER_CASE), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, BETWEEN), "")


def with_grams(texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """Adds ``hashes`` of the single ``words`` and ``grams``, those of all runs of ``gram`` words.
    A word is hashed once; runs are hashed from the numbers of their words."""
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    whole = F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (gram - 1), F.lit(0)))
    return hashed.withColumn(
        "grams", F.transform(whole, lambda w, i: F.xxhash64(w, *[F.get("hashes", i + j) for j in range(1, gram)]))
    )


def _reach(agrees: list[Column]) -> Column:
    """How many of the conditions hold before the first that does not; null does not."""
    out = F.lit(len(agrees))
    for n in reversed(range(len(agrees))):
        out = F.when(F.coalesce(agrees[n], F.lit(False)), out).otherwise(n)
    return out


def is_kept(at: Column, hash: Column, window: int) -> Column:
    """Whether a hash is the rightmost smallest of some window of ``grams`` around its place."""
    left = _reach([F.get("grams", at - n) >= hash for n in range(1, window)])
    right = _reach([F.get("grams", at + n) > hash for n in range(1, window)])
    return left + right >= window - 1


def benchmark_keys(items: DataFrame, id_col: str, text_col: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """``hash, item, length, item_words``: what documents are looked up by.

    Items of ``span`` words or more: the kept hashes, with length 0 and the words that a window
    around them can reach (null beyond the ends). Shorter ones: the hash of the first word, with
    their length and all their words. Items without words or with a null id have no key.
    """
    tests = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")
    )
    # Chance repeats within the benchmark would multiply the join's rows without any use.
    tests = with_grams(tests.distinct(), gram).withColumn("n", F.size("words"))
    # Outer, as else a filter on the hashes would be set before they are made, and make them anew.
    long = tests.where(F.col("n") >= span).select("item", "words", "grams", F.posexplode_outer("grams").alias("at", "hash"))
    context = F.array(*[F.get("words", F.col("at") + n) for n in range(gram - span, span)])
    long = long.where(is_kept(F.col("at"), F.col("hash"), span - gram + 1)).select("hash", "item", F.lit(0).alias("length"), context.alias("item_words"))
    short = tests.where((F.col("n") > 0) & (F.col("n") < span))
    short = short.select(F.get("hashes", F.lit(0)).alias("hash"), "item", F.col("n").alias("length"), F.col("words").alias("item_words"))
    return long.unionByName(short).distinct()


def _occurrences(
    docs: DataFrame,
    items: DataFrame,
    id_col: str,
    text_col: str,
    item_id_col: str,
    item_text_col: str,
    gram: int,
    span: int,
    broadcast_rows: int,
    every: bool,
) -> DataFrame:
    """``id, mark, part, n_words, item, start, stop``: the spans of document words in occurring
    windows, and with ``every`` a row for each row of ``docs``, which alone has ``n_words``;
    then ``start`` is null where there is no span. ``part`` is the partition that the row was
    read in. One pass over the texts."""
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("mark"),
        F.spark_partition_id().alias("part"),
        words(F.col(text_col)).alias("words"),
    )
    keys = benchmark_keys(items, item_id_col, item_text_col, gram, span)
    size = keys.agg(
        F.count("*").alias("n"),
        F.sum(16 + F.octet_length(F.concat_ws(" ", "item", "item_words"))).alias("bytes"),
        F.max("length").alias("short"),
    ).first()
    small = size["n"] <= broadcast_rows and (size["bytes"] or 0) <= BROADCAST_BYTES

    # Looked up are the kept hashes of runs and, if there are short items, those of all words; the
    # last element stands for the row itself.
    grams, more = F.size("grams"), span - gram
    looked_up = [F.col("grams"), *([F.col("hashes")] if size["short"] else []), *([F.array("mark")] if every else [])]
    rows = with_grams(texts, gram).select("*", F.posexplode_outer(F.concat(*looked_up)).alias("place", "hash"))
    last = grams + (F.size("hashes") if size["short"] else 0)
    rows = rows.where((F.col("place") >= grams) | is_kept(F.col("place"), F.col("hash"), more + 1))
    rows = rows.withColumns(
        {"whole": F.col("place") == last, "at": F.when(F.col("place") < grams, F.col("place")).otherwise(F.col("place") - grams)}
    ).drop("grams", "hashes", "place").withColumnRenamed("hash", "key")
    looked = F.broadcast(keys) if small else keys
    found = rows.join(looked, (rows["key"] == looked["hash"]) & ~rows["whole"], "left" if every else "inner")

    # Beside the join stands only the cutting out of words: all in one would be too much code to be compiled.
    before = F.least(F.col("at"), F.lit(more))
    padding = F.slice(F.array(*[F.lit(None).cast("string")] * more), F.lit(1), more - before)
    context = F.concat(padding, F.slice("words", F.col("at") - before + 1, before + span))
    found = found.where(F.col("whole") | F.col("item").isNotNull()).select(
        "id",
        "mark",
        "part",
        F.when(F.col("whole"), F.size("words")).alias("n_words"),
        "item",
        "length",
        "item_words",
        "at",
        F.when(~F.col("whole"), context).alias("context"),
    )
    spans = _equal_spans(gram, span)
    return found.select("id", "mark", "part", "n_words", "item", F.inline_outer(spans) if every else F.inline(spans))


def _equal_spans(gram: int, span: int) -> Column:
    """``start, stop`` of the equal words around a looked-up place, if that many are; else null or none.

    ``context`` holds the document's words from ``span - gram`` before the place on, null beyond the ends."""
    at, more = F.col("at"), span - gram
    whole_item = F.slice("context", F.lit(more + 1), F.greatest("length", F.lit(1))) == F.col("item_words")
    same = F.zip_with("context", "item_words", lambda x, y: F.coalesce(x == y, F.lit(False)))

    def reach(side: Column) -> Column:
        first = F.array_position(side, False).cast("int")
        return F.when(first > 0, first - 1).otherwise(more)

    def grown(s: Column) -> Column:
        left, right = reach(F.reverse(F.slice(s, 1, more))), reach(F.slice(s, more + gram + 1, more))
        middle = ~F.array_contains(F.slice(s, more + 1, gram), False)
        return F.when(middle & (left + right >= more), F.struct((at - left).alias("start"), (at + gram + right).alias("stop")))

    long = F.filter(F.transform(F.array(same), grown), lambda x: x.isNotNull())
    short = F.when(whole_item, F.array(F.struct(at.alias("start"), (at + F.col("length")).alias("stop"))))
    return F.when(F.col("length") > 0, short).when(F.col("item").isNotNull(), long)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = GRAM,
    span: int = SPAN,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id, mark, item, start, stop``: spans of document words inside occurring windows.

    ``mark`` is a hash of the text; with the id it names a row, up to rows that repeat it.
    Spans may overlap and repeat. Null texts, and texts without words, have none.
    """
    found = _occurrences(docs, items, id_col, text_col, item_id_col, item_text_col, gram, span, broadcast_rows, every=False)
    return found.select("id", "mark", "item", "start", "stop")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words long, n_hit long, items array<string>``.

    A window is ten consecutive words of an item, or a shorter item as a whole. ``n_hit``
    counts the document's words inside any occurrence of a window, ``items`` are the distinct
    ids, sorted as text, whose windows occur. Null texts have no words. Items without words
    and items with a null id match nothing. Empty tables give no rows, or no hits. Other
    columns are left out, whatever their names; rows may repeat.
    """
    rows = _occurrences(docs, items, id_col, text_col, item_id_col, item_text_col, GRAM, SPAN, broadcast_rows, every=True)
    # Rows alike in id and text are told apart by the partition they were read in, and counted within it.
    found = rows.groupBy("id", "mark", "part").agg(
        F.count("n_words").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.col("item")))).alias("items"),
    )
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda so_far, x: F.struct(
            (so_far["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], so_far["reach"]))).cast("long").alias("n"),
            F.greatest(so_far["reach"], x["stop"]).alias("reach"),
        ),
        lambda so_far: so_far["n"],
    )
    found = found.select("id", "n_words", covered.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items")


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no window of an item occurs.
    Null and empty texts stay; rows that repeat stay or go together, whatever else they hold."""
    hits = benchmark_hits(docs, items, id_col, text_col, item_id_col, item_text_col)
    hits = hits.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs[id_col].eqNullSafe(hits["__id"]) & (F.xxhash64(docs[text_col]) == hits["__mark"])
    return docs.join(hits, same, "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM n, LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS i)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS i)
  WHERE len(w) >= size),
hits AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, run)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) q
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
