"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from pulseframe.llm import collocations

SCHEMA = "text string, lang string, words string, n int, score string"


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute_force(rows, least, top):
    out = []
    by_lang = {}
    for text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for words in pieces(text):
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
        f = {p: c for p, c in f.items() if c >= least}
        inside = Counter()
        for p, c in f.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in f.items():
            if len(p) > 1 and 100 * inside[p] < 100 * a:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Overlapping repeats, nested phrases, control characters in words, accents, nulls, long and empty texts."""
    pick = random.Random(3)
    words = ["a", "B", "the", "\x01x", "x\x00y", "é", "É", "z" * 300, "n't", "(of)", "\x7f", "new", "york", "city", "--"]
    fixed = ["new york city", "the x\x00y é", "a a a a a a a", "of the new york times", "b\tthe  A"]
    rows = []
    for i in range(300):
        parts = [pick.choice(fixed) if pick.random() < 0.4 else " ".join(pick.choices(words, k=pick.randint(1, 9))) for _ in range(pick.randint(0, 12))]
        rows.append((pick.choice([" ", ", ", ".\n", "\r", "!?"]).join(parts), pick.choice(["en", "en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("Word word " * 4000, "long"), (rows[5][0], "en"), (rows[5][0], "en"), ("one two", "rare"), (None, "none")]
    return rows


def found(spark, rows, least, top):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    out = collocations.collocations(spark, table, least=least, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize(("least", "top", "chunk", "stream", "batch"), [(100, 2000, 4 << 20, 1 << 17, "10000"), (3, 40, 3000, 50, "30")])
def test_collocations(spark, rows, monkeypatch, least, top, chunk, stream, batch):
    """The second case cuts chunks, streams and batches small, so that phrases stand on both sides of each border."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "STREAM_ROWS", stream)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    out = found(spark, rows, least, top)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert out == brute_force(rows, least, top) and len(out) > 10


def test_large_numbers_stay_exact():
    """Products beyond 64 bits, and ties after rounding down, which go to the first cut."""
    a, n, lefts, rights = 10**12 + 7, 10**15 + 3, [3 * 10**12, 2 * 10**12], [2 * 10**12 + 1, 3 * 10**12]
    score, left, right = collocations._best_cut(a, n, lefts, rights)
    cuts = [(1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(zip(lefts, rights[::-1]))]
    assert (score, left, right) == (min(cuts)[0], *min(cuts)[2:])
    assert collocations._best_cut(1, 1, [10**6, 10**7], [10**6, 10**7]) == (0, 10**6, 10**7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(spark, none).count() == 0
    rare = spark.createDataFrame([("one two", "en", "", 1, "")], SCHEMA)
    assert collocations.collocations(spark, rare).count() == 0
