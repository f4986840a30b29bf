"""Ranked search against every document scored for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from pulseframe.llm import ranking
from pulseframe.llm.wordhash import WordHashes

DOCS = "doc_id long, text string, item_id string, score string, rank int"
ITEMS = "item_id long, text string, doc_id string, item string"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    filled, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for (i, c), n in zip(counts, sizes):
            score = 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * filled // total)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top])]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def tables():
    """Short and very long texts, ties by copies, nulls, accents, terms of digits, and items of every kind."""
    pick = random.Random(6)
    vocabulary = ["".join(pick.choices("abcdeéß09", k=pick.randint(1, 5))) for _ in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    text = lambda n: pick.choice([" ", ", ", "\n", "__"]).join(pick.choices(vocabulary, weights, k=n))
    docs = [(i, text(pick.randint(0, 200))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(25)] + [(7, docs[7][1]), (7, docs[7][1]), (None, docs[7][1]), (None, docs[8][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,\t"), (2003, text(30_000)), (2004, "É" * 70_000), (2005, "word " * 9000), (None, None)]
    items = [(i, text(pick.randint(1, 60))) for i in range(40)]
    items += [(100, docs[7][1]), (101, None), (102, ""), (103, "nowhere-to-be-found"), (104, "É" * 70_000), (105, text(3000)), (None, text(5))]
    items += [items[3], items[3], (3, text(20)), (106, "A " * 50)]
    return docs, items


@pytest.mark.parametrize(("group", "jobs", "block", "batch"), [(1 << 20, 4096, 256, "10000"), (2000, 7, 3, "50")])
def test_search(spark, tables, monkeypatch, group, jobs, block, batch):
    docs, items = tables
    monkeypatch.setattr(ranking, "GROUP_BYTES", group)
    monkeypatch.setattr(ranking, "CELLS", group // 4)
    monkeypatch.setattr(ranking, "JOB_QUERIES", jobs)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    left = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS)
    found = ranking.ranked_search(spark, left, right)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(repr(tuple(r)) for r in found.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert rows == brute_force(docs, items)


def group_of(docs):
    find = WordHashes(ranking.TERM_BYTES)
    n, distinct, hashes, counts = ranking._counted([(t or "").encode() for _, t in docs], find)
    row = {"ids": [i for i, _ in docs], "n": n.tolist(), "distinct": distinct.astype(np.int32).tobytes(), "hashes": hashes.tobytes()}
    press = zstandard.ZstdCompressor().compress
    sketches = b"".join(ranking.sketched(distinct, hashes, counts, s).tobytes() for s in ranking.SHIFTS)
    row |= {"counts": press(counts.astype(np.int32).tobytes()), "sketches": press(sketches)}
    return ranking.Group(row, int((n > 0).sum()), int(n.sum())), find


def test_bounds_hold_and_spare_documents(tables):
    """No bound is below its score, and most documents are never scored exactly."""
    docs = [d for d in tables[0] if d[0] is not None]
    group, find = group_of(docs)
    rows = [dict(zip(h.tolist(), c.tolist())) for h, c in (ranking._counted([(t or "").encode()], find)[2:] for _, t in tables[1])]
    df = Counter(group.hashes.tolist())
    weight = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = ranking.Queries.of(list(range(len(rows))), rows, weight)
    some, whole = np.arange(len(docs)), slice(0, len(docs))
    bounds, exact = group.bounds(queries, whole), ranking.Exact(group, queries, whole)
    for q in range(len(rows)):
        assert (bounds[:, q] >= exact(some, q)).all()
    best = ranking.Best(len(rows), 10)
    scored = ranking.search_group(group, queries, best)
    assert scored < 0.5 * len(some) * len(rows)


def test_levels_round_up():
    counts = np.array([0, 1, 127, 128, 1000, 10**6, 10**12])
    levels = ranking.LEVELS[np.searchsorted(ranking.LEVELS, counts)]
    assert (levels >= counts).all() and (levels[:3] == counts[:3]).all() and (levels[3:6] < 1.1 * counts[3:6]).all()
    assert (np.diff(ranking.LEVELS) > 0).all() and len(ranking.LEVELS) == 256


def test_words_across_slices(monkeypatch):
    from pulseframe.llm import wordhash

    text = " ".join(random.Random(2).choices(["ab", "c", "defghijklmnop", "é"], k=500)).encode()
    whole = WordHashes(ranking.TERM_BYTES)(text)
    monkeypatch.setattr(wordhash, "SLICE_BYTES", 7)
    for one, other in zip(whole, WordHashes(ranking.TERM_BYTES)(text)):
        assert (one == other).all()
    starts, stops, hashes = whole
    words = [text[a:b] for a, b in zip(starts, stops)]
    assert words == text.split() and len(set(hashes.tolist())) == len(set(words))


def test_empty_tables(spark, tables):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a", "", "", 1)], DOCS)
    asked = spark.createDataFrame([(1, "a", "", "")], ITEMS)
    assert ranking.ranked_search(spark, docs, asked).count() == 0
    assert ranking.ranked_search(spark, some, items).count() == 0
    assert ranking.ranked_search(spark, docs, items).count() == 0
    assert ranking.ranked_search(spark, some, asked).collect()[0].score > 0
