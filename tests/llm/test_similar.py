"""Near duplicates of the pipeline against all pairs compared by their words."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pulseframe.llm import similar


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(rows):
    """The least id of each component of pairs at 0.8 or more, and the similarity of each such pair."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if (alike := shared / (len(sets[i]) + len(sets[j]) - shared)) >= 0.8:
                pairs.append((rows[i][1], rows[j][1], alike))
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (x, _) in enumerate(rows):
        groups[top(i)].append(x)
    return sorted(min(g) for g in groups.values()), pairs


@pytest.fixture(scope="module")
def rows():
    """Short and long texts with 1 to 40 changed words each, chains of edits, copies and texts without words."""
    pick = random.Random(5)
    vocabulary = ["".join(pick.choices("abcdefgh", k=pick.randint(2, 7))) for _ in range(4000)]
    texts = ["", None, " \n", "one", "One", "two words", "five words are one shingle"]
    for n in [20, 45, 45, 60, 90, 150, 150, 300, 300, 600, 900, 3000] * 4:
        base = pick.choices(vocabulary, k=n)
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for at in pick.sample(range(n), max(1, round(n * pick.uniform(0.002, 0.04)))):
                copy[at] = pick.choice(vocabulary)
            texts.append(" ".join(copy))
            if pick.random() < 0.3:
                base = copy
    return list(enumerate(texts))


@pytest.mark.parametrize("largest", [1024, 4])
def test_stage_keeps_one_of_each_component(spark, rows, largest):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute_force(rows)
    kept = similar.one_of_each(spark, docs, largest_bucket=largest)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == expected
    if largest == 1024:
        assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == expected


def test_buckets_hold_pairs_at_the_limit(rows):
    known = similar.Words()
    signs = {t: similar.signature(similar.shingles((t or "").encode(), known)) for _, t in rows}
    _, pairs = brute_force(rows)
    in_band = [
        (signs[a].reshape(similar.BANDS, -1) == signs[b].reshape(similar.BANDS, -1)).all(axis=1).any() for a, b, _ in pairs
    ]
    assert len(pairs) > 150 and sum(in_band) >= 0.99 * len(pairs)


def test_blocks_join_what_is_similar(rows):
    """Rows of one bucket in several labels: links join just the rows that are similar, on one side or across two."""
    known = similar.Words()
    some = [t for _, t in rows if t][20:120]
    sets = [similar.shingles(t.encode(), known) for t in some]
    places = np.array([similar.signature(x) for x in sets]).astype(np.uint8)

    def joined(pairs):
        label = np.arange(len(some))
        for x, y in pairs:
            label[label == label[x]] = label[y]
        return {tuple(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())}

    near = [(i, j) for i in range(len(some)) for j in range(i) if similar.similarity(sets[i], sets[j]) >= 0.8]
    one = similar.block_links(places, np.arange(len(some)), np.zeros(len(some)), sets.__getitem__, 0.8)
    assert joined(one) == joined(near) and len(one) < len(some) and len(near) > 30
    sides = np.arange(len(some)) % 2
    two = similar.block_links(places, np.arange(len(some)), sides, sets.__getitem__, 0.8)
    assert joined(two) == joined([(i, j) for i, j in near if sides[i] != sides[j]])


def test_recall_by_similarity(rows):
    """Pairs that share a bucket and pass the comparison of signatures, by how alike they are."""
    known = similar.Words()
    signs = {t: similar.signature(similar.shingles((t or "").encode(), known)) for _, t in rows}
    _, pairs = brute_force(rows)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        met = []
        for a, b, x in pairs:
            if low <= x < high:
                same = signs[a] == signs[b]
                met.append(same.reshape(similar.BANDS, -1).all(axis=1).any() and same.mean() >= similar.LEAST_ALIKE)
        assert len(met) > 30 and np.mean(met) >= 0.98
