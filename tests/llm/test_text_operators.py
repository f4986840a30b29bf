"""Each operator against a brute-force version, on rows chosen to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import chunks, decontamination, packing, simhash, substrings, suffixes
from pulseframe.llm.bwt import shares_prefix
from pulseframe.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_removed string, id string, kept string, words string, sequence_id int"


def sentence(pick, n):
    return " ".join("".join(pick.choices("abcdeé", k=pick.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, repeats inside a text, repeated rows and ids."""
    pick = random.Random(3)
    passage = sentence(pick, 120)
    texts = [None, "", " \t\n", "one", "two words", passage, passage, sentence(pick, 10) + " " + passage]
    texts += [sentence(pick, 30) + "\n" + passage[50:] + " " + sentence(pick, 50) for _ in range(5)]
    texts += ["ab " * 700, "x" * 3000, sentence(pick, 40) * 3, sentence(pick, 6000)]
    texts += [sentence(pick, pick.randint(1, 90)) for _ in range(20)]
    texts += ["é" * 401, "né" * 401, "Don't STOP <|endoftext|> now... J̌ İ ﬁ\x0b\x1cz"]
    out = list(enumerate(texts))
    return [*out, out[5], out[5], (None, passage), (None, None), (7, "another text under a used id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", 1) for i, t in rows], SCHEMA)


def sorted_rows(found):
    return sorted(map(repr, found))


def windows_removed(units, size):
    counts = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if counts[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not before for g, before in zip(gone, [False, *gone]))


@pytest.mark.parametrize("window", [1, 2, 35])
def test_substrings(docs, rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    expected = []
    for (i, _), w, gone in zip(rows, words, windows_removed(words, window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), sum(gone), runs(gone), kept))
    found = substrings.substring_dedup(docs, window=window).collect()
    assert sorted_rows((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept_text) for r in found) == sorted_rows(expected)


def test_substrings_in_small_slices_and_chunks(spark, docs, monkeypatch):
    whole = sorted_rows(substrings.substring_dedup(docs).collect())
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 64)
    assert sorted_rows(substrings.substring_dedup(docs).collect()) == whole


@pytest.mark.parametrize(("block", "chunk"), [(1 << 20, 4 << 20), (2000, 500)])
def test_suffixes(spark, docs, rows, monkeypatch, block, chunk):
    """The second case sends long passages the way of crowded keys, and splits copies over chunks."""
    monkeypatch.setattr(suffixes, "BLOCK_SYMBOLS", block)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    data = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), b, gone in zip(rows, data, windows_removed(data, 400)):
        expected.append((i, len(b), sum(gone), runs(gone), bytes(x for x, g in zip(b, gone) if not g)))
    found = suffixes.suffix_array_dedup(spark, docs).collect()
    assert sorted_rows((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found) == sorted_rows(expected)


def test_shared_prefixes():
    pick = np.random.default_rng(0)
    for _ in range(60):
        n, least = int(pick.integers(1, 300)), int(pick.integers(7, 30))
        text = pick.integers(1, int(pick.integers(2, 6)), n)
        if n > 40:
            k = int(pick.integers(5, n // 2))
            text[-k:] = text[:k]
        counts = Counter(tuple(text[i : i + least]) for i in range(n - least + 1))
        expected = [counts[tuple(text[i : i + least])] > 1 for i in range(n - least + 1)]
        assert shares_prefix(text, least)[: len(expected)].tolist() == expected


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs, rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = groups_of(prints)
    expected = []
    for (i, _), p, mine in zip(rows, prints.tolist(), label):
        ids = [rows[j][0] for j in np.flatnonzero(label == mine) if rows[j][0] is not None]
        expected.append((i, f"{p:016x}", min(ids, default=None)))
    found = simhash.simhash_dedup(spark, docs).collect()
    assert sorted_rows((r.doc_id, f"{r.fingerprint % (1 << 64):016x}", r.component_id) for r in found) == sorted_rows(expected)


@pytest.mark.parametrize("largest", [2048, 1])
def test_near_fingerprints(spark, largest):
    """Clusters of fingerprints, linked by comparison and through the words around them."""
    pick = np.random.default_rng(3)
    prints = set()
    for base in pick.integers(0, 2**64 - 1, 40, dtype=np.uint64):
        for _ in range(5):
            prints.add(int(base))
            for bit in pick.choice(64, pick.integers(1, 5), replace=False):
                base ^= np.uint64(1) << np.uint64(bit)
    prints = np.array(sorted(prints), np.uint64)
    label = groups_of(prints)
    table = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64))], "id long, fp long")
    found = {r.fp: r.first_id for r in simhash.near_duplicate_groups(spark, table, largest).collect()}
    assert [found[int(p)] for p in prints.view(np.int64)] == label.tolist()


def test_golay_code():
    offsets = simhash.golay_offsets()
    assert all(min(bin(w).count("1") for w in o) <= 3 for o in offsets)
    assert {len(o) for o in offsets} == {1, 6}


def test_one_of_each(spark, docs, rows):
    """Two groups may be named by one id, as an id is used for two texts."""
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    label = groups_of(np.array([fingerprint(t) for _, t in rows], np.uint64))
    first = [
        min((rows[j][0] for j in np.flatnonzero(label == mine) if rows[j][0] is not None), default=None) for mine in set(label)
    ]
    assert sorted_rows(r.doc_id for r in kept.collect()) == sorted_rows(first)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 199)] * 2
    found = dict(components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {200: 199}


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Alpha-BETA gamma delta epsilon zeta eta theta iota KAPPA"),
    (10, "kurz"),
    (11, "two words"),
    (12, "a b c d e f g"),
    (13, ""),
    (14, None),
    (None, "alpha beta"),
    (15, "same same same same same same same same same same same same"),
    (16, "été à la mer, où l'on va tous les ans"),
]
SUSPECTS = [
    (1, "x " * 30 + ITEMS[0][1] + " y" * 20),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "KURZ! two  words; two, words"),
    (4, "same " * 40),
    (5, "a b c d e f g h " * 3),
    (6, None),
    (7, ""),
    (8, "Été à la mer, où L'ON va tous les ans... été à la mer"),
    (8, "another"),
    (1, "x " * 30 + ITEMS[0][1] + " y" * 20),
    (None, "kurz und gut"),
    (9, "beta gamma delta epsilon zeta eta theta iota kappa lambda " * 2),
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(spark, broadcast_rows):
    windows = set()
    for i, t in ITEMS:
        w = words_of(t)
        n = min(10, len(w))
        if i is not None and n:
            windows.update((str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    expected = []
    for i, t in SUSPECTS:
        w = words_of(t)
        hit, items = set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    items.add(item)
        expected.append((i, len(w), len(hit), sorted(items)))
    suspects = spark.createDataFrame([(*s, 1, "x") for s in SUSPECTS], "doc_id long, text string, id int, words string")
    items = spark.createDataFrame([(*s, 1, "x") for s in ITEMS], "item_id long, text string, hash int, at string")
    found = decontamination.decontaminate(suspects, items, broadcast_rows=broadcast_rows).collect()
    assert sorted_rows((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == sorted_rows(expected)
    clean = decontamination.without_contaminated(suspects, items)
    assert clean.columns == suspects.columns
    assert sorted_rows((r.doc_id, r.text) for r in clean.collect()) == sorted_rows(
        s for s, e in zip(SUSPECTS, expected) if not e[2]
    )


def test_tokens_and_packing(spark, docs, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4")
            expected.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack_documents(docs, TOKENIZER, capacity=256, open_bins=8).collect()
    assert sorted_rows((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted_rows(expected)
    filled = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 256
    with_ids = packing.token_pieces(docs, TOKENIZER, with_ids=True).where("doc_id = 3").first()
    assert with_ids.ids == [*tokenizer.encode("one", add_special_tokens=False).ids, 0]


def test_best_fit_closes_the_fullest():
    assert packing.best_fit([6, 7, 3, 4, 8], 10, 2) == ([0, 1, 1, 0, 2], [0, 0, 7, 6, 0])
    assert packing.best_fit([6, 7, 8, 4], 10, 2) == ([0, 1, 2, 0], [0, 0, 0, 6])
    pick = random.Random(0)
    lengths = [pick.randint(1, 2048) for _ in range(20_000)]
    assert len(set(packing.best_fit(lengths)[0])) < 1.02 * sum(lengths) / 2048


def test_packing_spreads_full_pieces_and_repeated_rows(spark):
    """Full items share no sequence and no group; a table of one repeated row is packed in many groups."""
    pick = random.Random(2)
    rows = [(1, pick.choice([64, 64, pick.randint(0, 63)])) for _ in range(600)] + [(2, 10)] * 900 + [(3, None), (3, -4)]
    items = spark.createDataFrame([(*r, "x") for r in rows], "id int, length int, offset string").repartition(5)
    packed = packing.pack(items, 1500, capacity=64, open_bins=4, group_items=100)
    assert packed.columns == ["id", "length", "sequence_id", "offset"]
    found = packed.collect()
    assert sorted(repr((r.id, r.length)) for r in found) == sorted(repr(r) for r in rows)
    filled = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset, max(r.length or 0, 0))):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += max(r.length or 0, 0)
    assert max(filled.values()) <= 64
    full = Counter(r.sequence_id for r in found if r.length == 64)
    assert max(full.values()) == 1 and all(filled[s] == 64 for s in full)
    assert len({r.sequence_id >> 32 for r in found if r.id == 2}) >= 10
    assert packing.pack(items.limit(0), 0).count() == 0


def test_words_as_the_tokenizer_takes_them():
    tokenizer, words = Tokenizer.from_file(TOKENIZER), packing._Words(TOKENIZER)
    pick = random.Random(1)
    letters = "aAbÉé.'!<|> sŚı1٣$%&#,;:\t\n\x0bİΣ́"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 40))) for _ in range(3000)]
    found = words.packed([t.encode() for t in texts])
    for text, packed in zip(texts, found):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert substrings.substring_dedup(none).count() == 0
    assert suffixes.suffix_array_dedup(spark, none).count() == 0
    assert simhash.simhash_dedup(spark, none).count() == 0
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert decontamination.decontaminate(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.decontaminate(some, items).first().n_hit == 0


def test_kept_digests(spark, docs):
    found = suffixes.suffix_array_dedup(spark, docs).select("kept", F.sha2("kept", 256).alias("digest")).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.digest for r in found)
