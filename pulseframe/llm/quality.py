"""Quality by positive-unlabelled learning with a non-negative unbiased risk.

The classifier sees trusted positives and unlabelled web text. With ``p`` the share of good
texts, the risk of calling good text bad is measured on the positives, and that of calling bad
text good is the unlabelled texts' less ``p`` times the positives'. The second part can't truly
be negative; where it falls below zero, the step goes the other way, which keeps the model from
learning the sample by heart.

A text is described by rates that no language or site determines: capitals, symbols, repeats,
separators, lengths. Each is cut at quantiles, and the model adds a weight for each bin.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulseframe.llm.components import saved

#: Rows the model is fitted on at most (in expectation): positives, and unlabelled texts.
POSITIVES = 20_000
UNLABELLED = 40_000
BINS = 16
STEPS = 400
RATE = 0.05
DECAY = 1e-3
#: Score from which a text is taken as good.
THRESHOLD = 0.7

SYMBOLS = re.compile(rb"[%*$#&@^~=+_<>\\|{}\[\]]{2,}")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
MEASURES = 22


def measures(text: str) -> list[float]:
    """Rates of one text; a text without words has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    data = text.encode("utf-8", "replace")
    size = len(data)
    triples = max(1, n - 2)
    sentences = text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + 1
    lines = text.split("\n")
    lengths = sum(map(len, words))
    sample = [len(zlib.compress(data[i : i + 32_768], 1)) / min(32_768, size - i) for i in range(0, size, 32_768)]
    upper = sum(map(str.isupper, words))
    return [
        math.log1p(n),
        upper / n,
        sum(map(str.istitle, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples,
        len(SYMBOLS.findall(data)) / n,
        data.count(b"|") / n,
        data.count(b"!") / n,
        data.count(b"http") / n,
        (data.count(b".") + data.count(b",")) / n,
        sum(map(str.isalpha, words)) / n,
        lengths / n,
        1 - len(data.translate(None, LETTERS)) / size,
        1 - len(data.translate(None, b"0123456789")) / size,
        n / sentences,
        n / len(lines),
        len(set(lines)) / len(lines),
        len(max(words, key=len)),
        sum(sample) / len(sample),
        max(sample),
        min(sample),
    ]


@dataclass
class Model:
    """Cut points of each measure, the weight of each bin, and a constant."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    constant: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.places(rows)].sum(axis=1) + self.constant

    def places(self, rows: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, rows[:, i], "right") for i, c in enumerate(self.cuts)]
        return np.stack(bins, axis=1) + np.arange(len(self.cuts)) * (BINS + 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk with the logistic loss by Adam."""
    both = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        # Nothing to learn from: every text scores the prior.
        margin = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model([np.zeros(0)] * MEASURES, np.zeros(MEASURES * (BINS + 1)), margin)
    cuts = [np.unique(np.quantile(both[:, i], np.arange(1, BINS) / BINS)) for i in range(MEASURES)]
    model = Model(cuts, np.zeros(MEASURES * (BINS + 1)), 0.0)
    p, u = model.places(positive), model.places(unlabelled)
    size = len(model.weights) + 1
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        at_p = 1 / (1 + np.exp(-(model.weights[p].sum(axis=1) + model.constant)))
        at_u = 1 / (1 + np.exp(-(model.weights[u].sum(axis=1) + model.constant)))
        bad = np.mean(-np.log(np.clip(1 - at_u, 1e-12, 1))) - prior * np.mean(-np.log(np.clip(1 - at_p, 1e-12, 1)))
        sign = 1.0 if bad >= 0 else -1.0
        to_p = (prior * (at_p - 1) * (bad >= 0) - sign * prior * at_p) / len(p)
        to_u = sign * at_u / len(u)
        slope = np.zeros(size)
        for places, part in ((p, to_p), (u, to_u)):
            slope[:-1] += np.bincount(places.ravel(), np.repeat(part, places.shape[1]), size - 1)
            slope[-1] += part.sum()
        slope[:-1] += DECAY * model.weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights -= move[:-1]
        model.constant -= float(move[-1])
    return model


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["trusted", "measures"]
            )

    return docs.select("trusted", F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, "trusted boolean, measures array<double>"
    )


def _some(key: Column, share: float) -> Column:
    """A fixed share of rows by a hash of the key."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model:
    """A model from ``labels`` (``id_col, quality``) and the texts of ``docs``.

    Only the texts of rows labelled 1 are looked up. The prior is estimated as the share of 1
    among the labels, which stand for the corpus as they are drawn from it; no text labelled 0 is
    told apart from an unlabelled one. Of both kinds of text a share chosen by hash is used, so that
    the given numbers are met in expectation: the driver gets some 22 numbers for each of them,
    whatever the size of the corpus. Null labels and ids are left out, repeated ones count once.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("quality"))
    counts = known.agg(F.count("*"), F.coalesce(F.sum(F.col("quality").cast("long")), F.lit(0))).first()
    prior = min(0.99, max(0.01, (counts[1] + 1) / (counts[0] + 2)))
    good = known.where((F.col("quality") == 1) & _some(F.col(id_col), min(1.0, positives / max(1, counts[1]))))
    good = good.select(F.col(id_col).alias("__good"))
    share = min(1.0, unlabelled / max(1, docs.count()))
    # The ids are at most as many as the positives asked for.
    marked = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(good), F.col(id_col) == F.col("__good"), "left")
    trusted = marked.select(F.col("__good").isNotNull().alias("trusted"), F.col(id_col), F.col(text_col))
    used = trusted.where(F.col("trusted") | _some(F.coalesce(F.col(id_col).cast("string"), F.lit("")), share))
    # Measured by all tasks and written first: read back, it is some numbers for each text of the sample.
    p, u = [], []
    for row in saved(docs.sparkSession, _measured(used, text_col), "sample").collect():
        (p if row["trusted"] else u).append(row["measures"])
    # A trusted text is a text like any other, too: those drawn make up their part of the unlabelled.
    shape = lambda x: np.array(x, float).reshape(-1, MEASURES)
    p, u = shape(p), shape(u)
    if len(p):
        kept = np.random.default_rng(0).random(len(p)) < share
        u = np.concatenate([u, p[kept]])
    return fit(p, u, prior)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns, and the score of each whole text, from 0 to 1. Null and empty
    texts are scored as texts with all rates at zero. A column of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()], float).reshape(-1, MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows))], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id never does."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))
