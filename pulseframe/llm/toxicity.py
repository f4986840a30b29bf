"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Words and word beginnings that mark toxic texts are learned first, as a lexicon with weights;
then trees are boosted over the density of lexicon words, their nearness to the second person,
and rates of capitals, marks and disguised words; then the trees' margin is made a probability.
Each of the three steps takes its own part of the labelled texts, so that no step trusts what an
earlier one has learned by heart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pulseframe.llm.components import saved

#: Labelled texts that the three steps use together, at most (in expectation).
LABELLED = 20_000
#: Parts of ten of the labelled texts: lexicon, trees, calibration.
PARTS = (4, 4, 2)
LEXICON = 5000
LEAST_TEXTS = 3
LEAST_WEIGHT = 2.0
BEGINNINGS = (3, 4, 5, 6)
NEAR = 5
TREES = 30
DEPTH = 4
THRESHOLD = 0.7

#: Words for the person spoken to, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro vuestra os".split()
)
WORD = re.compile(r"\w+(?:['’*@$!1|]+\w+)*")
LEET = str.maketrans("013457@$!|", "oieastasii")
RUN = re.compile(r"(\w)\1\1")
FEATURES = 20


def terms(word: str) -> list[str]:
    """A word and its beginnings, which are marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def plain(word: str) -> str:
    """A word without its disguise: digits and signs that stand for letters, and drawn-out letters."""
    if word.isalpha():
        return word
    return word.translate(LEET) if any(map(str.isalpha, word)) else word


@dataclass
class Lexicon:
    weights: dict[str, float]

    def weight(self, word: str) -> float:
        found = [self.weights[t] for t in terms(word) if t in self.weights]
        return max(found, default=0.0)


class Describer:
    """Features of texts; the weight of each word is looked up once."""

    KNOWN = 300_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def __call__(self, text: str) -> list[float]:
        raw = WORD.findall(text)
        n = len(raw)
        if not n:
            return [0.0] * FEATURES
        words = text.lower()
        words = WORD.findall(words) if len(words) == len(text) else [w.lower() for w in raw]
        known = self.known
        if len(known) > self.KNOWN:
            known.clear()
        for word in set(words).difference(known):
            known[word] = max(self.lexicon.weight(word), self.lexicon.weight(plain(word)))
        weights = np.fromiter(map(known.__getitem__, words), float, len(words))
        hits = np.flatnonzero(weights)
        count = len(hits)
        near = disguised = 0
        if count:
            persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            if persons:
                at = np.searchsorted(persons, hits)
                before = np.abs(hits - np.take(persons, np.maximum(at - 1, 0)))
                after = np.abs(np.take(persons, np.minimum(at, len(persons) - 1)) - hits)
                near = int((np.minimum(before, after) <= NEAR).sum())
            disguised = sum(not words[i].isalpha() for i in hits.tolist())
        strong = weights[hits]
        size = len(text)
        densest = 0.0
        if count:
            # Hits in the densest hundred words.
            densest = float(max(np.searchsorted(hits, hits + 100) - np.arange(count)))
        return [
            math.log1p(n),
            float(count),
            count / n,
            float(strong.sum()),
            float(strong.sum()) / n,
            float(strong.max()) if count else 0.0,
            float(len({words[i] for i in hits.tolist()})),
            densest,
            float((strong > 4).sum()),
            float((strong > 4).sum()) / n,
            float(near),
            near / n,
            sum(w in SECOND_PERSON for w in set(words)) / n,
            float(disguised),
            sum(map(str.isupper, raw)) / n,
            sum(map(str.isupper, text)) / size,
            text.count("!") / n,
            text.count("?") / n,
            sum(not w.isalpha() for w in set(words)) / n,
            len(RUN.findall(text)) / n,
        ]


def _term_counts(texts: DataFrame) -> DataFrame:
    """Texts with each term, by label."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {plain(w) for w in WORD.findall((text or "").lower())}
                counts[bool(toxic)].update({t for w in found for t in terms(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([counts[1][t] for t in names], pa.int64()),
                    pa.array([counts[0][t] for t in names], pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )

    return (
        texts.select("toxic", "text")
        .mapInArrow(counted, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def learn_lexicon(texts: DataFrame, size: int = LEXICON) -> Lexicon:
    """The ``size`` terms that tell most of ``toxic``, by the log of the odds and the number of texts."""
    total = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = total[0], total[1] - total[0]
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    kept = (
        _term_counts(texts)
        .withColumn("weight", weight)
        .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy((F.col("weight") * F.log1p("toxic")).desc(), "term")
        .limit(size)
    )
    return Lexicon({r["term"]: r["weight"] for r in kept.collect()})


def with_features(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "features") -> DataFrame:
    """All rows and columns, and the features of each whole text (null: zeros)."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(lexicon)
        for batch in batches:
            rows = [describe(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(described, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass
class Model:
    """``trees`` is None where the labels have one kind only; then every text scores ``share``."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _margin(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    made = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return made.withColumn("margin", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "vote")


def train(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled: int = LABELLED,
) -> Model:
    """A model from ``labels`` (``id_col, toxic``) and the texts of ``docs``.

    Of the labels a share chosen by hash is used, so that ``labelled`` are met in expectation;
    the texts used are written to the shared folder. Null labels and ids are left out, repeated
    ones count once.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, labelled / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("labelled")), F.lit(1 << 20))
    known = known.where(draw < int(share * (1 << 20))).select(F.col(id_col).alias("__id"), "toxic")
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("part")), F.lit(sum(PARTS)))
    # The ids are at most as many as the labels asked for.
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), part.alias("part")).join(
        F.broadcast(known), F.col(id_col) == F.col("__id")
    )
    texts = saved(spark, texts.select("text", F.col("toxic").cast("double").alias("toxic"), "part"), "labelled")
    lexicon = learn_lexicon(texts.where(F.col("part") < PARTS[0]))
    rows = with_features(texts.where(F.col("part") >= PARTS[0]), lexicon).select("toxic", "part", "features")
    rows = saved(spark, rows, "features")
    fitting, calibrating = (rows.where(c) for c in (F.col("part") < PARTS[0] + PARTS[1], F.col("part") >= PARTS[0] + PARTS[1]))
    kinds = [{r[0]: r[1] for r in x.groupBy("toxic").count().collect()} for x in (fitting, calibrating)]
    counts = Counter(kinds[0]) + Counter(kinds[1])
    if len(kinds[0]) < 2:
        return Model(lexicon, None, None, counts[1.0] / max(1, counts.total()))
    booster = GBTClassifier(
        featuresCol="vector", labelCol="toxic", predictionCol="vote", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7
    )
    # Few rows of few numbers: one task fits them faster than many.
    trees = booster.fit(fitting.withColumn("vector", array_to_vector("features")).coalesce(1))
    # A small calibration part of one kind would make all scores alike; then the trees' own stand.
    if len(kinds[1]) < 2:
        return Model(lexicon, trees, None, 0.0)
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score")
    return Model(lexicon, trees, isotonic.fit(_margin(calibrating, trees)), 0.0)


def with_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for each row: the calibrated probability of ``toxic``. Null and empty
    texts are scored like texts without hits. Other columns are left out."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    score: Column | str = "score"
    if model.trees is None:
        scored, score = source, F.lit(model.share)
    else:
        scored = _margin(with_features(source, model.lexicon).select("id", "features"), model.trees)
        if model.calibration is not None:
            scored = model.calibration.transform(scored)
        else:
            score = F.col("margin")
    bounded = F.least(F.greatest(F.col(score) if isinstance(score, str) else score, F.lit(0.0)), F.lit(1.0))
    return scored.select(F.col("id").alias(id_col), bounded.alias("score"))
