"""The catalogue of workout actions and the lookups against it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Intensity order and the blocks that make up the catalogue.
INTENSITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
WORKOUT_TYPES = ("REST", "RECOVERY", "STRENGTH", "CARDIO")
BLOCKS = (
    ("REST", ("NONE",), (0,)),
    ("RECOVERY", ("LOW",), (20, 30)),
    ("STRENGTH", ("LOW", "MEDIUM", "HIGH"), (30, 45)),
    ("CARDIO", ("LOW", "MEDIUM", "HIGH"), (20, 30, 45)),
)


# How each workout type is described.
DESCRIPTIONS = {
    "REST": "Rest day - no training",
    "RECOVERY": "Recovery session - {minutes} minutes",
    "STRENGTH": "Strength training - {intensity} intensity, {minutes} min",
    "CARDIO": "Cardio - {intensity} intensity, {minutes} min",
}

ACTIONS = [
    (
        i,
        workout,
        intensity,
        minutes,
        DESCRIPTIONS[workout].format(intensity=intensity, minutes=minutes),
        INTENSITY_RANK[intensity],
    )
    for i, (workout, intensity, minutes) in enumerate(
        (w, level, m) for w, levels, lengths in BLOCKS for level, m in product(levels, lengths)
    )
]
ACTION_COUNT = len(ACTIONS)
ALL_IDS = [a[0] for a in ACTIONS]


def ids_within(types: tuple[str, ...] = WORKOUT_TYPES, max_intensity: str = "HIGH") -> list[int]:
    """Ids of the given workout types up to an intensity, ascending."""
    top = INTENSITY_RANK.get(max_intensity, INTENSITY_RANK["HIGH"])
    return [a[0] for a in ACTIONS if a[1] in types and a[5] <= top]


def ids_of_intensity(intensity: str) -> list[int]:
    return [a[0] for a in ACTIONS if a[2] == intensity]


def id_array(ids: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in ids])


def catalogue(spark: SparkSession) -> DataFrame:
    """The 18 actions as a local relation."""
    rows = ", ".join(f"({i}, '{w}', '{level}', {m}, '{text}', {rank})" for i, w, level, m, text, rank in ACTIONS)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(action_id, workout_type, intensity, "
        "duration_minutes, description, intensity_rank)"
    )


def decorate(df: DataFrame, how: str = "inner") -> DataFrame:
    """Add the attributes of ``action_id``. The catalogue has 18 rows, so it is broadcast.

    Rows on no known action are left out; ``posterior.rejected_feedback`` returns them with the reason.
    """
    return df.join(F.broadcast(catalogue(df.sparkSession)), "action_id", how)


def resolve(df: DataFrame) -> DataFrame:
    """Add ``action_id`` for (workout_type, intensity, duration_minutes); unknown keys give 0."""
    keys = ["workout_type", "intensity", "duration_minutes"]
    ids = catalogue(df.sparkSession).select(*keys, "action_id")
    return df.join(F.broadcast(ids), keys, "left").withColumn("action_id", F.coalesce("action_id", F.lit(0)))


def _catalogue_literal() -> Column:
    entry = lambda a: F.struct(F.lit(a[0]).alias("id"), F.lit(a[1]).alias("type"), F.lit(a[5]).alias("rank"))
    return F.array(*[entry(a) for a in ACTIONS])


def within_limits(types: Column, max_intensity: Column) -> Column:
    """Ids allowed by per-row limits: an array of types and an intensity name (unknown means HIGH)."""
    top = F.coalesce(
        *[F.when(max_intensity == name, F.lit(rank)) for name, rank in INTENSITY_RANK.items()],
        F.lit(INTENSITY_RANK["HIGH"]),
    )
    fits = F.filter(_catalogue_literal(), lambda a: F.array_contains(types, a["type"]) & (a["rank"] <= top))
    return F.transform(fits, lambda a: a["id"])
