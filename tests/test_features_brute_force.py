"""The feature table against a direct evaluation of its definitions, user by user."""

import math

import numpy as np
import pytest

from pulseframe.operators import features as ft
from pulseframe.plans.inputs import source


def frame(values, i, n):
    return values[max(0, i - n + 1) : i + 1]


def mean(values):
    seen = [v for v in values if v is not None]
    return sum(seen) / len(seen) if seen else None


def total(values):
    seen = [v for v in values if v is not None]
    return sum(seen) if seen else None


def slope(values):
    if all(v is None for v in values) or None in values:
        return None
    return 0.0 if len(values) == 1 else float(np.polyfit(range(len(values)), values, 1)[0])


def expected(rows, i, name):
    col = lambda c: [r[c] for r in rows]
    x = lambda c: rows[i][c]
    if name == "hrv_7d_zscore":
        seen = [v for v in frame(col("hrv"), i, 7) if v is not None]
        if x("hrv") is None or len(seen) < 2:
            return None
        return (x("hrv") - mean(seen)) / (float(np.std(seen, ddof=1)) + 1e-6)
    if name in ("hrv_trend", "readiness_trend"):
        return slope(frame(col({"hrv_trend": "hrv", "readiness_trend": "readiness_score"}[name]), i, 3))
    if name == "rhr_deviation":
        seen = [v for v in col("resting_hr") if v is not None]
        return None if x("resting_hr") is None else x("resting_hr") - float(np.median(seen))
    if name == "sleep_debt":
        rested = mean(frame(col("sleep_duration_hours"), i, 3))
        return None if rested is None else max(0.0, 8 - rested)
    if name == "acwr":
        acute, chronic = (mean(frame(col("active_calories"), i, n)) for n in (3, 7))
        return None if acute is None else acute / (chronic + 1e-6)
    if name == "streak":
        run = 0
        for r in rows[: i + 1]:
            run = run + 1 if r["completion"] == 1 else 0
        return run
    if name == "days_since_training":
        last = max((k for k in range(i + 1) if rows[k]["completion"] == 1), default=0)
        return i - last
    if name == "day_of_week":
        return x("date").weekday()
    if name == "is_weekend":
        return int(x("date").weekday() >= 5)
    raise KeyError(name)


ROLLING = {
    "hrv_7d_mean": ("hrv", 7, mean),
    "rhr_7d_mean": ("resting_hr", 7, mean),
    "sleep_7d_mean": ("sleep_duration_hours", 7, mean),
    "readiness_7d_mean": ("readiness_score", 7, mean),
    "steps_7d_sum": ("steps", 7, total),
    "steps_7d_mean": ("steps", 7, mean),
    "calories_7d_sum": ("active_calories", 7, total),
    "calories_3d_sum": ("active_calories", 3, total),
    "activity_7d_mean": ("activity_score", 7, mean),
    "completion_7d_rate": ("completion", 7, mean),
}
OTHERS = (
    "hrv_7d_zscore hrv_trend readiness_trend rhr_deviation sleep_debt acwr streak days_since_training day_of_week is_weekend"
).split()


@pytest.fixture(scope="module")
def tables(spark, folder):
    day = source(spark, folder, "day")
    users: dict[int, list[dict]] = {}
    for r in sorted((r.asDict() for r in day.collect()), key=lambda r: (r["user_id"], r["date"])):
        users.setdefault(r["user_id"], []).append(r)
    got = {(r.user_id, r.date): r for r in ft.daily_features(day).collect()}
    return users, got


@pytest.mark.parametrize("name", [*ROLLING, *OTHERS])
def test_feature(tables, name):
    users, got = tables
    assert sum(map(len, users.values())) == len(got)
    for user, rows in users.items():
        for i, row in enumerate(rows):
            if name in ROLLING:
                column, n, how = ROLLING[name]
                want = how(frame([r[column] for r in rows], i, n))
            else:
                want = expected(rows, i, name)
            value = got[user, row["date"]][name]
            if want is None:
                assert value is None, (user, row["date"])
            else:
                assert math.isclose(value, want, rel_tol=1e-9, abs_tol=1e-7), (user, row["date"], value, want)
