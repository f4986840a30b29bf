"""Repeatable random numbers: the same seed and keys give the same draw under any partitioning,
and in any engine that has MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers taken from one digest, and hexadecimal digits of each.
PER_DIGEST = 4
DIGITS = 8


def digest_uniforms(seed: int, keys: list[Column], count: int) -> list[Column]:
    """``count`` numbers in (0, 1) by counter: number n is the (n mod 4)th quarter of the MD5 of
    seed, keys and n div 4 as text with bars between, offset by half a step so 0 cannot occur."""
    text = [F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]]
    digests = [F.md5(F.concat_ws("|", *text, F.lit(str(n)))) for n in range(math.ceil(count / PER_DIGEST))]
    parts = [F.substring(digests[n // PER_DIGEST], 1 + DIGITS * (n % PER_DIGEST), DIGITS) for n in range(count)]
    return [(F.conv(p, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS)) for p in parts]


def digest_normals(seed: int, keys: list[Column], count: int) -> list[Column]:
    """``count`` standard normal numbers (Box-Muller), number n from uniforms 2n and 2n + 1."""
    u = digest_uniforms(seed, keys, 2 * count)
    return [
        F.sqrt(F.lit(-2.0) * F.log(u[2 * n])) * F.cos(F.lit(2.0 * math.pi) * u[2 * n + 1]) for n in range(count)
    ]
