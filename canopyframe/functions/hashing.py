"""Counter-based pseudo-random numbers from integer arithmetic.

The text is plain SQL on BIGINT values, so results depend only on the row's own keys (never on
partitioning) and any engine with 64-bit integers reproduces them.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

MODULUS = 2147483647


def mix_sql(*parts: str | int) -> str:
    """SQL text of a non-linear hash of the given integer expressions, in [0, 2^31 - 2]."""
    weights = (1000003, 7919, 104729, 15485863, *(2 * (48271 * i % 7_000_001) + 1 for i in range(4, len(parts))))
    body = " + ".join(f"(CAST({p} AS BIGINT) % {MODULUS}) * {w}" for p, w in zip(parts, weights))
    h = f"(({body} + 12345) % {MODULUS})"
    for _ in range(2):
        h = f"((({h} * {h}) % {MODULUS} * 48271 + 11) % {MODULUS})"
    return h


def mix(*parts: str | int) -> Column:
    return F.expr(mix_sql(*parts))


def uniform_sql(*parts: str | int) -> str:
    return f"(CAST({mix_sql(*parts)} AS DOUBLE) / {MODULUS})"


def uniform(*parts: str | int) -> Column:
    return F.expr(uniform_sql(*parts))


def normal_sql(*parts: str | int) -> str:
    """Standard normal deviate by Box and Muller from two independent hashes."""
    a = mix_sql(*parts, 101)
    b = mix_sql(*parts, 202)
    u = f"((CAST({a} AS DOUBLE) + 1) / {MODULUS + 1})"
    v = f"(CAST({b} AS DOUBLE) / {MODULUS})"
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def normal(*parts: str | int) -> Column:
    return F.expr(normal_sql(*parts))
