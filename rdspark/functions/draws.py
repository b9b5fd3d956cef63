"""Repeatable random draws: pure functions of (seed, epoch, id, use), so a lost task redraws the same.

The mix is plain integer arithmetic below 2**62. It can be written in any SQL dialect and does not
depend on how the rows are partitioned. Text ids go through ``xxhash64`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rdspark.functions.results import col

PRIME = 2147483647


def mix(id_, epoch, seed: int, use: int) -> Column:
    """Integer in [0, PRIME)."""
    m = F.lit(PRIME)
    start = (F.pmod(col(id_).cast("bigint"), m) * 48271
             + F.pmod(_int(epoch), m) * 69621 + F.lit((seed * 16807 + use * 40692 + 12345) % PRIME))
    first = F.pmod(start, m)
    second = F.pmod(first * first + first * 30323 + F.lit(use * 7919 + 1), m)
    return F.pmod(second * 16807 + first, m)


def mix_sql(id_: str, epoch: str, seed: int, use: int) -> str:
    """The same draw as portable SQL text."""
    first = (f"((({id_}) % {PRIME}) * 48271 + (({epoch}) % {PRIME}) * 69621 + "
             f"{(seed * 16807 + use * 40692 + 12345) % PRIME}) % {PRIME}")
    second = f"(({first}) * ({first}) + ({first}) * 30323 + {use * 7919 + 1}) % {PRIME}"
    return f"((({second}) * 16807 + ({first})) % {PRIME})"


def below(limit, id_, epoch, seed: int, use: int) -> Column:
    """Integer in [0, limit); 0 when limit is not positive."""
    top = col(limit) if not isinstance(limit, int) else F.lit(limit)
    return F.pmod(mix(id_, epoch, seed, use), F.greatest(top, F.lit(1)).cast("bigint"))


def _int(v) -> Column:
    return F.lit(v).cast("bigint") if isinstance(v, int) else col(v).cast("bigint")
