"""Scans in order: numbers, running sums and carried values over rows sorted by (keys, order), in one pass of the rows.

Rows are dealt out by range of (keys, order) and sorted, so a key with a third of all rows lies in many tasks and positions may be as sparse as they
like. A task numbers, sums and carries inside the runs of equal keys that it has, an Arrow batch at a time; it holds two batches. Only
the first run of a task can go on from the tasks before it. What the earlier tasks hand on is read from the first and last row of each task, two rows a task: a window
over these combines them in order, and the few results meet the rows by task number. Rows go through one shuffle and are
written once to the shared folder, so that the numbers of a lost and repeated task stay what they were.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from rdspark.functions.results import col
from rdspark.sources.storage import stored


def changes(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether a row's keys differ from those of the row before it; nulls equal nulls. ``before`` is the row before the batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        here = batch.column(k)
        last = pa.concat_arrays([before.column(k), here.slice(0, n - 1)]) if before is not None else pa.concat_arrays([here.slice(0, 1), here.slice(0, n - 1)])
        if pa.types.is_floating(here.type):
            here, last = here.cast(pa.string()), last.cast(pa.string())      # NaN equals NaN
        differ = pc.fill_null(pc.not_equal(here, last), False).to_numpy(zero_copy_only=False)
        new |= differ | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(last).to_numpy(zero_copy_only=False))
    new[0] |= before is None
    return new


class _Run:
    """What a task knows of the run it is in."""

    def __init__(self, sums: int):
        self.before, self.at, self.number, self.sums, self.carried = None, 0, 0, [0] * sums, {}


def _scanned(batch: pa.RecordBatch, run: _Run, keys, sums: list[str], carries: list[str]) -> list[pa.Array]:
    """Index in the task, number in the run, sums before the row, carried values; moves ``run`` to the end of the batch."""
    n = batch.num_rows
    place = np.arange(n)
    new = changes(batch, keys, run.before)
    start = np.maximum.accumulate(np.where(new, place, -1))      # -1: the run began before this batch
    own = start >= 0
    out = [pa.array(run.at + place, pa.int64()), pa.array(np.where(own, place - start, run.number + place), pa.int64())]
    for k, name in enumerate(sums):
        value = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(value)
        ahead = total - value
        out.append(pa.array(np.where(own, ahead - ahead[np.maximum(start, 0)], run.sums[k] + ahead), pa.int64()))
        run.sums[k] = int(total[-1] - ahead[start[-1]]) if own[-1] else run.sums[k] + int(total[-1])
    for name in carries:
        values = batch.column(name)
        found = np.maximum.accumulate(np.where(pc.is_valid(values).to_numpy(zero_copy_only=False), place, -1))
        found = np.where(found >= start, found, -1)
        earlier = run.carried.get(name)
        # Position 0 is what came before the batch, for rows of that run which have met no value yet.
        both = pa.concat_arrays([earlier if earlier is not None else pa.nulls(1, values.type), values])
        at = np.where(found >= 0, found + 1, 0)
        none = (found < 0) & own
        out.append(both.take(pa.array(at, mask=none)))
        run.carried[name] = out[-1].slice(n - 1, 1)
    run.number = int(out[1][n - 1].as_py()) + 1
    run.at += n
    run.before = batch.slice(n - 1, 1).select(list(keys))
    return out


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], number: str | None = None, sums: Mapping[str, str | Column] | None = None,
                 carry: Mapping[str, str | Column] | None = None) -> DataFrame:
    """``df`` with columns that depend on the rows before each row of its group (``keys``) in ``order`` (ascending, nulls first).

    ``number``   name of a 0-based row number
    ``sums``     name to an integer column: its sum over the rows before, without the row itself; nulls count as 0
    ``carry``    name to a column: its latest value that is not null, at the row or before it

    Rows of equal keys and order stand in any order, the same whenever the result is read.
    """
    spark, keys, sums, carry = df.sparkSession, list(keys), dict(sums or {}), dict(carry or {})
    given = df.columns
    inner_sums, inner_carry = [f"__s{k}" for k in range(len(sums))], [f"__c{k}" for k in range(len(carry))]
    by = [F.col(k) for k in keys] + [o if isinstance(o, Column) else F.col(o) for o in order]
    rows = df.withColumns({**{n: col(c).cast("long") for n, c in zip(inner_sums, sums.values())}, **{n: col(c) for n, c in zip(inner_carry, carry.values())}})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    results = ["__at", "__n", *(f"__before{k}" for k in range(len(sums))), *(f"__last{k}" for k in range(len(carry)))]
    types = [T.LongType()] * (2 + len(sums)) + [rows.schema[c].dataType for c in inner_carry]
    kept = [f for f in rows.schema.fields if f.name not in inner_carry]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(results, types)), T.StructField("__part", T.IntegerType()), T.StructField("__edge", T.IntegerType())])
    names = [f.name for f in kept]

    def scan(batches):
        from pyspark import TaskContext
        part, run, held = TaskContext.get().partitionId(), _Run(len(inner_sums)), None

        def finished(batch, made, last):
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] += made[0][0].as_py() == 0      # the first row of the task
            edge[-1] += 2 * last
            arrays = [*(batch.column(n) for n in names), *made, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(edge)]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *results, "__part", "__edge"])
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield finished(*held, False)
            held = (batch, _scanned(batch, run, keys, inner_sums, inner_carry))
        if held is not None:
            yield finished(*held, True)
    table = stored(dealt.mapInArrow(scan, schema), "ordered")

    # Two rows a task: what its last run has so far, and where its first run goes on.
    edges = table.where("__edge > 0")
    ends = {"__n": F.col("__n") + 1, **{f"__before{k}": F.col(f"__before{k}") + F.coalesce(F.col(n), F.lit(0)) for k, n in enumerate(inner_sums)},
            **{f"__last{k}": F.col(f"__last{k}") for k in range(len(carry))}}
    last = edges.where("__edge >= 2").select(*keys, "__part", F.lit(True).alias("__end"), *[v.alias(n) for n, v in ends.items()])
    first = edges.where("__edge % 2 = 1").select(*keys, "__part", F.lit(False).alias("__end"), *[F.lit(None).cast(table.schema[n].dataType).alias(n) for n in ends])
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rangeBetween(W.unboundedPreceding, -1)
    offset = {n: F.last(n, ignorenulls=True).over(earlier) if n.startswith("__last") else F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in ends}
    before = last.unionByName(first).select("__part", "__end", *[v.alias(f"{n}_o") for n, v in offset.items()]).where("not __end").drop("__end")

    met = table.join(F.broadcast(before), "__part", "left")      # one row a task
    goes_on = F.col("__n") == F.col("__at")      # of the first run of the task
    more = lambda n: F.col(n) + F.when(goes_on, F.col(f"{n}_o")).otherwise(0)
    out = [more("__n").alias(number)] if number else []
    out += [more(f"__before{k}").alias(n) for k, n in enumerate(sums)]
    out += [F.coalesce(F.col(f"__last{k}"), F.when(goes_on, F.col(f"__last{k}_o"))).alias(n) for k, n in enumerate(carry)]
    made = {c for c in [number, *sums, *carry] if c}
    return met.select(*[F.col(f"`{c}`") for c in given if c not in made], *out)


def contiguous_prefix(frames: DataFrame, keys: Sequence[str], number: str, start: int = 1) -> DataFrame:
    """Frames ``start``, ``start + 1`` ... of each group up to the first missing number."""
    ranked = ordered_scan(frames.filter(F.col(number) >= start), keys, [number], number="__seen")
    return ranked.filter(F.col(number) == F.col("__seen") + start).drop("__seen")
