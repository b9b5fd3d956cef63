"""Active parameter sets on a stream of units, with keyed state.

Streams are dealt out to ``buckets`` by a hash of (stream, set id), and the state is that of a bucket: a call of Python, and of the state from there, costs milliseconds, which keys of a
dozen units do not bear. A call takes all keys of its bucket at once, in arrays. The state of a (stream, set id) is the sets of that id that a slice still to come may need, and the
slices that wait. A slice is settled when no earlier unit can come any more: a unit arrives before any unit of its stream whose number is larger by more than ``disorder``. So the
state of a key is bounded by what lies within ``disorder`` units, plus one set before it. The state of a bucket is written whole when units of it come: more buckets suit many keys of
which few have units in a micro-batch. Each micro-batch is evaluated once: of its slices a task holds a few numbers each while the sets of the same bucket come in, in any order.
In a query that keeps running, slices that still wait when no unit of their id has come for ``patience_ms`` are settled by a timer with what is known; a query that
ends with the files at hand leaves them in the state for its next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rdspark.operators.packets import SPS_TYPE

UNIT_COLUMNS = ["stream", "unit_no", "nal_type", "sps_id", "height", "width"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024      # fixed for the life of a checkpoint
_KEY = ["name", "nameless", "sps_id"]
_SETS, _SLICES, _NEWEST = [*_KEY, "unit_no", "height", "width"], [*_KEY, "unit_no", "nal_type", "since"], [*_KEY, "unit_no"]


def settled_slices(units: np.ndarray, set_units: np.ndarray, heights: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each slice the unit of the latest set before it, its height and width, and whether there is one. Sets ascend."""
    at = np.searchsorted(set_units, units, "left") - 1
    valid = at >= 0
    safe = np.maximum(at, 0)
    pick = lambda x: x[safe] if len(x) else np.zeros(len(units), np.int64)
    return pick(set_units), pick(heights), pick(widths), valid


class _ActiveSets(StatefulProcessor):
    """The state of one (stream, set id), written by entry: for few keys, whose sets are many."""

    def __init__(self, disorder: int, patience_ms: int | None):
        self.disorder, self.patience = disorder, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sets = handle.getMapState("sets", "unit long", "height int, width int")
        self.waiting = handle.getListState("waiting", "unit long, nal_type int")
        self.newest = handle.getValueState("newest", "unit long")

    def _out(self, key, units, kinds, known) -> pd.DataFrame:
        of = lambda k, kind: np.array([x[k] for x in known], kind)
        sets, height, width, valid = settled_slices(units, of(0, np.int64), of(1, np.int64), of(2, np.int64))
        one = lambda x, kind: pd.Series(x).astype(kind).where(pd.Series(valid))
        return pd.DataFrame({"stream": [key[0]] * len(units), "unit_no": units, "nal_type": kinds.astype(np.int32), "sps_id": np.full(len(units), key[1], np.int32),
                             "sps_unit": one(sets, "Int64"), "height": one(height, "Int32"), "width": one(width, "Int32"), "valid": valid})

    def _known(self) -> dict[int, tuple]:
        return {k[0]: (v[0], v[1]) for k, v in self.sets.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.newest.get()
        units, kinds, newest = [], [], int(last[0]) if last else -1
        stored = self._known()
        sets = dict(stored)      # a call of the state for each set that stays, not for each that comes
        for pdf in rows:
            newest = max(newest, int(pdf["unit_no"].max()))
            is_set = (pdf["nal_type"] == SPS_TYPE).to_numpy()
            for u, h, w in zip(*(pdf[c].to_numpy()[is_set].tolist() for c in ("unit_no", "height", "width"))):
                sets[int(u)] = (int(h), int(w))
            units.append(pdf.loc[~is_set, "unit_no"].to_numpy(np.int64))
            kinds.append(pdf.loc[~is_set, "nal_type"].to_numpy(np.int64))
        waited = self.waiting.exists()
        if waited:
            held = list(self.waiting.get())
            units.append(np.array([r[0] for r in held], np.int64))
            kinds.append(np.array([r[1] for r in held], np.int64))
        units, kinds = np.concatenate(units), np.concatenate(kinds)
        known, safe = sorted((u, h, w) for u, (h, w) in sets.items()), newest - self.disorder      # units up to ``safe`` have all come
        done = units <= safe
        if done.any():
            yield self._out(key, units[done], kinds[done], known)
        self.newest.update((newest,))
        if done.all():
            if waited:
                self.waiting.clear()
        else:
            self.waiting.put([(int(u), int(k)) for u, k in zip(units[~done], kinds[~done])])
            if self.patience is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        gone = {u for u in [u for u, _, _ in known if u <= safe][:-1]}      # the last one before ``safe`` may still be needed, earlier ones not
        for u, value in sets.items():
            if u not in gone and stored.get(u) != value:
                self.sets.updateValue((u,), value)
        for u in gone & stored.keys():
            self.sets.removeKey((u,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        self.waiting.clear()
        yield self._out(key, np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64),
                        sorted((u, h, w) for u, (h, w) in self._known().items()))

    def close(self) -> None:
        pass


def _packed(df: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().to_pandas()


def _joined(frames: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    kept = [f[columns] for f in frames if len(f)]
    return pd.concat(kept, ignore_index=True) if kept else frames[0][columns].reset_index(drop=True)


def _known_to(slices: pd.DataFrame, codes: np.ndarray, sets: pd.DataFrame, set_codes: np.ndarray) -> pd.DataFrame:
    """Slices with the latest set of their key before them. ``codes`` number the keys; sets ascend by (code, unit)."""
    code, unit = np.concatenate([codes, set_codes]), np.concatenate([slices["unit_no"].to_numpy(np.int64), sets["unit_no"].to_numpy(np.int64)])
    order = np.lexsort((unit, code))
    place = np.empty(len(order), np.int64)      # of (key, unit) among all; equal ones share it
    place[order] = np.cumsum(np.concatenate([[0], (np.diff(code[order]) != 0) | (np.diff(unit[order]) != 0)])[:len(order)])
    _, at, owner, valid = settled_slices(place[:len(codes)], place[len(codes):], np.arange(len(sets)), set_codes)
    valid = valid & (owner == codes)

    def one(column: str, kind: str) -> pd.Series:
        values = sets[column].to_numpy()[at] if len(sets) else np.zeros(len(codes))
        return pd.Series(values).astype(kind).where(pd.Series(valid))
    return pd.DataFrame({"name": slices["name"].to_numpy(), "nameless": slices["nameless"].to_numpy(), "unit_no": slices["unit_no"].to_numpy(np.int64), "nal_type": slices["nal_type"].to_numpy(np.int32),
                         "sps_id": slices["sps_id"].to_numpy(np.int32), "sps_unit": one("unit_no", "Int64"), "height": one("height", "Int32"), "width": one("width", "Int32"), "valid": valid})


def _numbered(*frames: pd.DataFrame) -> tuple[list[np.ndarray], pd.DataFrame]:
    """The number of the key of each row, and the key of each number."""
    keys = pd.concat([f[_KEY] for f in frames], ignore_index=True)
    codes = keys.groupby(_KEY, sort=False).ngroup().to_numpy()
    _, first = np.unique(codes, return_index=True)
    return np.split(codes, np.cumsum([len(f) for f in frames])[:-1]), keys.iloc[first].reset_index(drop=True)


class _BucketSets(StatefulProcessor):
    """The state of all keys of a bucket."""

    def __init__(self, disorder: int, patience_ms: int | None):
        self.disorder, self.patience = disorder, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "newest binary, sets binary, waiting binary")

    def _wake(self, waiting: pd.DataFrame) -> None:
        """One timer, for the key that has waited longest."""
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if len(waiting):
                self.handle.registerTimer(int(waiting["since"].min()) + self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.patience is None else timerValues.getCurrentProcessingTimeInMs()
        slices, sets = [], []
        for pdf in rows:
            is_set = (pdf["nal_type"] == SPS_TYPE).to_numpy()
            sets.append(pdf.loc[is_set, _SETS].astype({"sps_id": np.int32, "unit_no": np.int64, "height": np.float64, "width": np.float64}))
            slices.append(pdf.loc[~is_set, _SLICES[:-1]].astype({"sps_id": np.int32, "unit_no": np.int64, "nal_type": np.int32}).assign(since=now))
        held = self.state.get()
        newest, stored, waiting = (_unpacked(x) for x in held) if held else (sets[0].iloc[:0][_NEWEST], sets[0].iloc[:0], slices[0].iloc[:0])
        slices, sets = _joined([waiting, *slices], _SLICES), _joined([stored, *sets], _SETS)
        (of_newest, of_slices, of_sets), keys = _numbered(newest, slices, sets)
        came, came_sets = slice(len(waiting), None), slice(len(stored), None)

        top, touched = np.full(len(keys), -1, np.int64), np.zeros(len(keys), bool)
        touched[of_slices[came]] = touched[of_sets[came_sets]] = True
        for code, unit in ((of_newest, newest), (of_slices[came], slices.iloc[came]), (of_sets[came_sets], sets.iloc[came_sets])):
            np.maximum.at(top, code, unit["unit_no"].to_numpy(np.int64))
        safe = top - self.disorder      # units up to ``safe`` have all come
        order = np.lexsort((sets["unit_no"].to_numpy(), of_sets))      # stable: of equal units the one that came last stays
        unit, code = sets["unit_no"].to_numpy()[order], of_sets[order]
        order = order[np.append((np.diff(code) != 0) | (np.diff(unit) != 0), np.ones(min(1, len(order)), bool))]
        sets, of_sets = sets.iloc[order], of_sets[order]
        done = slices["unit_no"].to_numpy(np.int64) <= safe[of_slices]
        if done.any():
            yield _known_to(slices[done], of_slices[done], sets, of_sets)

        waiting = slices[~done]
        if len(waiting):
            waiting = waiting.assign(since=np.where(touched[of_slices[~done]], now, waiting["since"].to_numpy(np.int64)))
        past = sets["unit_no"].to_numpy(np.int64) <= safe[of_sets]
        gone = np.zeros(len(sets), bool)
        gone[:-1] = past[:-1] & past[1:] & (np.diff(of_sets) == 0)      # the last one before ``safe`` may still be needed, earlier ones not
        self.state.update((_packed(keys.assign(unit_no=top)), _packed(sets[~gone]), _packed(waiting)))
        self._wake(waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held:
            newest, sets, waiting = (_unpacked(x) for x in held)
            due = (waiting["since"] + self.patience <= max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())).to_numpy()
            if due.any():
                (of_slices, of_sets), _ = _numbered(waiting[due], sets)
                order = np.lexsort((sets["unit_no"].to_numpy(), of_sets))
                yield _known_to(waiting[due], of_slices, sets.iloc[order], of_sets[order])
            self.state.update((bytes(held[0]), bytes(held[1]), _packed(waiting[~due])))
            self._wake(waiting[~due])

    def close(self) -> None:
        pass


def _spelt(kind: str) -> tuple[Column, Column]:
    """The name of a stream as a number or a text, which pandas keeps exactly where nulls are, and back."""
    stream, name = F.col("stream"), F.col("name")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(stream.cast("bigint"), F.lit(0).cast("bigint")), name.cast(kind)
    if kind == "binary":
        return F.coalesce(F.hex(stream), F.lit("")), F.unhex(name)
    if kind.startswith(("array", "struct")):
        return F.to_json(F.struct("stream")), F.from_json(name, f"stream {kind}")["stream"]
    return F.coalesce(stream.cast("string"), F.lit("")), name.cast(kind)


def active_sets(units: DataFrame, disorder: int = 0, patience_ms: int | None = None, buckets: int | None = BUCKETS) -> DataFrame:
    """Slices of a stream of units (UNIT_COLUMNS) with their sets, once each, as soon as they are settled.

    With ``disorder`` 0 units of a stream come in order across micro-batches, in any order inside one, and nothing waits. The state needs the RocksDB store.
    Without ``buckets`` each (stream, set id) has a state of its own, written by entry: for few keys of many sets, in streams that have a name.
    """
    kind, time_mode = units.schema["stream"].dataType.simpleString(), "None" if patience_ms is None else "ProcessingTime"
    out = "unit_no long, nal_type int, sps_id int, sps_unit long, height int, width int, valid boolean"
    if buckets is None:
        slim = units.select("stream", F.col("unit_no").cast("long").alias("unit_no"), "nal_type", "sps_id", "height", "width")
        return slim.groupBy("stream", "sps_id").transformWithStateInPandas(_ActiveSets(disorder, patience_ms), f"stream {kind}, {out}", outputMode="Append", timeMode=time_mode)
    spelt, back = _spelt(kind)
    slim = units.select(F.pmod(F.xxhash64("stream", "sps_id"), F.lit(buckets)).cast("int").alias("bucket"), spelt.alias("name"), F.col("stream").isNull().alias("nameless"),
                        F.col("unit_no").cast("long").alias("unit_no"), "nal_type", "sps_id", "height", "width")
    named = f"name {slim.schema['name'].dataType.simpleString()}, nameless boolean, {out}"
    found = slim.groupBy("bucket").transformWithStateInPandas(_BucketSets(disorder, patience_ms), named, outputMode="Append", timeMode=time_mode)
    return found.select(F.when(~F.col("nameless"), back).alias("stream"), *[c for c in found.columns if c not in ("name", "nameless")])


def stateful_packets(units: DataFrame, folder: str, checkpoint: str, once: bool = True, disorder: int = 0, patience_ms: int = 60_000, buckets: int | None = BUCKETS) -> StreamingQuery:
    """Resolve the slices of a stream of units. ``folder/slices`` gets them under the number of their micro-batch, so a replayed one overwrites itself."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/slices/batch_id={batch_id}")

    spark, name = units.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        # A timer would keep a query going that is to end.
        running = active_sets(units, disorder, None if once or not disorder else patience_ms, buckets)
        writer = running.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
