"""Keys of documents met in packed form: blobs of keys by bucket instead of a row for each key.

In a blob a key has four bytes, and mostly one for the distance of its owner from the owner of the key before. Owners are numbered within what a task
hands on at once, and their names are handed on once, not with each bucket: so a key costs the same five bytes however many buckets there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rdspark.llm.words import mix

#: Keys that a task holds before it hands them on.
HELD = 1 << 21
#: Owners that a task holds at most: their numbers have 16 bits, the rest of a long says which parcel they are of.
OWNERS = 60_000
BLOB = "bucket int, parcel long, keys binary, owners binary"
_STEP = 255


class Packer:
    """Collects (owner, keys) and gives blobs: of a key the bucket and its upper 32 bits are kept. Keys of a bucket that agree in these by chance, 1 in 2^32 of
    its pairs, count as equal. The names of the owners come as rows of the buckets from ``buckets`` on."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.owners, self.held = np.uint64(buckets), [], [], 0

    def add(self, owner: int, keys: np.ndarray):
        self.keys.append(keys)
        self.owners.append(owner)
        self.held += len(keys)

    @property
    def full(self) -> bool:
        return self.held >= HELD or len(self.owners) >= OWNERS

    def blobs(self) -> pa.RecordBatch:
        names = np.array(self.owners, np.uint64)
        parcel = _parcel(names)
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        bucket = (keys % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, which, bucket = (keys[order] >> np.uint64(32)).astype(np.uint32), which[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        out = ([], [], [])
        for a, b in zip(first, np.r_[first[1:], len(bucket)].astype(int)):
            out[0].append(bucket[a])
            out[1].append(keys[a:b].tobytes())
            out[2].append(steps(which[a:b]))
        if len(names):
            out[0].append(int(self.buckets) + int(parcel % int(self.buckets)))
            out[1].append(names.tobytes())
            out[2].append(b"")
        self.keys, self.owners, self.held = [], [], 0
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array([parcel] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                               names=["bucket", "parcel", "keys", "owners"])


def _parcel(names: np.ndarray) -> int:
    """48 bits made from the owners in their order: a task that runs again gives the same, and parcels with the same owners have the same names."""
    with np.errstate(over="ignore"):
        return int(mix(mix(names ^ mix(np.arange(len(names), dtype=np.uint64))).sum(dtype=np.uint64, keepdims=True))[0]) >> 16


def steps(which: np.ndarray) -> bytes:
    """Ascending numbers as one byte each for the step from the one before; a byte of 255 adds to the next."""
    step = np.diff(which, prepend=0)
    more = step // _STEP
    out = np.full(len(step) + int(more.sum()), _STEP, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % _STEP
    return out.tobytes()


def from_steps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != _STEP]


def local_ids(parcel: int, numbers: np.ndarray) -> np.ndarray:
    """The owners of a parcel by number, as longs."""
    return (np.uint64(parcel) << np.uint64(16)) + numbers.astype(np.uint64)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(key, local id) of the blobs of a bucket that share their key with another record; sorted by key."""
    parcels = table.column("parcel").to_pylist()
    if not parcels:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
    owner = np.concatenate([local_ids(p, from_steps(np.frombuffer(x.as_buffer(), np.uint8))) for p, x in zip(parcels, table.column("owners"))])
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.r_[same, False] | np.r_[False, same] if len(key) else np.zeros(0, bool)
    return key[shared], owner[order[shared]]


def names_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(local id, name) of the owners that the rows of names hold."""
    names = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    return (np.concatenate([local_ids(p, np.arange(len(n))) for p, n in zip(table.column("parcel").to_pylist(), names)]), np.concatenate(names))
