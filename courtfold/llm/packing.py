"""Hashes of a batch packed into one row for each shard of the hash range, and the reading of whole shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import mix

SHARD_BYTES = 4 << 20
#: Bytes of a shard that are read at a time; what a shard folds them into is as large as its different entries.
PART_BYTES = 32 << 20
#: A text is known by a hash of it and its id, together 128 bits.
KEY = np.dtype([("key", "<i8"), ("id", "<i8")])


def shard_bits(total_bytes: int) -> int:
    """Bits of the shard number so that a shard stands for about SHARD_BYTES of text, however large the corpus."""
    return max(4, (max(1, total_bytes) // SHARD_BYTES).bit_length())


def slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each run values[cuts[k]:cuts[k + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def flat(column: pa.Array, kind) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def narrow(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of unsigned integers in as few bytes as hold them."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).view(f"V{width}").ravel()


def widen(values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(values), 8), np.uint8)
    out[:, : values.itemsize] = values.view(np.uint8).reshape(len(values), values.itemsize)
    return out.view("<u8").ravel()


def shard_rows(groups: list[tuple[np.ndarray, list[np.ndarray]]], schema: pa.Schema) -> pa.RecordBatch:
    """A row for each shard that occurs in any group; a group has its items' shards in order, and columns of the items."""
    some = np.unique(np.concatenate([shards for shards, _ in groups]))
    columns = [pa.array(some)]
    for shards, values in groups:
        cuts = np.append(np.searchsorted(shards, some), len(shards))
        columns += [slices(x, cuts) for x in values]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def settled_rows(keys: np.ndarray, values: np.ndarray, bits: int, schema: pa.Schema, at: tuple[int, int]) -> pa.RecordBatch:
    """Pairs that are settled already, as rows of negative shards that passed() hands on; `at` says which columns of the schema take keys and values."""
    rows = bucketed(keys, values, bits)
    columns = [pa.nulls(len(rows), f.type) for f in schema]
    columns[0], columns[at[0]], columns[at[1]] = pa.array(-1 - rows.column(0).to_numpy()), rows.column(1), rows.column(2)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def passed(shard: int, rows: pa.RecordBatch, at: tuple[int, int]) -> pa.RecordBatch:
    """Rows of a negative shard as bucketed() made them."""
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), -1 - shard, np.int32)), rows.column(at[0]), rows.column(at[1])], schema=BUCKETS)


def shard_parts(batches: Iterator[pa.RecordBatch], key: str = "shard") -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """The rows of each shard from batches that are sorted by shard, PART_BYTES or one batch at a time, and whether they are its last."""
    held: list[pa.RecordBatch] = []
    now, size = None, 0
    for batch in batches:
        shards = batch.column(key).to_numpy()
        cuts = runs(shards)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and (shards[a] != now or size >= PART_BYTES):
                yield now, pa.concat_batches(held), bool(shards[a] != now)
                held, size = [], 0
            now = int(shards[a])
            held.append(batch.slice(a, b - a))
            size += held[-1].get_total_buffer_size() * (b - a) // max(1, batch.num_rows)
    if held:
        yield now, pa.concat_batches(held), True


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def _fields(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(keys[n] for n in keys.dtype.names) if keys.dtype.names else (keys,)


def distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (key, value) pairs, in order."""
    order = np.lexsort((values, *_fields(keys)[::-1]))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    return keys[new], values[new]


BUCKETS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def bucketed(keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """The different pairs as a row for each of 2**bits ranges of hashed keys that has any."""
    keys, values = distinct(keys, values)
    bucket = (mix(_fields(keys)[0].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = runs(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), slices(keys[order], cuts), slices(values[order], cuts)], schema=BUCKETS)


def gathered(rows: DataFrame, kind, name: str, keyed=np.dtype("<i8")) -> DataFrame:
    """(bucket, keys, values) rows as one row for each key with its different values of a kind, in order. Rows of bucket -1 give their keys, without values."""

    def run(batches):
        keys, values = np.zeros(0, keyed), np.zeros(0, kind)
        for bucket, part, last in shard_parts(batches, "bucket"):
            more = flat(part.column("keys"), keyed)
            if bucket < 0:
                yield out(np.unique(more), np.zeros(0, kind), np.zeros(len(np.unique(more)) + 1, np.int64))
                continue
            keys, values = distinct(np.concatenate([keys, more]), np.concatenate([values, flat(part.column("values"), kind)]))
            if last:
                cuts = runs(keys)
                yield out(keys[cuts[:-1]], values, cuts)
                keys, values = np.zeros(0, keyed), np.zeros(0, kind)

    def out(keys, values, cuts):
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(f)) for f in _fields(keys)), slices(values, cuts)], [*(keys.dtype.names or ["key"]), name])

    columns = "".join(f"{n} long, " for n in keyed.names or ["key"])
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{columns}{name} binary")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)
