"""Which of very many 64-bit keys several parts or documents share, as filters of fixed size.

Keys are counted in blobs, not rows: a part is what a task has gathered of about ``PART`` bytes. A key's lowest
bit isn't part of it; it marks a key that is known to be shared within its part. Keys must be spread evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Store

#: The least and the greatest size of a filter, as powers of 2 in bits: 16 and 64 MB. It grows with the keys between
#: these bounds; a fuller filter lets more keys pass, never fewer.
LEAST_BITS, MOST_BITS = 27, 29
PART = 8_000_000


def by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ``keys`` by their first bits, the shards present, and where each begins (one more at the end)."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(shard, kind="stable")
    names, begin = np.unique(shard[order], return_index=True)
    return order, names, np.append(begin, len(keys))


def _filter_bits(bits: np.ndarray) -> int:
    return int(len(bits) * 8).bit_length() - 1


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys' first bits are in a filter."""
    top = key >> np.uint64(64 - _filter_bits(bits))
    return (bits[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shared_keys(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n_keys: float, bits: int, per_task: int, heavy: int, store: Store, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Filters over the keys that several documents have, and over those from at least ``heavy`` parts.

    ``entries`` gives arrays of keys for a batch of rows, a key once for each document or marked. There are about
    ``n_keys`` of them. Keys meet in 2 ** ``bits`` shards, about ``per_task`` in a task, so a task's share doesn't grow.
    """
    size = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(n_keys, 1) * 4)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(kept)
            keys.sort()
            plain = keys >> np.uint64(1)
            again = np.concatenate(([False], plain[1:] == plain[:-1]))
            first = np.flatnonzero(~again)
            marked = np.maximum.reduceat((keys & np.uint64(1)).astype(bool) | again, first)
            keys = plain[first] << np.uint64(1) | marked.astype(np.uint64)
            order, names, begin = by_shard(keys, bits)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([keys[order[a:b]].tobytes() for a, b in zip(begin, begin[1:])], pa.binary())], ["shard", "keys"])

        for batch in batches:
            for keys in entries(batch):
                kept.append(keys)
                size += len(keys)
                if size * 8 > PART:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        keys.sort()
        plain = keys >> np.uint64(1)
        new = np.flatnonzero(np.concatenate(([True], plain[1:] != plain[:-1])))
        times = np.diff(np.append(new, len(plain)))
        marked = np.maximum.reduceat((keys & np.uint64(1)).astype(bool), new)
        out = []
        for some in (plain[new[(times > 1) | marked]], plain[new[times >= heavy]]):
            place = some << np.uint64(1) >> np.uint64(64 - size)
            at = np.unique(place >> np.uint64(3))  # bytes of the filter
            part = np.zeros(len(at), np.uint8)
            np.bitwise_or.at(part, np.searchsorted(at, place >> np.uint64(3)), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
            out.append((len(out), at.astype(np.uint32).tobytes(), part.tobytes()))
        return pd.DataFrame(out, columns=["kind", "at", "part"])

    dealt = rows.mapInArrow(count, "shard long, keys binary").repartition(tasks(rows, bits, per_task), "shard")
    found = store.keep(dealt.groupBy("shard").applyInPandas(meet, "kind int, at binary, part binary"), name)
    # written by all tasks at once; at most 5 bytes for each byte of a filter come to the driver, a few shards at a time
    out = np.zeros(1 << (size - 3), np.uint8), np.zeros(1 << (size - 3), np.uint8)
    for r in found.toLocalIterator():
        np.bitwise_or.at(out[r["kind"]], np.frombuffer(r["at"], np.uint32), np.frombuffer(r["part"], np.uint8))
    return out


def _least_tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_bits(rows: DataFrame, amount: float, per_shard: float) -> int:
    """Bits for a number of shards that grows with ``amount``, at least the session's number of shuffle partitions."""
    return int(np.ceil(np.log2(max(_least_tasks(rows), amount / per_shard, 2))))


def tasks(rows: DataFrame, bits: int, per_task: int) -> int:
    """Tasks for 2 ** ``bits`` shards, at least the session's number of shuffle partitions."""
    return max(_least_tasks(rows), -(-(1 << bits) // per_task))
