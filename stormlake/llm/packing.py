"""Packed rows between groups of documents and buckets of hashes.

Groups send sorted distinct hashes, dealt over buckets, as one row per group and bucket;
buckets answer in the order of what was sent. Numbers travel as byte planes.
"""

import numpy as np
import pyarrow as pa

from stormlake.llm.words import mixed


def planes(values: np.ndarray) -> bytes:
    """Byte by byte, all first bytes first: equal high bytes then compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def dealt(hashes: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """Positions of the sorted hashes that each bucket gets, in order."""
    bucket = (mixed(hashes) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n_buckets)))


def table_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, type=kind) for name, (values, kind) in columns.items()})
