"""Words of whole Arrow batches as numpy arrays: boundaries, hashes, window hashes.

Used inside tasks. Everything is computed for many texts at once; memory is bounded by
``chunks``, which cuts a batch into runs of rows of about one size in bytes, and by
hashing words in blocks of bytes. All hashes are 64-bit and depend on the bytes only, so
every task and every run gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95
_HASH_BLOCK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes of words that are runs of anything but ASCII white space
_IN_SPACED = np.ones(256, dtype=bool)
_IN_SPACED[[9, 10, 11, 12, 13, 32]] = False
#: bytes of words that are runs of ASCII digits, letters and any other character
_IN_PLAIN = np.zeros(256, dtype=bool)
_IN_PLAIN[48:58] = _IN_PLAIN[65:91] = _IN_PLAIN[97:123] = True
_IN_PLAIN[128:] = True
KINDS = {"spaced": _IN_SPACED, "plain": _IN_PLAIN}


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Words:
    """The words of some texts, in order.

    ``start`` and ``end`` are byte positions in ``data``, ``first[i]:first[i + 1]`` are the
    words of text ``i``. A null text has no words.
    """

    def __init__(self, texts: pa.Array, kind: str, lower: bool):
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = KINDS[kind][raw]
        now, before = inside[1:], inside[:-1]
        opens, closes = now & ~before, before & ~now
        # a word never crosses from one text into the next
        joints = self.offsets[1:-1]
        joints = joints[inside[joints] & inside[joints + 1]] if len(joints) else joints
        opens[joints] = closes[joints] = True
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; seeds give independent ones."""
        out = np.empty(len(self), dtype=np.uint64)
        begin = 0
        base, inverse = _BASE + 2 * seed, pow(_BASE + 2 * seed, -1, 1 << 64) if seed else _INVERSE
        while begin < len(self):
            stop = max(begin + 1, int(np.searchsorted(self.end, self.start[begin] + _HASH_BLOCK)))
            low, high = self.start[begin], self.end[stop - 1]
            powers, inverses = _powers(base, high - low + 1), _powers(inverse, high - low + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
                start, end = self.start[begin:stop] - low, self.end[begin:stop] - low
                out[begin:stop] = (sums[end] - sums[start]) * inverses[start]
            begin = stop
        return mixed(out)


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _kept_powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _HASH_BLOCK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * _HASH_BLOCK:
            _kept_powers[base] = have
    return have


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive word hashes at every position that has ``n`` words left.

    The caller drops windows that cross from one text into the next (``whole``).
    """
    size = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        out = words[:size] + np.uint64(n)
        for k in range(1, n):
            out = out * np.uint64(_STEP) + words[k : k + size]
    return mixed(out)


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """For every position that ``window_hashes`` has, whether its window lies in one text."""
    total = int(first[-1])
    size = max(0, total - n + 1)
    stops = np.repeat(first[1:], np.diff(first))[:size]
    return np.arange(size) + n <= stops


def chunks(batches, sized_by: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``sized_by`` texts take about ``most_bytes`` together.

    A single longer text is a run of its own. Small batches are not joined.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(sized_by).cast(pa.large_string())
        sizes = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < batch.num_rows:
            stop = int(np.searchsorted(sizes, sizes[begin] + most_bytes, side="right")) - 1
            stop = min(max(stop, begin + 1), batch.num_rows)
            yield batch.slice(begin, stop - begin)
            begin = stop
