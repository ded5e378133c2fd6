"""Words and n-grams of whole Arrow string columns as numpy arrays, without a Python loop over words.

A text is lower-cased (A-Z only) and cut into words, the maximal runs of bytes other than
0x20 and 0x09-0x0D. A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import ctypes
import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES, BATCH_BYTES = 500_000, 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 20:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers Arrow batches of at most BATCH_BYTES, or of one row; else 10,000 long texts would come at once.

    Spark reads the setting when a plan runs, which is after the operator has returned it; so the setting stays. A lower one of the caller's is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        low = 0 < int(spark.conf.get(name)) <= BATCH_BYTES
    except Exception:  # unset, or with a unit
        low = False
    if not low:
        spark.conf.set(name, BATCH_BYTES)


def releasing(each: Callable) -> Callable:
    """each, a function of a task's Arrow batches, that at its end gives freed memory back to the system: the worker lives on beside other stages."""

    @functools.wraps(each)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        _release()

    return wrapped


def releasing_table(each: Callable) -> Callable:
    """The same for a function of a group's tables."""

    @functools.wraps(each)
    def wrapped(*tables: pa.Table) -> pa.Table:
        out = each(*tables)
        _release()
        return out

    # Spark tells by the arguments' number what a function is given.
    return (lambda left, right: wrapped(left, right)) if each.__code__.co_argcount == 2 else (lambda table: wrapped(table))


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def fitted(sample: DataFrame, fit: Callable[[pa.Table | None], Any]) -> Any:
    """What fit makes of all rows of sample, a table of bounded size, in one task. So the driver holds the model only. fit gets None for no rows."""

    @releasing
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [batch for batch in batches if batch.num_rows]
        model = fit(pa.Table.from_batches(batches) if batches else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(each, "model binary").first()
    return pickle.loads(made[0]) if made else fit(None)  # Spark runs no task over a table that it finds to be empty


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces whose texts hold about limit bytes; a longer text comes alone."""
    column_at = batch.schema.get_field_index(column)
    sizes = batch.column(column_at).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts, with the end; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a string column: bytes where each starts and stops, and how many words come before each text (with the end)."""

    starts: np.ndarray
    stops: np.ndarray
    before: np.ndarray
    _sums: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first bytes up to longest."""
        stops = self.stops if longest is None else np.minimum(self.stops, self.starts + longest)
        factors = _power(_INVERSE, len(self._sums))[self.starts]
        return mix((self._sums[stops] - self._sums[self.starts]) * factors + (stops - self.starts).astype(np.uint64))


def bounds(texts: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each word starts and stops in them, and how many words come before each text (with the end); space says which bytes stand between words."""
    data, offsets = raw(texts)
    inside = ~space[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]  # a word never runs on into the next text
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, starts, stops, np.searchsorted(starts, offsets)


def words(texts: pa.Array, space: np.ndarray = _SPACE) -> Words:
    """The words of all texts."""
    data, starts, stops, before = bounds(texts, space)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=sums[1:])
    return Words(starts, stops, before, sums)


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (bytes, where each starts and stops, how many come before each text), those of a text with one space between them: the bytes, where each word starts, and where each text starts (with the end)."""
    sizes = stops - starts + 1
    sizes[before[1:][np.diff(before) > 0] - 1] -= 1  # none after a text's last word
    first = np.concatenate(([0], np.cumsum(sizes)))
    change = np.zeros(len(data) + 2, dtype=np.int8)
    change[starts] = 1
    change[starts + sizes] -= 1
    out = np.append(data, np.uint8(32))
    out[_SPACE[out]] = 32
    return out[np.cumsum(change[:-1], dtype=np.int8) > 0], first[:-1], first[before]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each text (with the end)."""
    found = words(texts)
    return found.hashes(), found.before


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the shingles before each text.

    A text of 1 to k-1 words has one shingle of all its words; a text without words has none.
    """
    counts = np.diff(before)
    n = len(hashes)
    owner_end = np.repeat(before[1:], counts)
    position = np.arange(n)
    whole = position + k <= owner_end
    whole |= (position == np.repeat(before[:-1], counts)) & (np.repeat(counts, counts) < k)
    out = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        step = np.zeros(n, dtype=np.uint64)
        step[: n - i if i else n] = hashes[i:] if i < n else 0
        if i:
            step[position + i >= owner_end] = 0
        out = out * factor + step
    kept = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(whole, out=kept[1:])
    return mix(out[whole]), kept[before]


def group_sum(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive places in before."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]
