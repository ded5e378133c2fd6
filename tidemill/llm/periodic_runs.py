"""Periodic runs of words by Lyndon arrays, after Ellert and Fischer's runs over general ordered alphabets.

A run is a stretch of words with a least period q, at least `exponent` times q long, which no neighbouring
word extends. Words are symbols of an ordered alphabet, of which only the order is used, here that of
their first appearance; exact, without hashes. Each place i has a longest Lyndon word, which ends where
the next smaller suffix begins. Every run has, by the order of the alphabet or by the reverse one, such a word of its
period's length that starts in its first period; how far the text goes on with that period is the longest
common extension of the two suffixes to the right, and to the left of the two places.

Next smaller suffixes are found from right to left over a stack of those found before. Extensions are never
begun anew: when suffix i turns out smaller than j, the next rival is j's own next smaller suffix, whose extension with j is
known; so the extension of i with it is the lesser of the two, or goes on where both are equal. When i agrees
with j over the whole distance between them, the rest is the extension of j with the place as far again behind it, which is known as a
rule. So a comparison reads at most about twice the distance in words. Tests count the words read: 2 for each word of a text of one
word repeated, 6 to 7 in Fibonacci and Thue-Morse texts of 20,000 to 80,000 words, where they rise by about one as the text grows
fourfold. No suffix array, tree or hash is made.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D, in their case; a null or empty text has no
words and no runs; of runs of equal length the one of the smallest start, then period, is the longest; runs can overlap, and
each counts; rows that repeat an id each get a row; a null id is carried; a very long text is read whole, alone in its
slice, with some 150 bytes of memory for each word; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.words import bound_batches, bounds, joined, releasing, slices

EXPONENT, MIN_LENGTH = 4, 6
#: Words that an extension compares at once.
STRIDE = 32


def lyndon_roots(x: list[int], exponent: int, reads: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Places i, j and extension r where j is the next smaller suffix after i and x agrees from i and from j over r symbols, for those roots that can lie in a run of the exponent.

    x ends in a symbol that is less than all others. reads, for tests, gets how many symbols each extension has read.
    """
    n = len(x) - 1
    following, ahead = [0] * (n + 1), [0] * (n + 1)  # the next smaller suffix, and the extension with it
    parent, below = [-1] * (n + 1), [0] * (n + 1)  # the previous smaller suffix, and the extension with it
    roots = []
    for i in range(n - 1, -1, -1):
        a, j = x[i], i + 1
        b = x[j]
        while b > a:
            j = following[j]
            b = x[j]
        if b < a:
            following[i] = j
            continue
        m = 0  # so many symbols are known to agree
        while True:
            d = j - i
            jumped, begun = False, m
            while True:
                while m + STRIDE <= d and x[i + m : i + m + STRIDE] == x[j + m : j + m + STRIDE]:
                    m += STRIDE
                while x[i + m] == x[j + m] and (m != d or jumped):
                    m += 1
                if m != d or jumped:
                    break
                jumped = True
                if reads is not None:
                    begun -= d
                if following[j] == j + d:
                    m = d + ahead[j]
                elif parent[j + d] == j:
                    m = d + below[j + d]
                if reads is not None:
                    begun += m
            if reads is not None:
                reads.append(m - begun + 1)
            if x[j + m] < x[i + m]:
                break
            # Suffix i is smaller than suffix j.
            parent[j], below[j] = i, m
            known = ahead[j]
            j = following[j]
            while m < known:
                parent[j], below[j], known, j = i, m, ahead[j], following[j]
            if m > known:
                m = known
                break
        following[i], ahead[i] = j, m
        if m > (exponent - 2) * (j - i):
            roots.append((i, j, m))
    return roots


def maximal_runs(x: list[int], exponent: int = 2, min_length: int = 2) -> list[tuple[int, int, int]]:
    """start, length and least period of every run of x, symbols of at least 0, by start, then period."""
    found, most = set(), max(x, default=0)
    for own in ([*x, -1], [*(most - v for v in x), -1]):
        for i, j, m in lyndon_roots(own, exponent):
            period, left = j - i, 0
            while left < period and left < i and own[i - 1 - left] == own[j - 1 - left]:
                left += 1
            # A root that goes on to the left for a period isn't the run's first.
            if left < period and left + period + m >= max(exponent * period, min_length):
                found.add((i - left, left + period + m, period))
    return sorted(found)


def _symbols(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers of words, by first appearance."""
    if not len(starts):
        return np.zeros(0, np.int64)
    packed, first, _ = joined(data, starts, stops, np.arange(len(starts) + 1))
    offsets = np.append(first, len(packed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy()


def _judged(part: pa.RecordBatch, exponent: int, min_length: int) -> pa.RecordBatch:
    """id, runs and the text without what repeats, of each row of part."""
    data, starts, stops, before = bounds(part.column("text"))
    symbols = _symbols(data, starts, stops)
    runs, sizes = [], np.zeros(part.num_rows, dtype=np.int32)
    for k, (a, b) in enumerate(zip(before.tolist(), before[1:].tolist(), strict=False)):
        if b - a >= max(min_length, exponent):
            found = maximal_runs(symbols[a:b].tolist(), exponent, min_length)
            sizes[k] = len(found)
            runs += found
    start, length, period = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    base = np.repeat(before[:-1], sizes) + start
    np.add.at(change, base + period, 1)
    np.add.at(change, base + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(kept)))[before]
    packed, _, cuts = joined(data, starts[kept], stops[kept], left)
    text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed)).cast(pa.string())
    entries = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), entries)
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(before)), lists, text], ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """For every row of docs its id, n_words, runs (start, length and period of each, by start, then period) and collapsed, the words joined by one space, of each run its first period alone."""
    if exponent < 2:
        raise ValueError("a run is at least twice its period long")
    bound_batches(docs.sparkSession)

    @releasing
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _judged(part, exponent, min_length)

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def report(found: DataFrame) -> DataFrame:
    """find_runs with n_runs and the longest run's start, length, period and exponent_milli in place of its runs and text, of which it gives digests."""
    # The greatest length; of equal ones the smallest start, then period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumns({"n_runs": F.size("runs").cast("long"), "longest": longest, "runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2("collapsed", 256)})
    ends = {"start": -F.col("longest.start"), "length": F.col("longest.length"), "period": -F.col("longest.period"), "exponent_milli": F.expr("1000 * longest.length div -longest.period")}
    return found.withColumns(ends).drop("runs", "collapsed", "longest")
