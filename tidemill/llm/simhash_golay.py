"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes of the text's
SHINGLE-word shingles, repeats included. Fingerprints link if at most BITS of their bits differ.

The 64 bits are cut into three segments of up to 23 bits. The binary Golay code of length 23 has one codeword
within 3 bits of any word, and five more at 4 bits from a word that is 3 bits from the nearest. So if two words
differ in one bit at most, the nearest codeword of either is among the up to six codewords within 4 bits of the other,
and their 12-bit indexes can be hashed in place of the words. Of three errors in three segments, by the pigeonhole
principle, either one segment has none and another at most one, or each has one:

* for each ordered pair of segments, a key is the first segment as it is with each near codeword's index of the second;
* for all three, a key is the nearest index of two with each near one of the third, or the other way round.

So a fingerprint has 77 keys at most of 35 to 41 bits, and no link is missed. Keys are grouped and counted before any
fingerprints meet; buckets of the same fingerprints are compared once. Every two in a bucket are compared by
their differing bits; a task gives one edge for each fingerprint, never pairs, and connected components follow.
Equal texts, and unlike texts with equal fingerprints, are one fingerprint from the start.

Small buckets share a task; a large one is cut into blocks of at most BLOCK fingerprints, each pair of blocks a task.
A bucket's work grows with the square of its different fingerprints; none is left out.

Defined results: words are runs of bytes other than white space, compared without case (A-Z); a text of fewer words than a
shingle has one shingle of them all; a null text, or one without a word, has fingerprint 0 and is linked like any
other; a very long text is hashed in pieces of PIECE shingles, with the same result; rows that repeat an id each get a row; a
null id can be in a component but is its least only if all are null; on a tie of a bit's counts the bit is 0; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components, joined_labels
from tidemill.llm.storage import Scratch, sized
from tidemill.llm.words import _LOWER, bound_batches, bounds, joined, releasing, releasing_table, slices

SHINGLE, BITS, SEED = 3, 3, 42
PIECE = 1 << 16
#: Where each segment starts, and the end; each has at most LENGTH bits.
SEGMENTS, LENGTH = (0, 23, 46, 64), 23
#: The Golay code's generator polynomial: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, CHECKS = 0b101011100011, 11
BLOCK, TASK_ROWS = 4096, 1 << 15
#: A bucket can hold a link only if it has both.
HOME, NEAR = 1, 2


def _remainder(word: int) -> int:
    """The syndrome: what is left of a word's polynomial after division by the generator."""
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


@functools.cache
def _errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of each bit; for each syndrome the error of at most 3 bits with it, then those of 4 bits (or the first again), and how many there are."""
    of_bit = np.array([_remainder(1 << k) for k in range(LENGTH)], dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for size in range(5):
        for bits in combinations(range(LENGTH), size):
            found[functools.reduce(lambda s, k: s ^ int(of_bit[k]), bits, 0)].append(sum(1 << k for k in bits))
    errors = np.array([(e + e[:1] * 6)[:6] for e in found], dtype=np.int64)
    return of_bit, errors, np.array([len(e) for e in found])


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of up to LENGTH bits the indexes of the codewords within 4 bits, the nearest first, in six columns; and how many of the columns count."""
    of_bit, errors, count = _errors()
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), dtype=np.int64)
    for k in range(LENGTH):
        syndrome ^= (words >> k & 1) * of_bit[k]
    return (words[:, None] ^ errors[syndrome]) >> CHECKS, count[syndrome]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place in prints that each key is of, the keys, and whether HOME or NEAR or both led to it.

    Any two prints that differ in at most BITS bits share a key that is HOME for one and NEAR for the other.
    """
    parts = [(prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(SEGMENTS, SEGMENTS[1:], strict=False)]
    near, count = zip(*map(near_codewords, parts), strict=True)
    place = np.arange(len(prints))
    owners, out, roles = [], [], []

    def add(tag: int, used: np.ndarray, key: np.ndarray, role: np.ndarray) -> None:
        owners.append(np.broadcast_to(place[:, None], used.shape)[used])
        out.append((key + (tag << 48))[used])
        roles.append(np.broadcast_to(role, used.shape)[used])

    column = np.arange(6)
    for tag, (a, b) in enumerate(permutations(range(3), 2)):
        add(tag, column < count[b][:, None], (parts[a] << 12)[:, None] | near[b], np.where(column == 0, HOME | NEAR, NEAR))
    first, second, third = near
    add(6, column < count[2][:, None], (first[:, :1] << 24) | (second[:, :1] << 12) | third, np.where(column == 0, HOME | NEAR, HOME))
    both = (column < count[0][:, None])[:, :, None] & (column < count[1][:, None])[:, None]
    both[:, 0, 0] = False  # there already
    add(6, both.reshape(-1, 36), ((first << 24)[:, :, None] | (second << 12)[:, None] | third[:, :1, None]).reshape(-1, 36), np.array(NEAR))
    return np.concatenate(owners), np.concatenate(out), np.concatenate(roles)


def _prints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    data, starts, stops, before = bounds(texts)
    data, at, _ = joined(_LOWER[data], starts, stops, before)
    data, sizes, counts = data.tobytes(), stops - starts, np.diff(before)
    place, n = np.arange(len(at)) - np.repeat(before[:-1], counts), np.repeat(counts, counts)
    begin = np.flatnonzero((place + SHINGLE <= n) | (place == 0))
    last = begin + np.minimum(n[begin], SHINGLE) - 1
    owner = np.repeat(np.arange(len(counts)), counts)[begin]
    begin, end = at[begin], at[last] + sizes[last]
    ones, total = np.zeros((len(counts), 64), dtype=np.int64), np.bincount(owner, minlength=len(counts))
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(begin), PIECE):
        piece = slice(k, k + PIECE)
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(begin[piece].tolist(), end[piece].tolist(), strict=True)), np.uint64, len(begin[piece]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, np.diff(owner[piece]) > 0))
        ones[owner[piece][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and print, the fingerprint's bits as a long, of every row of docs."""
    bound_batches(docs.sparkSession)

    @releasing
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_prints(part.column("text")).view(np.int64))], ["id", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(found, f"id {kind}, print long")


@releasing
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE // 8):
            part = batch.slice(k, PIECE // 8)
            owner, key, role = keys(part.column("print").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("print").take(pa.array(owner)), pa.array(role.astype(np.int8))], ["key", "print", "role"])


def _least(prints: np.ndarray, left: slice, right: slice, bits: int) -> np.ndarray:
    """For each print the place of the least one that links between left and right lead to."""
    label = np.arange(len(prints))
    height = max(1, (1 << 21) // (right.stop - right.start))
    for k in range(left.start, left.stop, height):
        a, b = np.nonzero(np.bitwise_count(prints[k : min(k + height, left.stop), None] ^ prints[None, right]) <= bits)
        label = joined_labels(label, a + k, b + right.start)
    return label


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """Edges a, b between different fingerprints (prints, a written table: print, all different) that connect those, and only those, that links of at most bits differing bits connect."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the keys meet links of at most {BITS} bits")
    keyed = prints.select("print").mapInArrow(_keyed, "key long, print long, role byte")
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("size"), F.min("print").alias("low"), F.max("print").alias("high"), F.bit_or("role").alias("roles"),
        F.bit_xor(F.xxhash64("print")).alias("x"), F.bit_xor(F.xxhash64("print", F.lit(1))).alias("y"),
    )
    buckets = buckets.where((F.col("low") != F.col("high")) & (F.col("roles") == (HOME | NEAR)))
    buckets = scratch.written(buckets.groupBy("size", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "buckets")
    members = scratch.written(keyed.select("key", "print").join(sized(buckets), "key"), "members")

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    small = members.where(blocks == 1).count()
    tasks = max(1, -(-small // TASK_ROWS))
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    alone = F.col("blocks") == 1
    placed = placed.select(
        F.when(alone, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.col("key")).alias("task"),
        F.when(alone, -1).otherwise(F.least("block", "other")).alias("from"), F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("to"), "key", "print", "block",
    )

    def compared(table: pa.Table) -> pa.Table:
        across = table.column("from")[0].as_py() != table.column("to")[0].as_py()
        table = table.sort_by([("key", "ascending"), ("block", "ascending"), ("print", "ascending")])
        key, block, value = (table.column(c).to_numpy() for c in ("key", "block", "print"))
        least = value.copy()
        ends = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for a, b in zip(ends, ends[1:], strict=False):
            cut = int(np.searchsorted(block[a:b], block[b - 1])) if across else None
            left, right = (slice(0, b - a), slice(0, b - a)) if cut is None else (slice(0, cut), slice(cut, b - a))
            least[a:b] = value[a:b][_least(value[a:b].view(np.uint64), left, right, bits)]
        edges = np.unique(np.stack((value, least))[:, value != least], axis=1)
        return pa.table({"a": edges[0], "b": edges[1]})

    return placed.groupBy("task", "from", "to").applyInArrow(releasing_table(compared), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row for every row of docs: its id, fingerprint (16 hexadecimal digits) and component_id, the least id that links lead to, its own included."""
    with Scratch(docs.sparkSession, "golay") as scratch:
        rows = scratch.written(fingerprints(docs, id_col, text_col), "rows")
        prints = scratch.written(rows.groupBy("print").agg(F.min("id").alias("first_id")), "prints")
        groups = components(scratch.written(links(prints, scratch, bits), "links"), into=scratch)
        groups = scratch.written(prints.join(groups, F.col("print") == F.col("node")).select("print", "component", "first_id"), "groups")
        least = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
        joined_up = scratch.written(groups.join(least, "component").select("print", "component_id"), "least")
        known = scratch.written(prints.join(joined_up, "print", "left").select("print", F.when(F.col("component_id").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "known")
        found = rows.join(sized(known), "print")
        return scratch.result(found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"))
