"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

Each match of the pre-token pattern is a linked list of byte runs. Every mergeable pair of
neighbours waits, as a list position, in the bucket of its merge's rank; a bitmap over the
ranks, with bitmaps over its words above it, finds the lowest rank that has a waiting pair in
three find-first-set steps. Positions whose pair has changed since are skipped when they are
met. A bucket is merged at once with numpy, in order from the left, unless one of its merges
makes a pair of lower rank: then the others in that pre-token wait. The work is O(n log n) in a
pre-token's bytes however long it is.

Texts are encoded map-only. The codes of pre-tokens met before are kept in a table of bounded
size in each Python worker; that only saves time.

Defined results: a null text is empty and has no tokens; repeated rows are encoded alike; an
empty table gives an empty table; a pre-token needs memory for its own
list only, about 75 bytes for each of its own. Encoding reads only the two named columns, so further columns never
clash; decoding carries all columns, replaces one of the name it is asked to give, and makes null of null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemill.llm.words import bound_batches, releasing, slices

#: Texts are encoded together up to so many bytes.
ENCODED_BYTES = 1_500_000
#: Pre-tokens longer than this are encoded anew each time, and the table starts anew at so many entries.
KEPT_BYTES, KEPT_ENTRIES = 48, 150_000


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a tiktoken file: a token in base 64, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class RankQueue:
    """Arrays of positions in buckets by rank, and a bitmap of the ranks that have any."""

    def __init__(self, ranks: int):
        sizes = [(ranks + 63) // 64]
        while sizes[-1] > 1:
            sizes.append((sizes[-1] + 63) // 64)
        self.levels = [[0] * n for n in sizes]  # bit r of the lowest: bucket r has positions; above: the word below has bits
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for words in self.levels:
            word = rank >> 6
            had = words[word]
            words[word] = had | 1 << (rank & 63)
            if had:
                return
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank; rank -1 is none."""
        waiting = ranks >= 0
        ranks, positions = ranks[waiting], positions[waiting]
        if len(ranks) < 2:
            if len(ranks):
                self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, start, stop in zip(ranks[np.concatenate(([0], cuts))].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            self.push(rank, positions[start:stop])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has positions, and these in order."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1  # find first set
        rank = at
        for words in self.levels:
            words[rank >> 6] &= ~(1 << (rank & 63))
            if words[rank >> 6]:
                break
            rank >>= 6
        bucket = self.buckets.pop(at)
        return at, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Encoder:
    """Encodes and decodes by a table of ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.none = max(ranks.values()) + 1  # no token's id
        self.tokens = [b""] * self.none
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = sorted((ranks[t[:i]] * (self.none + 1) + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs = np.array([key for key, _ in pairs] + [1 << 62], dtype=np.int64)
        self.pair_ranks = np.array([rank for _, rank in pairs] + [-1], dtype=np.int64)
        self.queue = RankQueue(self.none)
        self.kept: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, or -1. A merge's rank is also its token's id."""
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that begin at starts in data, and how many ids come before each of them.

        All pre-tokens share the queue; as none has a neighbour outside itself, each is merged as if it were alone.
        """
        n = len(data)
        token = np.append(self.bytes[data], self.none)  # place n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = n
        before[starts] = n
        waits = np.append(self.pair_rank(token[:n], token[after[:n]]), -1)  # the rank of the pair that begins here, now
        queue = self.queue
        queue.push_all(waits[:n], np.arange(n))
        while (found := queue.pop()) is not None:
            rank, at = found
            at = at[waits[at] == rank]  # the others are stale
            if len(at) > 1 and (overlap := after[at[:-1]] == at[1:]).any():  # in a run of overlapping pairs every other one merges, from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(np.append(False, overlap), 0, place))) % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            beyond = after[right]
            if len(at) > 1:
                left = token[before[at]]
                left[1:][before[at[1:]] == right[:-1]] = rank
                made = np.stack((self.pair_rank(np.full(len(at), rank), token[beyond]), self.pair_rank(left, np.full(len(at), rank))))
                if (early := ((made >= 0) & (made < rank)).any(axis=0)).any():  # a pair that must merge before the next one of its pre-token does
                    owner = np.searchsorted(starts, at, side="right")
                    wait = np.append(False, owner[1:] == owner[:-1]) & np.isin(owner, owner[early])
                    queue.push(rank, at[wait])
                    at, right, beyond = at[~wait], right[~wait], beyond[~wait]
            token[at] = rank
            after[at] = beyond
            before[beyond] = at
            waits[right] = token[right] = -1
            left = before[at]
            waits[at] = to_right = self.pair_rank(token[at], token[after[at]])
            to_left = self.pair_rank(token[left], token[at])
            waits[left] = to_left
            waits[n] = -1
            queue.push_all(np.concatenate((to_right, to_left)), np.concatenate((at, left)))
        alive = token[:n] >= 0
        sums = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(alive, out=sums[1:])
        return token[:n][alive], sums[np.append(starts, n)]

    def codes(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of different pre-tokens, as little-endian unsigned 32-bit integers."""
        out, long = {}, []
        for piece in pieces:
            if (whole := self.ranks.get(coded := piece.encode())) is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                long.append((piece, coded))
        if long:
            sizes = np.array([len(coded) for _, coded in long])
            starts = np.cumsum(sizes) - sizes
            ids, places = self.merge(np.frombuffer(b"".join(coded for _, coded in long), dtype=np.uint8), starts)
            ids, places = ids.astype("<u4").tobytes(), (places * 4).tolist()
            for (piece, _), start, stop in zip(long, places, places[1:], strict=False):
                out[piece] = ids[start:stop]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(text) for text in texts]
        if len(self.kept) > KEPT_ENTRIES:
            self.kept.clear()
        kept = self.kept
        new = self.codes(list(set().union(*pieces).difference(kept)))
        kept.update(new)
        out = [b"".join(map(kept.__getitem__, x)) for x in pieces]
        for piece in new:
            if len(piece) > KEPT_BYTES:
                del kept[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(lines: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file's contents and a pattern."""
    key = hashlib.sha256(lines).hexdigest(), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(lines), pattern)
    return _encoders[key]


def encode_table(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, the ids as binary (unless with_ids is false), and digests of the ids and of the bytes decoded from them.

    vocabulary: the path of a tiktoken file of ranks. The driver reads it (it is under a megabyte) and broadcasts it.
    """
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())

    @releasing
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(lines.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                ids = bpe.encode([text or "" for text in part.column(1).to_pylist()])
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)
        bpe.kept.clear()  # the worker lives on

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(encoded, schema).withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with one more column: the text decoded from its ids."""
    from pyspark.sql import functions as F

    bound_batches(encoded.sparkSession)
    with open(vocabulary, "rb") as file:
        lines = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decoded(ids):
        bpe = encoder(lines.value, "")
        return ids.map(lambda x: None if x is None else bpe.decode(bytes(x)).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, decoded(ids_col))
