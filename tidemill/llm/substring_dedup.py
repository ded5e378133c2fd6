"""Removal of repeated passages by paragraph MinHash banding.

Repeated passages rarely fill a whole line, so paragraphs are of two sorts: a text's own lines of at
least MIN_WORDS words, and content-defined paragraphs of PARAGRAPH words. These begin where a
5-word shingle has the least hash of SPACING in a row; so any passage of MIN_WORDS words
(PARAGRAPH + SPACING - 1) that two texts share holds a paragraph that they share, wherever it stands.

Each paragraph gets band hashes from a MinHash of its shingles; rows per band are given and the number of bands
follows from the recall asked for. Bands that two texts share make paragraphs collide; unequal ones
that collide are verified by the exact Jaccard similarity of their shingle sets, and components of
equal or verified paragraphs are clusters. Each bucket's least member is compared with the others first; where
that leaves the others in several clusters, they are joined by finer bands, those of the n-gram join. A cluster's first paragraph, by document id and place, is
kept. Around paragraphs that another text has with the same words on one side, every window of MIN_WORDS words is
compared by a hash of all its words: each goes that an earlier text has too, and windows that overlap or touch make one passage.
Equal texts are compared once: of a text of MIN_WORDS words or more, all rows go but those of the least id. Each window that goes
has its equal in an earlier text. Of a cluster of lines all go but the first text's; as clusters are components, a line can hang
on that one by a chain of lines alone, so its own likeness to it, which is returned, can be under THRESHOLD.

Recall: equal passages of MIN_WORDS words are always met. A window's least shingle begins a paragraph wherever the window stands, each time
that it comes. In periodic text such paragraphs are many but equal; those of a text that have the same words, and the same on both
sides, are one row in Spark, and all their places are found again in the text. Lines at the threshold share a band with probability RECALL and
one of the finer bands, if they need them, with that of the n-gram join; of 200 pairs of Jaccard 0.84 whose lines share
40 words with 200 and 2,000 others, the tests ask for at least RECALL less two in a hundred.

No group is gathered: but for blocks, a bucket or a cluster is known by its least member, which Spark
aggregates before its shuffle, so a passage in a third of all documents costs one row for each.

Defined results: words are runs of bytes other than white space, compared without case (A-Z); a
text that is null or has under MIN_WORDS words repeats nothing; a very long text is compared whole, alone in its slice, with some 100 bytes
of memory for each of its words; repeats within one text stay;
rows with equal id and text are one document; a null id counts as the least; an empty table gives an
empty table; columns other than id and text are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.ngram_join import SHINGLE, THRESHOLD, _factors, band_count, banding, bucketed, linked_within, minhash_bands
from tidemill.llm.storage import Scratch, sized, unused
from tidemill.llm.words import _BASE, _INVERSE, Words, _power, bound_batches, mix, raw, releasing, slices, words

MIN_WORDS, PARAGRAPH, SPACING = 50, 20, 31
ROWS, RECALL = 2, 0.999
#: Lines have the bands that the recall asks for. Equal content-defined paragraphs share any band; likes of them, which only name clusters, are met with probability 0.98.
LINE_BANDS, BANDS = band_count(THRESHOLD, ROWS, RECALL), band_count(THRESHOLD, ROWS, 0.98)
#: Two paragraphs in one passage of MIN_WORDS words have so many more words in common on one side at least.
SIDE = (MIN_WORDS - PARAGRAPH) // 2
#: Of the filter by which most paragraphs that collide with none stay out of a shuffle: bits for each bucket, so that 1 in 32 others passes;
#: the most bits (32 MB; beyond 8 million buckets more pass, and the join with the buckets does the rest), and the parts that it is made in.
FILTER_SHARE, FILTER_BITS, FILTER_PARTS = 32, 1 << 28, 1 << 9
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over x[i : i + width] for each i."""
    out, size = x, 1
    while size * 2 <= width:
        out = take(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return take(out[:n], out[width - size : width - size + n])


class Paragraphs:
    """The paragraphs of a string column: the text each belongs to, its first word in that text, how many words it has."""

    def __init__(self, texts: pa.Array):
        self.found: Words = words(texts)
        self.hashes, self.before = self.found.hashes(), self.found.before
        n = len(self.hashes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * _power(_BASE, n)[:n], out=self.sums[1:])
        grams = np.zeros(max(n - SHINGLE + 1, 0), dtype=np.uint64)
        for i in range(SHINGLE):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + self.hashes[i : i + len(grams)]
        self.grams = mix(grams)
        start, size = [], []
        if n:
            for first, n_words in (self._content_defined(), self._lines(texts)):
                start.append(first), size.append(np.broadcast_to(n_words, first.shape))
        self.start = np.concatenate(start) if start else np.zeros(0, np.int64)
        self.size = np.concatenate(size) if size else np.zeros(0, np.int64)
        self.n_content = len(start[0]) if start else 0
        self.owner = np.searchsorted(self.before, self.start, side="right") - 1

    def _content_defined(self) -> tuple[np.ndarray, int]:
        counts = np.diff(self.before)
        places = np.where(counts >= MIN_WORDS, counts - PARAGRAPH + 1, 0)
        used = np.flatnonzero(places)
        places = places[used]
        if not len(used):
            return np.zeros(0, np.int64), PARAGRAPH
        room = places + SPACING - 1  # of each text, so that no window of places reaches into the next text
        begin = np.cumsum(room) - room + SPACING - 1
        local = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
        word = local + np.repeat(self.before[:-1][used], places)
        at = local + np.repeat(begin, places)
        flat = np.full(int(room.sum()) + 2 * (SPACING - 1), _MOST)
        flat[at] = self.grams[word]
        least = np.zeros(len(flat), dtype=np.uint64)
        low = sliding(flat, SPACING, np.minimum)
        inside = at[(local + SPACING <= np.repeat(places, places)) | (local == 0)]
        least[inside] = low[inside]
        return word[sliding(least, SPACING, np.maximum)[at - SPACING + 1] == flat[at]], PARAGRAPH

    def _lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, _ = raw(texts)
        cuts = np.union1d(self.before, np.searchsorted(self.found.starts, np.flatnonzero(data == 10)))
        size = np.diff(cuts)
        long = size >= MIN_WORDS
        return cuts[:-1][long], size[long]

    def keys(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to stop."""
        return mix((self.sums[stop] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start] + (stop - start).astype(np.uint64))

    def own_keys(self) -> np.ndarray:
        return self.keys(self.start, self.start + self.size)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each text's paragraphs that have the same words and the same beside them, in ascending order; and for each paragraph the place of its first in that list."""
        kind = self.own_keys() + (np.arange(len(self.start)) >= self.n_content)
        for side in (True, False):
            key = self.beside(side)
            kind = mix(kind + mix(key.fill_null(0).to_numpy().view(np.uint64) + np.uint64(side)) + key.is_null().to_numpy(False))
        order = np.lexsort((self.start, kind, self.owner))
        new = np.append(True, (np.diff(self.owner[order]) != 0) | (kind[order][1:] != kind[order][:-1]))[: len(order)]
        first = np.sort(order[new])
        number = np.zeros(len(order), dtype=np.int64)
        number[order] = np.searchsorted(first, order[new])[np.cumsum(new) - 1]
        return first, number

    def bands(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes of the content-defined paragraphs, and of the lines, in the ascending list which."""
        k = int(np.searchsorted(which, self.n_content))
        start, size = self.start[which], self.size[which]
        content, lines = np.zeros((k, BANDS), dtype=np.uint64), np.zeros((len(start) - k, LINE_BANDS), dtype=np.uint64)
        part = np.stack([self.grams[start[:k] + i] for i in range(PARAGRAPH - SHINGLE + 1)]) if k else None
        ends = np.stack((start[k:], start[k:] + size[k:] - SHINGLE + 1), axis=1).ravel()
        padded = np.append(self.grams, _MOST)
        for i, factor in enumerate(_factors(LINE_BANDS * ROWS)):
            band = i // ROWS
            if k and band < BANDS:
                content[:, band] = mix(content[:, band] + (part * factor).min(axis=0))
            if len(ends):
                lines[:, band] = mix(lines[:, band] + np.minimum.reduceat(padded * factor, ends)[::2])
        return content + np.arange(BANDS, dtype=np.uint64), lines + np.arange(LINE_BANDS, dtype=np.uint64)

    def beside(self, ahead: bool) -> pa.Array:
        """A key of the SIDE words after, or before, each content-defined paragraph; null if there aren't as many or for a line."""
        start = self.start + self.size if ahead else self.start - SIDE
        stop = start + SIDE
        ok = (start >= self.before[self.owner]) & (stop <= self.before[self.owner + 1])
        ok[self.n_content :] = False
        key = np.zeros(len(start), dtype=np.uint64)
        key[ok] = self.keys(start[ok], stop[ok])
        return pa.array(key.view(np.int64), mask=~ok)


def _mapped(rows: DataFrame, one, schema: str) -> DataFrame:
    """one(batch of t and text) for each slice of rows."""

    @releasing
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield one(part)

    return rows.mapInArrow(each, schema)


def _banded(part: pa.RecordBatch) -> pa.RecordBatch:
    """The different band hashes of each text."""
    found = Paragraphs(part.column("text"))
    first, _ = found.kinds()
    content, lines = found.bands(first)
    owner = found.owner[first]
    owner = np.concatenate((np.repeat(owner[: len(content)], BANDS), np.repeat(owner[len(content) :], LINE_BANDS)))
    t, hashes = part.column("t").to_numpy()[owner], np.concatenate((content.ravel(), lines.ravel()))
    order = np.lexsort((hashes, t))
    t, hashes = t[order], hashes[order]
    new = np.append(True, (t[1:] != t[:-1]) | (hashes[1:] != hashes[:-1]))[: len(t)]
    return pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(t[new])], ["hash", "t"])


def _filter(buckets: DataFrame) -> np.ndarray:
    """One bit for each bucket's hash modulo their number, which follows the number of buckets."""
    size = min(FILTER_BITS, 1 << (FILTER_SHARE * buckets.count() + FILTER_PARTS * 8 - 1).bit_length())
    width = size // FILTER_PARTS

    def made(table: pa.Table) -> pa.Table:
        bit = table.column("bit").to_numpy()
        bits = np.zeros(width, dtype=bool)
        bits[bit % width] = True
        return pa.table({"part": pa.array(bit[:1] // width), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = F.col("hash").bitwiseAND(F.lit(size - 1))
    parts = buckets.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / width)).applyInArrow(made, "part long, bits binary").toArrow()
    out = np.zeros((FILTER_PARTS, width // 8), dtype=np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def _listed(part: pa.RecordBatch, filtered: np.ndarray) -> pa.RecordBatch:
    """Each paragraph, the first of its kind in its text, with those of its band hashes that the filter lets pass."""
    found = Paragraphs(part.column("text"))
    first, _ = found.kinds()
    keys = found.own_keys()
    content, lines = found.bands(first)
    bands = np.concatenate((np.pad(content, ((0, 0), (0, LINE_BANDS - BANDS))), lines))
    bit = bands & np.uint64(8 * len(filtered) - 1)
    passes = (filtered[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
    passes[first < len(content), BANDS:] = False
    kept = passes.any(axis=1)
    first, bands, passes = first[kept], bands[kept], passes[kept]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(passes.sum(axis=1)))).astype(np.int32)), pa.array(bands[passes].view(np.int64)))
    place = (found.start - found.before[found.owner]).astype(np.int32)
    columns = [pa.array(part.column("t").to_numpy()[found.owner[first]]), pa.array(place[first]), pa.array(found.size[first].astype(np.int32)), pa.array(keys[first].view(np.int64))]
    chosen = pa.array(first)
    return pa.RecordBatch.from_arrays([*columns, found.beside(True).take(chosen), found.beside(False).take(chosen), lists], ["t", "place", "n", "key", "ahead", "behind", "bands"])


def _flat(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.StructArray]:
    """The row that each entry of a list column is in, and the entries."""
    lists = part.column(column)
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _sets(part: pa.RecordBatch) -> pa.RecordBatch:
    """The shingle sets of the paragraphs that are asked for."""
    found = Paragraphs(part.column("text"))
    row, asked = _flat(part, "asked")
    start = found.before[row] + asked.field("place").to_numpy()
    stop = start + asked.field("n").to_numpy() - SHINGLE + 1
    sets = [np.unique(found.grams[a:b]).tobytes() for a, b in zip(start, stop, strict=True)]
    return pa.RecordBatch.from_arrays([asked.field("key"), pa.array(sets, pa.binary())], ["key", "set"])


def _windows(part: pa.RecordBatch) -> pa.RecordBatch:
    """The different windows of MIN_WORDS words that hold a paragraph of a kind that is asked for: text, its first id, first word, a hash of the words, and the least cluster of such paragraphs."""
    found = Paragraphs(part.column("text"))
    row, asked = _flat(part, "asked")
    first, number = found.kinds()
    most = np.iinfo(np.int64).max
    cluster = np.full(len(first), most)
    wanted = found.start[: found.n_content].searchsorted(found.before[row] + asked.field("place").to_numpy())
    np.minimum.at(cluster, number[wanted], asked.field("cluster").to_numpy())
    cluster = cluster[number[: found.n_content]]
    n = len(found.hashes)
    at = np.full(n + MIN_WORDS - PARAGRAPH + 1, most)
    at[found.start[: found.n_content]] = cluster
    least = sliding(at, MIN_WORDS - PARAGRAPH + 1, np.minimum)[:n]
    start = np.flatnonzero(least < most)
    owner = np.searchsorted(found.before, start, side="right") - 1
    inside = start + MIN_WORDS <= found.before[owner + 1]
    start, owner = start[inside], owner[inside]
    key = found.keys(start, start + MIN_WORDS)
    return pa.RecordBatch.from_arrays([part.column("t").take(pa.array(owner)), part.column("first_id").take(pa.array(owner)), pa.array((start - found.before[owner]).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(least[start])], ["t", "first_id", "place", "window", "cluster"])


@releasing
def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with the Jaccard similarity of their sets."""
    for batch in batches:
        found = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            found.append(both / (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "likeness"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b, keys of sets, and their likeness."""
    sides = [sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_likeness, "a long, b long, likeness double")


@releasing
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finer band hashes of shingle sets."""
    bands, rows = banding()
    for batch in batches:
        grams = np.array([len(x.as_buffer()) // 8 for x in batch.column("set")], dtype=np.int64)
        found = minhash_bands(np.frombuffer(b"".join(x.as_py() for x in batch.column("set")), dtype=np.uint64), np.concatenate(([0], np.cumsum(grams))), bands, rows) if len(grams) else np.zeros((0, bands), np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * bands), pa.array(found.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.ones(len(grams), np.int64)), pa.array(grams), lists], ["key", "copies", "grams", "bands"])


def _asked(texts: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of texts (t, text and more) that are asked about, with what is asked as a list."""
    lists = scratch.written(asked.groupBy("t").agg(F.collect_set(F.struct(*[c for c in asked.columns if c != "t"])).alias("asked")), "asked")
    some = texts.join(sized(lists.select("t")), "t", "left_semi")
    return some.join(lists.hint("shuffle_hash"), "t").select(*texts.columns, "asked")


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _clusters(texts: DataFrame, hits: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """key and cluster of the paragraphs that are verified to be like another one that differs; key and set of all that were compared."""
    collided = hits.select("hash", "key").distinct()
    least = collided.groupBy("hash").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    members = scratch.written(collided.join(least, "hash").select("hash", "key", "least"), "members")
    pairs = scratch.written(members.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    place = hits.join(sized(wanted), "key", "left_semi").groupBy("key").agg(F.min(F.struct("t", "place", "n")).alias("p"))
    sets = scratch.written(_mapped(_asked(texts, place.select("p.t", "p.place", "p.n", "key"), scratch), _sets, "key long, set binary"), "sets")
    edges = scratch.written(_compared(pairs, sets).where(F.col("likeness") >= THRESHOLD - 1e-9).select("a", "b"), "alike")
    so_far = components(edges, into=scratch).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    # Where a bucket's other keys are not in one cluster by now, they are joined as the n-gram join does it, by finer bands.
    others = members.where("key <> least").join(so_far, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    others = scratch.written(others.select("hash", "key", "cluster"), "others")
    open_ones = others.groupBy("hash").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("hash")
    open_keys = others.join(open_ones, "hash").select("key").distinct()
    signed = scratch.written(sets.join(open_keys, "key", "left_semi").mapInArrow(_signed, "key long, copies long, grams long, bands array<long>"), "signed")
    if signed.isEmpty():
        return so_far, sets
    more = linked_within(bucketed(signed, scratch), sets, THRESHOLD).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges.union(more), into=scratch).select(F.col("node").alias("key"), F.col("component").alias("cluster")), sets


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage to be removed: id, text_id (the text's hash), first_word, n_words, cluster, kept_id (whose text keeps it), likeness (a line's Jaccard similarity to the kept one; 1 for equal words).

    Passages of a document can overlap. A document of which an equal one stays has one passage, its whole text. A passage is named by
    the least cluster among the paragraphs for which its text follows the kept one at the same distance.
    """
    bound_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "passages") as scratch:
        return scratch.result(_repeats(docs, id_col, text_col, scratch))


def _repeats(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", _text_id(F.col("text")))
    texts = own.select("t", "text")
    buckets = _mapped(texts, _banded, "hash long, t long").groupBy("hash").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("hash")
    buckets = scratch.written(buckets, "buckets")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(buckets))
    listed = _mapped(texts, lambda part: _listed(part, shared.value), "t long, place int, n int, key long, ahead long, behind long, bands array<long>")
    hits = listed.select("t", "place", "n", "key", "ahead", "behind", F.explode("bands").alias("hash")).join(buckets, "hash")
    hits = scratch.written(hits, "hits")
    first = scratch.written(own.groupBy("t").agg(F.min(F.struct("id"))["id"].alias("first_id"), F.count("*").alias("rows")), "texts")
    several = first.where("rows > 1").select("t", "first_id")
    one_each = own.join(sized(several), "t", "left").where("first_id is null or id <=> first_id").select("t", "text", F.col("id").alias("first_id"))
    clusters, sets = _clusters(one_each, hits, scratch)
    found = hits.select("t", "place", "n", "key", "ahead", "behind").distinct().join(clusters, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    found = scratch.written(found.join(first.select("t", "first_id"), "t"), "found")
    scratch.drop(hits)

    # Of lines in one cluster, all but the first text's go.
    is_line = F.col("n") != PARAGRAPH
    lines = found.where(is_line)
    leaders = lines.groupBy("cluster").agg(F.min(F.struct("first_id", "t", "place", "key")).alias("lead"), F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("cluster", "lead")
    lines = lines.join(leaders, "cluster").where(F.col("t") != F.col("lead.t")).select("t", "first_id", F.col("place").alias("first_word"), F.col("n").alias("n_words"), "cluster", F.col("lead.first_id").alias("kept_id"), F.col("key").alias("a"), F.col("lead.key").alias("b"))
    lines = scratch.written(lines, "lines")
    likeness = _compared(lines.where("a <> b").select("a", "b").distinct(), sets)
    lines = lines.join(likeness, ["a", "b"], "left").withColumn("likeness", F.coalesce("likeness", F.lit(1.0))).drop("a", "b")

    # A paragraph can be in a shared window only if another text has it with the same words on one side.
    sides = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(i), "key", c)) for i, c in enumerate(("ahead", "behind"))]))).alias("group")
    grouped = found.where(~is_line).select("t", "place", "cluster", sides)
    # What a join reads is written before it: Spark can then split a hot group's partition.
    shared_groups = scratch.written(grouped.groupBy("group").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("group"), "groups")
    followed = scratch.written(grouped.join(shared_groups, "group").select("t", "place", "cluster").distinct(), "followed")

    # Of texts with the same window of MIN_WORDS words, all but the first lose it.
    windows = _mapped(_asked(one_each, followed, scratch), _windows, f"t long, first_id {own.schema['id'].dataType.simpleString()}, place int, window long, cluster long")
    windows = scratch.written(windows, "windows")
    spread = windows.groupBy("window").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("window")
    several_have = scratch.written(windows.join(scratch.written(spread, "spread"), "window"), "shared")
    scratch.drop(windows)
    leaders = scratch.written(several_have.groupBy("window").agg(F.min(F.struct("first_id", "t", "place")).alias("lead")), "leaders")
    led = several_have.join(leaders, "window").where(F.col("t") != F.col("lead.t"))

    # Windows at the same distance from those of the same text that overlap or touch are one passage.
    led = led.groupBy("t", "first_id", F.col("lead.t").alias("lead_t"), F.col("lead.first_id").alias("kept_id"), (F.col("place") - F.col("lead.place")).alias("shift")).agg(F.array_sort(F.collect_set("place")).alias("places"), F.min("cluster").alias("cluster"))
    starts = F.filter("places", lambda p, i: (i == 0) | (p - F.get("places", i - 1) > MIN_WORDS))
    stops = F.filter("places", lambda p, i: (i == F.size("places") - 1) | (F.get("places", (i + 1).cast("int")) - p > MIN_WORDS))
    runs = led.select("t", "first_id", "kept_id", "cluster", F.explode(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))).alias("c"))
    runs = runs.select("t", "first_id", F.col("c.start").alias("first_word"), (F.col("c.stop") - F.col("c.start") + MIN_WORDS).alias("n_words"), "cluster", "kept_id", F.lit(1.0).alias("likeness"))
    passages = runs.unionByName(lines).groupBy("t", "first_id", "first_word", "n_words", "kept_id").agg(F.min("cluster").alias("cluster"), F.max("likeness").alias("likeness"))
    passages = passages.select(F.col("first_id").alias("id"), F.col("t").alias("text_id"), "first_word", "n_words", "cluster", "kept_id", "likeness")

    # Words are counted of copies only: as the count looks at both sides of the join, Spark doesn't filter all texts by it first.
    n_words = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    copies = own.join(sized(several), "t").where("not (id <=> first_id)")
    copies = copies.select("id", F.col("t").alias("text_id"), F.lit(0).alias("first_word"), n_words.alias("n_words"), F.col("t").alias("cluster"), F.col("first_id").alias("kept_id"), F.lit(1.0).alias("likeness")).where(F.col("n_words") >= MIN_WORDS)
    return passages.unionByName(copies.distinct()).withColumnRenamed("id", id_col)


def cut_words(texts: pa.Array, passages: pa.ListArray) -> pa.Array:
    """Each text without the words of its passages (structs of first_word and n_words) and the white space after them."""
    found = words(texts)
    data, offsets = raw(texts)
    keep = np.zeros(len(data) + 1, dtype=np.int64)
    row = np.repeat(np.arange(len(passages)), np.diff(passages.offsets.to_numpy()))
    entries = passages.flatten()
    first = found.before[row] + entries.field("first_word").to_numpy()
    stop = np.minimum(first + entries.field("n_words").to_numpy(), found.before[row + 1])
    starts = np.append(found.starts, len(data))
    a, b = starts[first], np.where(stop == found.before[row + 1], offsets[row + 1], starts[stop])
    np.add.at(keep, a, 1)
    np.add.at(keep, b, -1)
    kept = np.cumsum(keep[:-1]) == 0
    sizes = np.concatenate(([0], np.cumsum(kept)))[offsets]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[kept].tobytes())).cast(pa.string())


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns as they are, texts without repeated passages; rows of whose text nothing stays are left out."""
    cut_id, cut_text, cut_list = unused(docs, "cut_id", "cut_text", "cut_passages")
    found = repeats(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    by_place = Window.partitionBy("id", "text_id").orderBy("first_word", "stop")
    before = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    with Scratch(docs.sparkSession, "passages-cut") as scratch:
        runs = found.select("id", "text_id", "first_word", (F.col("first_word") + F.col("n_words")).alias("stop")).distinct().withColumn("new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
        runs = runs.withColumn("run", F.sum("new").over(by_place)).groupBy("id", "text_id", "run").agg(F.min("first_word").alias("first_word"), F.max("stop").alias("stop"))
        lists = runs.groupBy(F.col("id").alias(cut_id), F.col("text_id").alias(cut_text)).agg(F.collect_list(F.struct("first_word", (F.col("stop") - F.col("first_word")).alias("n_words"))).alias(cut_list))
        lists = scratch.result(lists)
    text = F.col(f"`{text_col}`")
    joined = docs.join(sized(lists), F.col(f"`{id_col}`").eqNullSafe(F.col(cut_id)) & (_text_id(text) == F.col(cut_text)), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, passages: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, passages], ["text", "cut"])
        parts = [cut_words(part.column("text"), part.column("cut")) for part in slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    none = F.array().cast("array<struct<first_word:int,n_words:int>>")
    whole = F.col(cut_list).isNull()
    left = joined.withColumn(text_col, F.when(whole, text).otherwise(cut(text, F.coalesce(F.col(cut_list), none))))
    return left.where(whole | text.rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Of the rows of repeats: id, first_word, n_words and kept_id, every window and every two lines that share a shingle being compared; banding meets all its lines at the scale of a test.
ORACLE_SQL = """
WITH RECURSIVE
texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id FROM documents GROUP BY ALL),
lined AS (
  SELECT first_id, k, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT first_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts)),
whole AS (SELECT first_id, flatten(list(w ORDER BY k)) AS w FROM lined GROUP BY first_id),
windows AS (
  SELECT first_id, i - 1 AS place, array_to_string(w[i:i + 49], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM whole)),
leaders AS (SELECT words, min((first_id, place)) AS lead FROM windows GROUP BY words HAVING min(first_id) <> max(first_id)),
led AS (SELECT first_id, lead[1] AS kept_id, place, place - lead[2] AS shift FROM windows JOIN leaders USING (words) WHERE first_id <> lead[1]),
marked AS (SELECT *, coalesce(CAST(place - lag(place) OVER (PARTITION BY first_id, kept_id, shift ORDER BY place) > 50 AS INT), 1) AS new FROM led),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY first_id, kept_id, shift ORDER BY place) AS run FROM marked),
runs AS (SELECT first_id, min(place) AS first_word, max(place) - min(place) + 50 AS n_words, kept_id FROM numbered GROUP BY first_id, kept_id, shift, run),
long_lines AS (
  SELECT first_id, place, w FROM (SELECT first_id, w, coalesce(sum(len(w)) OVER (PARTITION BY first_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM lined) WHERE len(w) >= 50),
classes AS (SELECT w, row_number() OVER (ORDER BY w) AS c FROM (SELECT DISTINCT w FROM long_lines)),
grams AS (SELECT DISTINCT c, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM classes),
sizes AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.c <> y.c GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.c JOIN sizes y ON b = y.c WHERE pairs.n * 10 >= 8 * (x.n + y.n - pairs.n)),
reached AS (SELECT c AS node, c AS other FROM classes UNION SELECT b, other FROM reached JOIN links ON a = node),
clusters AS (SELECT node, min(other) AS cluster FROM reached GROUP BY node),
members AS (SELECT first_id, place, len(w) AS n, cluster FROM long_lines JOIN classes USING (w) JOIN clusters ON c = node),
first_lines AS (SELECT cluster, min((first_id, place))[1] AS kept_id FROM members GROUP BY cluster)
SELECT first_id AS doc_id, CAST(first_word AS INT) AS first_word, CAST(n_words AS INT) AS n_words, kept_id
FROM (SELECT * FROM runs UNION SELECT first_id, place, n, kept_id FROM members JOIN first_lines USING (cluster) WHERE first_id <> kept_id)
UNION ALL
SELECT doc_id, 0, CAST(len(w) AS INT), first_id
FROM documents JOIN texts ON coalesce(documents.text, '') = texts.text JOIN whole USING (first_id) WHERE doc_id <> first_id AND len(w) >= 50"""
