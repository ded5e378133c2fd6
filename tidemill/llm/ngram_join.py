"""N-gram Jaccard join by MinHash banding.

A document's n-grams are its SHINGLE-word shingles. The number of bands and of rows in a band follow from the
recall asked for at the threshold: of those that meet it with at most HASHES hashes, the pair that lets
the fewest unlike documents meet. Texts that are equal but for white space and the case of A-Z are one
class and are compared once. Band hashes are shuffled; classes that share a band are candidates, whose
full shingle sets are then compared exactly, each pair in the first band that it shares only.

Buckets of the same classes are compared once. Small buckets share a task; a large one is cut into blocks
of at most BLOCK classes and about BLOCK_BYTES, and each pair of blocks is a task of its own. A task returns counts of links and
one edge for each class, never pairs, so a large group of near copies costs no pair rows. A bucket's work
grows with the square of its classes: of those that share a band, no pair is left out but for those whose numbers of shingles alone
keep them below the threshold. Joins skip the
shuffle of the documents only while the list to join is small in bytes (storage.sized).

Recall: a pair at the threshold shares a band with probability RECALL, one of more likeness with more
(0.85: 0.99995); pairs that share none are not linked. Every link that is given is exact.

Defined results: a text that is null or has no word is linked to nothing; one of fewer words than
a shingle has one shingle of them all; a very long text is compared whole, its set of shingles being one value; rows that repeat an id are one document for the group's
least id and are otherwise counted like any others; a null id can be in a group but is its least
only if all are null; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.storage import Scratch, sized, unused
from tidemill.llm.words import bound_batches, group_sum, mix, releasing, releasing_table, shingles, slices, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
RECALL, HASHES = 0.999, 128
BLOCK, BLOCK_BYTES = 256, 4_000_000
#: Bytes of shingle sets that one task compares, about.
TASK_BYTES = 2_000_000


def band_count(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of that many rows that meet the recall at the threshold: a pair is met with probability 1 - (1 - threshold ** rows) ** bands."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows that meet the recall at the threshold with at most so many hashes, and of such the ones by which the fewest pairs below the threshold meet, were likenesses evenly spread."""
    fits = [(band_count(threshold, rows, recall), rows) for rows in range(1, hashes + 1)]
    fits = [(bands, rows) for bands, rows in fits if bands * rows <= hashes] or fits[:1]
    below = np.arange(0.5, 100) / 100 * threshold
    return min(fits, key=lambda f: (1 - (1 - below ** f[1]) ** f[0]).mean())


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash_bands(hashes: np.ndarray, before: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band for each text, from the hashes of its shingles; texts without shingles must not be among them."""
    factors = _factors(bands * rows)
    out = np.zeros((len(before) - 1, bands), dtype=np.uint64)
    for k, factor in enumerate(factors):
        least = np.minimum.reduceat(hashes * factor, before[:-1])
        out[:, k // rows] = mix(out[:, k // rows] + least)
    return out


def text_keys(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's word sequence."""
    place = (np.arange(len(hashes)) - np.repeat(before[:-1], np.diff(before))).astype(np.uint64)
    n = np.diff(before).astype(np.uint64)
    return tuple(mix(group_sum(mix(hashes * np.uint64(salt) + place * np.uint64(0xBF58476D1CE4E5B9)), before) + n) for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, raw (a hash of the text as it is), key, check (the text's word sequence), grams (how many shingles) and bands of every text with a word; of the others, id and raw alone."""

    @releasing
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, before = word_hashes(part.column("text"))
                empty = np.diff(before) == 0
                key, check = text_keys(hashes, before)
                grams, at = shingles(hashes, before, SHINGLE)
                found = np.zeros((part.num_rows, bands), dtype=np.uint64)
                if len(grams):
                    found[~empty] = minhash_bands(grams, np.append(at[:-1][~empty], at[-1]), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("raw"), pa.array(key.view(np.int64), mask=empty), pa.array(check.view(np.int64), mask=empty), pa.array(np.diff(at)), lists], ["id", "raw", "key", "check", "grams", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("raw")).mapInArrow(signed, f"id {kind}, raw long, key long, check long, grams long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key and the sorted different shingle hashes, as binary, of each of docs (columns id and text)."""

    @releasing
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, before = word_hashes(part.column("text"))
                grams, at = shingles(hashes, before, SHINGLE)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(text_keys(hashes, before)[0].view(np.int64)), pa.array(sets, pa.binary())], ["key", "set"])

    return docs.select("text").mapInArrow(found, "key long, set binary")


def common(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """How many shingles each set in left has in common with each in right."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # numbers the shingles that more than one set has
    use = times[column] > 1
    owner, column = owner[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((left.stop - left.start, right.stop - right.start), dtype=np.float32)
    width = 4096
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        dense = np.zeros((len(sets), min(width, int(shared[-1]) + 1 - start)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[left] @ dense[right].T
    return out


def _linked(sets: list[np.ndarray], copies: np.ndarray, wanted: np.ndarray, left: slice, right: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set: linked ones, their copies, and the least place that links lead to here. wanted: which pairs of left and right to compare."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if wanted.sum() <= n:
        a, b = np.nonzero(wanted)
        a, b = a + left.start, b + right.start
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.float64)
        linked = both * (1 + threshold) >= threshold * (sizes[a] + sizes[b]) - 1e-6
        a, b = a[linked], b[linked]
    else:
        both = common(sets, left, right).astype(np.float64)
        a, b = np.nonzero(wanted & (both * (1 + threshold) >= threshold * (sizes[left][:, None] + sizes[right]) - 1e-6))
        a, b = a + left.start, b + right.start
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    weight = (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)
    label = np.arange(n)
    while True:  # least label over all links, until it is settled
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return links, weight, label
        label = new


def _of_like_size(sizes: np.ndarray, threshold: float, left: slice, right: slice) -> np.ndarray:
    """Which pairs of left and right can meet the threshold: no more shingles are shared than the smaller set has."""
    a, b = sizes[left][:, None], sizes[right]
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6


def _wanted(bands: np.ndarray, band: int, left: slice, right: slice) -> np.ndarray:
    """Which pairs of left and right (each pair once) share no band before band."""
    wanted = np.ones((left.stop - left.start, right.stop - right.start), dtype=bool)
    if left == right:
        wanted = np.triu(wanted, 1)
    for k in range(band):
        wanted &= bands[left, k][:, None] != bands[right, k]
    return wanted


def linked_within(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of each bucket's members compared exactly, each in the first band that it shares.

    members, a written table: bucket, size and bytes (of the bucket), band (its number), node, copies, bands. sets: key, set.
    node, links, weight (the copies of the linked), least (the least node that links lead to in this comparison), for each node that has a link in a block.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    members = members.withColumn("blocks", F.least(blocks, F.col("size").cast("int")))
    # Each row stands for an even share of its bucket's bytes.
    small = members.where("blocks = 1").agg(F.sum(F.col("bytes") / F.col("size"))).first()[0] or 0
    tasks = max(1, math.ceil(small / TASK_BYTES))
    placed = members.join(sets, F.col("node") == F.col("key")).drop("key")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("bucket", "band", "node", "copies", "bands", "set", "blocks", "block", other)
    placed = placed.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.col("bucket")).alias("task"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("low"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("high"),
        "bucket", "band", "node", "copies", "bands", "set", "block",
    )

    def compared(table: pa.Table) -> pa.Table:
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        table = table.sort_by([("bucket", "ascending"), ("block", "ascending"), ("node", "ascending")]).combine_chunks()
        bucket, block, band = (table.column(c).to_numpy() for c in ("bucket", "block", "band"))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        lists = table.column("bands").combine_chunks()
        bands = lists.flatten().to_numpy().reshape(len(lists), -1)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("set")]
        sizes = np.array([len(s) for s in sets])
        bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        links, weight, least = np.zeros_like(node), np.zeros_like(node), node.copy()
        for a, b in zip(bounds, bounds[1:], strict=False):
            n, cut = b - a, int(np.searchsorted(block[a:b], block[b - 1])) if across else None
            left, right = (slice(0, n), slice(0, n)) if cut is None else (slice(0, cut), slice(cut, n))
            wanted = _wanted(bands[a:b], band[a], left, right) & _of_like_size(sizes[a:b], threshold, left, right)
            if wanted.any():
                links[a:b], weight[a:b], label = _linked(sets[a:b], copies[a:b], wanted, left, right, threshold)
                least[a:b] = node[a:b][label]
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "weight": weight[some], "least": least[some]})

    return placed.groupBy("task", "low", "high").applyInArrow(releasing_table(compared), "node long, links long, weight long, least long")


def bucketed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The members that linked_within takes, from classes, a written table of key, copies, grams (how many shingles) and bands.

    Of buckets with the same members the one of the first band stays: no pair's first shared band is lost by that.
    """
    each = classes.select("key", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = each.groupBy("band", "hash").agg(F.count("*").alias("size"), (F.sum("grams") * 8).alias("bytes"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    buckets = buckets.where("size > 1").groupBy("size", "x", "y").agg(F.min(F.struct("band", "hash", "bytes")).alias("b")).select("size", "b.*")
    buckets = scratch.written(buckets, "buckets")
    members = each.drop("grams").join(buckets, ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "size", "bytes", "band", F.col("key").alias("node"))
    members = scratch.written(members, "members")
    return scratch.written(members.join(classes.select(F.col("key").alias("node"), "copies", "bands"), "node"), "candidates")


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for every row of docs.

    class_id: the least id of the group that links of at least threshold connect; copy_id: the least id among the
    texts that are equal but for white space and case; n_links: the other rows that the text is linked to, its copies
    among them; n_class_links: the different texts that it is linked to.
    """
    return _joined(docs, id_col, text_col, threshold, recall).drop("raw", "lead")


def _joined(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """join_groups with two columns more: raw, a hash of the row's text as it is, and lead, the row that stands for the group (null for a text without words)."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "join") as scratch:
        signed = scratch.written(signatures(own, "id", "text", *banding(threshold, recall)), "signatures")
        classes = signed.where("key is not null").groupBy("key", "check").agg(
            F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")).alias("lead")
        )
        classes = scratch.written(classes, "classes")
        members = bucketed(classes, scratch)

        # The shingle sets of candidates, each from one of the rows that have its text.
        asked = scratch.written(members.select(F.col("node").alias("key")).distinct().join(classes, "key").select(F.col("lead.id").alias("met_id"), F.col("lead.raw").alias("met_raw")), "asked")
        chosen = own.join(sized(asked), own["id"].eqNullSafe(asked["met_id"]) & (F.xxhash64(own["text"]) == asked["met_raw"]), "left_semi")
        sets = shingle_sets(chosen).groupBy("key").agg(F.first("set").alias("set"))

        linked = scratch.written(linked_within(members, sets, threshold), "links")
        counts = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
        groups = components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")), into=scratch).join(counts, "node")
        groups = scratch.written(groups.join(classes.select(F.col("key").alias("node"), "copy_id", "lead"), "node"), "groups")
        least = groups.groupBy("component").agg(F.min("copy_id").alias("class_id"), F.min("lead").alias("lead"))
        groups = groups.select(F.col("node").alias("key"), "component", "links", "weight").join(least, "component").drop("component")
        known = classes.select("key", "check", "copy_id", "copies", F.col("lead").alias("own_lead")).join(groups, "key", "left")
        known = scratch.written(known.select("key", "check", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", "copies", "links", "weight", F.coalesce("lead", "own_lead").alias("lead")), "known")
        return scratch.result(signed.drop("bands", "grams").join(known, ["key", "check"], "left").select(
            F.col("id").alias(id_col), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
            F.coalesce(F.col("copies") - 1 + F.coalesce("weight", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_class_links"), "raw", "lead",
        ))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns as they are, but of each group one row only: that of the least id, and of equal ids that of the least hash of its text.

    A row is known by its id and text, so others that share its id, or have none, stay as they are. Of rows of equal id and text, one stays.
    """
    gone_id, gone_raw, own_raw = unused(docs, "gone_id", "gone_raw", "own_raw")
    found = _joined(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    with Scratch(docs.sparkSession, "join-first") as scratch:
        rows = found.where("n_links > 0").groupBy("id", "raw", "lead").agg(F.count("*").alias("rows"))
        rows = rows.select(F.col("id").alias(gone_id), F.col("raw").alias(gone_raw), "rows", (F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("raw") == F.col("lead.raw"))).alias("is_lead"))
        rows = scratch.result(rows)
    again = rows.where("is_lead and rows > 1").select(gone_id, gone_raw)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(gone_raw))
    once = docs.join(sized(again), same, "left_semi").withColumn(own_raw, F.xxhash64(F.col(f"`{text_col}`"))).dropDuplicates([id_col, own_raw]).drop(own_raw)
    return docs.join(sized(rows.where("not is_lead or rows > 1").select(gone_id, gone_raw)), same, "left_anti").unionByName(once)


#: The rows of join_groups, every pair of texts that share a shingle being compared; banding meets all its links at the scale of a test.
ORACLE_SQL = """
WITH RECURSIVE
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
classes AS (SELECT w, min(doc_id) AS copy_id, count(*) AS copies FROM docs WHERE len(w) > 0 GROUP BY w),
grams AS (
  SELECT DISTINCT copy_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM classes),
sizes AS (SELECT copy_id, count(*) AS n FROM grams GROUP BY copy_id),
pairs AS (
  SELECT x.copy_id AS a, y.copy_id AS b, count(*) AS n
  FROM grams x JOIN grams y ON x.g = y.g AND x.copy_id <> y.copy_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.copy_id JOIN sizes y ON b = y.copy_id
  WHERE pairs.n * 10 >= 8 * (x.n + y.n - pairs.n)),
reached AS (
  SELECT copy_id AS node, copy_id AS other FROM classes
  UNION SELECT b, other FROM reached JOIN links ON a = node),
groups AS (SELECT node, min(other) AS class_id FROM reached GROUP BY node),
counts AS (SELECT a AS node, count(*) AS links, sum(copies) AS weight FROM links JOIN classes ON b = copy_id GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id,
       CAST(coalesce(copies - 1 + coalesce(weight, 0), 0) AS BIGINT) AS n_links, CAST(coalesce(links, 0) AS BIGINT) AS n_class_links
FROM docs LEFT JOIN classes USING (w) LEFT JOIN groups ON copy_id = groups.node LEFT JOIN counts ON copy_id = counts.node"""
