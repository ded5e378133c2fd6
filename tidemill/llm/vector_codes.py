"""Product quantisation of vectors, its codebooks trained by Lloyd's rounds with kd-tree filtering.

Vectors become whole numbers, are cut into equal parts, and each part position has a codebook. Every partition cuts
its rows into blocks and builds for each block and part position a kd-tree over the parts there, whose nodes keep the bounding
box, sum and count of what is under them. The trees are written once. In a round each walks down with
the codebook's entries as candidates: of two candidates the one drops out that isn't nearer anywhere in a node's box;
where one is left, the whole subtree is its own, by the node's sum and count; in a leaf the rest are compared. A
task gives the sums of its own entries, which Spark adds up before the driver divides them. So the driver holds the
codebooks alone, and a block's memory is bounded.

All is done in whole numbers, so results depend neither on partitions nor on their order.

Defined results: rows whose vector is null or holds null, NaN or infinity are left out. The vectors that fix the length are those of
the least id whose length is a multiple of the parts; one of another length, or with a component too large
for exact squares in a long (beyond about 1e8 for 64 components), is kept with null code and error, and isn't learned from. Entries
begin as the least ids' parts, nulls last; rows that repeat an id are rows of their own, in order of their vectors; fewer rows than entries
make fewer entries. On a tie the lower entry is taken; an entry without parts stays. Null labels are one label. An empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch, sized
from tidemill.llm.words import bound_batches, releasing

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, LEAF = 4096, 32


@functools.cache
def _nodes(n: int) -> int:
    """How many nodes the tree over n points has."""
    return 1 if n <= LEAF else 1 + _nodes(n // 2) + _nodes(n - n // 2)


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which points lie under the tree's leaves, and each node's low and high corner and sum, nodes before their children, left before right.

    A node's points are halved at the median of the dimension in which its box is longest.
    """
    order = np.arange(len(points))
    nodes = np.zeros((_nodes(len(points)), 3, points.shape[1]), dtype=np.int64)
    todo = [(0, 0, len(points))]
    while todo:
        k, a, b = todo.pop()
        own = points[order[a:b]]
        nodes[k] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
        if b - a > LEAF:
            half = (b - a) // 2
            by = np.argpartition(own[:, (nodes[k, 1] - nodes[k, 0]).argmax()], half)
            order[a:b] = order[a:b][by]
            todo += [(k + 1, a, a + half), (k + 1 + _nodes(half), a + half, b)]
    return order, nodes


def nearest(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each of points (in the tree's order), and of each entry the sum and count of its points."""
    owner = np.zeros(len(points), dtype=np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
    each = np.ones(len(points), dtype=bool)  # those that no whole subtree has brought
    largest = max(int(np.abs(nodes[0, :2]).max()), int(np.abs(entries).max()))
    # Squares that a double holds exactly are multiplied as doubles.
    kind = np.float64 if 4 * largest * largest * points.shape[1] < 1 << 52 else np.int64
    todo = [(0, 0, len(points), np.arange(len(entries)))]
    while todo:
        k, a, b, left = todo.pop()
        if len(left) > 1:
            low, high, _ = nodes[k]
            own = entries[left]
            best = ((2 * own - (low + high)) ** 2).sum(axis=1).argmin()
            corner = np.where(own > own[best], high, low)  # of the box, the one most on the candidate's side
            further = ((own - corner) ** 2 - (own[best] - corner) ** 2).sum(axis=1)
            left = left[(further < 0) | ((further == 0) & (left <= left[best]))]
        if len(left) == 1:
            owner[a:b], each[a:b] = left[0], False
            sums[left[0]] += nodes[k, 2]
            counts[left[0]] += b - a
        elif b - a > LEAF:
            half = (b - a) // 2
            todo += [(k + 1, a, a + half, left), (k + 1 + _nodes(half), a + half, b, left)]
        else:
            own = entries[left].astype(kind)
            owner[a:b] = left[((own * own).sum(axis=1) - 2 * (points[a:b].astype(kind) @ own.T)).argmin(axis=1)]
    np.add.at(sums, owner[each], points[each])
    return owner, sums, counts + np.bincount(owner[each], minlength=len(entries))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _blocks(parts: int):
    """A function of Arrow batches of id, label and vector (longs, all of one length) that gives a row for each block: ids, labels, and for each part position order, points and nodes."""

    @releasing
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                whole = pa.array([0, block.num_rows], pa.int32())
                trees = {"orders": [], "points": [], "nodes": []}
                for points in np.split(_matrix(block.column("vector")), parts, axis=1):
                    order, nodes = build_tree(points)
                    for name, x in (("orders", order.astype(np.int32)), ("points", points[order].astype(np.int32)), ("nodes", nodes)):
                        trees[name].append(x.tobytes())
                columns = [pa.ListArray.from_arrays(whole, block.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.list_(pa.binary())) for x in trees.values())], ["ids", "labels", *trees])

    return built


def _trees(batch: pa.RecordBatch, k: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """order, points and nodes for each part position of row k."""
    for order, points, nodes in zip(*(batch.column(c)[k].as_py() for c in ("orders", "points", "nodes")), strict=True):
        yield np.frombuffer(order, np.int32), np.frombuffer(points, np.int32).reshape(-1, width).astype(np.int64), np.frombuffer(nodes, np.int64).reshape(-1, 3, width)


def train(blocks: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part position, entry, place in the part) after so many rounds over blocks, a written table."""
    parts, n, width = entries.shape
    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(entries)

        @releasing
        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            out = np.zeros((parts, n, width + 1), dtype=np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    for p, (_, points, nodes) in enumerate(_trees(batch, k, width)):
                        _, sums, counts = nearest(points, nodes, now[p])
                        out[p, :, :width] += sums
                        out[p, :, width] += counts
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], ["at", "value"])

        found = blocks.select("orders", "points", "nodes").mapInArrow(summed, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros((parts, n, width + 1), dtype=np.int64)
        total.ravel()[found.column("at").to_numpy()] = found.column("value").to_numpy()
        sums, counts = total[..., :width], total[..., width:]
        entries = np.where(counts > 0, sums // np.maximum(counts, 1), entries)
        shared.unpersist()
    return entries


def encode(blocks: DataFrame, entries: np.ndarray) -> DataFrame:
    """id, label, code (each part's entry in hexadecimal digits, in order of parts) and error (squared distance) of every row of blocks."""
    parts, n, width = entries.shape
    digits = max(2, len(f"{n - 1:x}"))
    names = np.frombuffer("".join(f"{k:0{digits}x}" for k in range(n)).encode(), dtype=np.uint8).reshape(n, digits)
    shared = blocks.sparkSession.sparkContext.broadcast(entries)

    @releasing
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                code, error = np.zeros((len(ids), parts, digits), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for p, (order, points, nodes) in enumerate(_trees(batch, k, width)):
                    owner = nearest(points, nodes, now[p])[0]
                    code[order, p] = names[owner]
                    error[order] += ((points - now[p][owner]) ** 2).sum(axis=1)
                offsets = np.arange(len(ids) + 1, dtype=np.int32) * (parts * digits)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(code.tobytes())), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {c: blocks.schema[f"{c}s"].dataType.elementType.simpleString() for c in ("id", "label")}
    return blocks.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row for every vector that is kept: id, code, error, label_error (the errors of all with its label) and codebooks_sha256 (of all final entries' components)."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", odd))
    by_id = (F.col("id").asc_nulls_last(), F.col("vector"))
    with Scratch(vectors.sparkSession, "codes") as scratch:
        first = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(*by_id).select(F.size("vector")).first()
        length = first[0] if first else parts
        most = math.isqrt((1 << 59) // length)
        fits = (F.size("vector") == length) & ~F.exists("vector", lambda x: F.abs(x * scale) >= most)
        kept = kept.withColumn("fits", fits)
        whole = kept.where("fits").select("id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
        schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, orders array<binary>, points array<binary>, nodes array<binary>"
        blocks = scratch.written(whole.mapInArrow(_blocks(parts), schema), "blocks")
        begun = whole.orderBy(*by_id).limit(entries).select("vector").toArrow().column("vector")
        width = length // parts
        books = np.zeros((parts, 0, width), dtype=np.int64)
        if len(begun):
            books = train(blocks, _matrix(begun.combine_chunks()).reshape(-1, parts, width).transpose(1, 0, 2).copy(), rounds)
            found = encode(blocks, books)
        else:
            found = whole.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        others = kept.where("not fits").select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        found = scratch.written(found.unionByName(others), "coded")
        totals = scratch.written(found.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "totals")
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        found = found.join(sized(totals), F.col("label").eqNullSafe(F.col("of")))
        return scratch.result(found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _round(k: int) -> str:
    """SQL of the codebooks after round k."""
    return f"""
near{k} AS MATERIALIZED (SELECT vec_id, p, part, min((norm + own_norm - 2 * list_inner_product(part, entry), e)) AS best FROM parts JOIN book{k - 1} USING (p) GROUP BY ALL),
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, best[2] AS e, i, floor(sum(part[i]) / count(*)) AS m FROM near{k}, unnest(range(1, 17)) AS places(i) GROUP BY ALL) GROUP BY ALL),
book{k} AS MATERIALIZED (
  SELECT p, e, entry, list_inner_product(entry, entry) AS norm FROM (
    SELECT p, e, coalesce(mean{k}.entry, old.entry) AS entry FROM book{k - 1} AS old LEFT JOIN mean{k} USING (p, e))),"""


#: The rows of codes with the defaults for vectors of 64 components, every entry being compared with every part; sums of whole numbers in doubles are exact here.
ORACLE_SQL = f"""
WITH
kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (
  SELECT vec_id, p, part, list_inner_product(part, part) AS own_norm FROM (SELECT vec_id, p, v[16 * p + 1:16 * p + 16] AS part FROM kept, unnest(range(4)) AS positions(p))),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry, own_norm AS norm
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),{"".join(map(_round, range(1, ROUNDS + 1)))}
near AS (SELECT vec_id, p, min((norm + own_norm - 2 * list_inner_product(part, entry), e)) AS best FROM parts JOIN book{ROUNDS} USING (p) GROUP BY ALL),
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near GROUP BY vec_id),
labelled AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM coded JOIN kept USING (vec_id)),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(entry, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM labelled, digest"""
