"""Resharding by minimum-cost flow: equal row counts in the new shards, fewest bytes moved.

A row may stay in the shard of the same number at no cost, or move at its bytes; every new shard takes the row
count that the law asks for. Each old shard is cut into three blocks: rows smaller than its marginal size, rows of that size, and
larger ones. The marginal size is that of the last row which may have to go, and Spark finds it: from counts by size class,
then, in the one class where it lies, from counts by size. Rows of one block that the flow splits are equally large, so the flow of
rows between blocks is the flow of fewest bytes between rows, whatever rows of the block go.

All moves pass through one hub, from any block that gives rows to any shard that lacks them. So a shortest augmenting path
always takes the smallest block that is left of any shard with too many rows, and no graph need be searched (solve); tests compare
it with successive shortest paths over the whole network. The driver holds three rows for each old shard. Rows then find
their place by a running count of chunks, which Spark makes in windows, so no task sees a whole shard and the driver no rows.

Defined results: a null text has no bytes and CRC-32 0; a null old shard counts as shard 0; of rows of the marginal size any may go, by id,
CRC-32 and place; repeated rows, and rows without an id, are rows of their own, also when files are rewritten; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch, unused

#: Size classes in each doubling of the size.
CLASSES_PER_DOUBLING = 2
#: Rows that are numbered together, about.
CHUNK_ROWS = 2_000
#: Bytes of texts in a rewritten file, about.
FILE_BYTES = 128_000_000


def solve(blocks: Sequence[tuple[int, int, int, float]], shards: int) -> tuple[dict[tuple[int, int], int], dict[int, list[tuple[int, int]]]]:
    """blocks: (old shard, class, rows, mean bytes). Returns the rows that leave each block, and for each old shard the (new shard, rows) that its leaving rows go to.

    Every new shard gets floor or ceil of the mean number of rows. The flow of least cost: over the hub each shard with too many rows
    sends its smallest, block by block, and each that lacks rows gets them. The places above the floor, one a shard, go where they save most: to
    the shards whose last row to go is the largest; those left over, to the first others.
    """
    least, more = divmod(sum(rows for *_, rows, _ in blocks), shards)
    own: dict[int, list[tuple[float, int, int]]] = {}
    for old, kind, rows, mean in blocks:
        own.setdefault(old, []).append((mean, kind, rows))
    surplus: dict[int, int] = {}
    saved = []
    for old, parts in own.items():
        parts.sort()
        n = surplus[old] = max(0, sum(rows for *_, rows in parts) - (least if old < shards else 0))
        if n and old < shards:
            before = 0
            for mean, _, rows in parts:
                before += rows
                if before >= n:
                    saved.append((-mean, old))
                    break
    room = {shard: max(0, least - sum(rows for *_, rows in own.get(shard, []))) for shard in range(shards)}
    stay = [old for _, old in sorted(saved)[:more]]
    for old in stay:
        surplus[old] -= 1
    kept = set(stay)
    others = (s for s in range(shards) if s not in kept and not surplus.get(s))
    for _ in range(more - len(stay)):
        room[next(others)] += 1
    leaving = {}
    for old, parts in own.items():
        left = surplus[old]
        for _, kind, rows in parts:
            if gone := min(rows, left):
                leaving[old, kind] = gone
                left -= gone
    arriving = [[shard, n] for shard, n in room.items() if n]
    moves: dict[int, list[tuple[int, int]]] = {}
    for old in sorted(own):
        while surplus[old]:
            amount = min(surplus[old], arriving[-1][1])
            moves.setdefault(old, []).append((arriving[-1][0], amount))
            surplus[old] -= amount
            arriving[-1][1] -= amount
            if not arriving[-1][1]:
                arriving.pop()
    return leaving, moves


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with one column more: the row's number within its keys, without a gap from 0. rows has a column chunk, by which a key is dealt to several tasks."""
    within = Window.partitionBy(*keys, "chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(counts, [*keys, "chunk"]).withColumn(name, F.col("before") + F.row_number().over(within) - 1).drop("before")


def _chunk(chunks: Column, salt: int) -> Column:
    """By a row's place in the table, as rows of equal id and text may be many."""
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.greatest(chunks.cast("long"), F.lit(1)))


def reshard(docs: DataFrame, old_shard: Column, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and old_shard of every row of docs.

    size: UTF-8 bytes of the text and 1. law: rows, so the shards' row counts differ by one at most.
    """
    with Scratch(docs.sparkSession, "reshard") as scratch:
        return scratch.result(_resharded(docs, old_shard, shards, id_col, text_col, scratch))


def _marginal_sizes(rows: DataFrame, shards: int) -> dict[int, int]:
    """For each old shard that can have too many rows the size of the largest of its smallest that may have to go."""
    classes: dict[int, list[tuple[int, int]]] = {}
    for old, kind, n in rows.groupBy("old", "class").count().collect():
        classes.setdefault(old, []).append((kind, n))
    least = sum(n for parts in classes.values() for _, n in parts) // shards
    asked = []
    for old, parts in classes.items():
        gone = sum(n for _, n in parts) - least
        if old < shards and gone > 0:
            for kind, n in sorted(parts):
                if gone <= n:
                    asked.append((old, kind, gone))
                    break
                gone -= n
    if not asked:
        return {}
    asked = F.broadcast(rows.sparkSession.createDataFrame(asked, "old int, class int, gone long"))
    # A class holds no more sizes than bytes, however many its rows.
    counts = rows.join(asked, ["old", "class"]).groupBy("old", "gone", "size").count()
    reached = F.sum("count").over(Window.partitionBy("old").orderBy("size"))
    found = counts.withColumn("reached", reached).where("reached >= gone").groupBy("old").agg(F.min("size"))
    return {old: size for old, size in found.collect()}


def _resharded(docs: DataFrame, old_shard: Column, shards: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("crc"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"))
    rows = scratch.written(rows.withColumn("class", F.floor(F.log2("size") * CLASSES_PER_DOUBLING).cast("int")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    marginal = F.broadcast(spark.createDataFrame(list(_marginal_sizes(rows, shards).items()), "old int, marginal long"))
    rows = rows.join(marginal, "old", "left").withColumn("class", F.coalesce(F.signum(F.col("size") - F.col("marginal")).cast("int"), F.lit(0))).drop("marginal")
    blocks = sorted(tuple(r) for r in rows.groupBy("old", "class").agg(F.count("*"), F.avg("size")).collect())
    leaving, moves = solve(blocks, shards)

    # So many of a block's rows leave; where to, their count over the old shard's blocks tells.
    before: dict[int, int] = {}
    known = []
    for old, kind, n, _ in blocks:
        leave = leaving.get((old, kind), 0)
        known.append((old, kind, n, leave, before.get(old, 0)))
        before[old] = before.get(old, 0) + leave
    ends = []
    for old, parts in moves.items():
        end = 0
        for shard, n in parts:
            end += n
            ends.append((old, shard, end))
    known_blocks = F.broadcast(spark.createDataFrame(known, "old int, class int, rows long, leave long, gone long"))
    targets = F.broadcast(spark.createDataFrame(ends, "old int, shard int, end long").groupBy("old").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("targets")))
    counted = rows.join(known_blocks, ["old", "class"]).withColumn("chunk", _chunk(F.ceil(F.col("rows") / CHUNK_ROWS), 1))
    counted = _numbered(counted, ["old", "class"], ["size", "id", "crc", "row"], "place").join(targets, "old", "left")
    rank = F.when(F.col("place") < F.col("leave"), F.col("place") + F.col("gone"))
    target = F.filter("targets", lambda t: t["end"] > F.col("rank"))[0]["shard"]
    placed = counted.withColumn("rank", rank).withColumn("shard", F.when(F.col("rank").isNull(), F.col("old")).otherwise(target))
    placed = scratch.written(placed.select("id", "size", "crc", "old", "shard", "row"), "places")

    chunks = F.lit(math.ceil(sum(b[2] for b in blocks) / shards / CHUNK_ROWS))
    return _numbered(placed.withColumn("chunk", _chunk(chunks, 2)), ["shard"], ["id", "crc", "old", "row"], "slot").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )


def rewrite_affected(docs: DataFrame, places: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files of those shards that gain or lose rows, as shard=N folders under path; the files of other shards stay.

    docs: the whole table, not read from path itself. places: what reshard gives. A row finds its shard by its id, size and CRC-32;
    where rows that agree in these are many or go to several shards, they are numbered on both sides, and so keep every row. A shard is
    cut into files of about FILE_BYTES. A column of docs that is named shard gives way to the new one.
    """
    docs = docs.drop("shard")
    of_id, of_size, of_crc, pieces, row = unused(docs, "of_id", "of_size", "of_crc", "pieces", "row")
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8")
    own = docs.withColumns({of_id: F.col(f"`{id_col}`"), of_size: F.octet_length(text).cast("long") + 1, of_crc: F.crc32(text)})
    same = [of_id, of_size, of_crc]

    def found(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """left with the columns of right, whose columns for the key have an underscore more."""
        fits = [left[c].eqNullSafe(right[f"{c}_"]) for c in (*same, *more)]
        return left.join(right, fits).drop(*(f"{c}_" for c in (*same, *more)))

    with Scratch(docs.sparkSession, "rewrite") as scratch:
        moved = places.where("shard <> old_shard")
        sizes = places.groupBy("shard").agg(F.ceil(F.sum("size") / FILE_BYTES).alias(pieces))
        affected = scratch.written(moved.select("shard").union(moved.select("old_shard")).distinct().join(sizes, "shard"), "affected")
        to = places.select(F.col(id_col).alias(f"{of_id}_"), F.col("size").alias(f"{of_size}_"), F.col("text_crc32").alias(f"{of_crc}_"), "shard")
        kinds = to.groupBy(*(f"{c}_" for c in same)).agg(F.min("shard").alias("shard"), ((F.min("shard") != F.max("shard")) | (F.count("*") > CHUNK_ROWS)).alias("several"))
        kinds = scratch.written(kinds, "kinds")
        settled = found(own, kinds.where("not several").drop("several"))
        # Rows that agree are numbered by their place in written tables.
        several = kinds.where("several").drop("several", "shard")
        mine = scratch.written(found(own, several).withColumn(row, F.monotonically_increasing_id()), "rows")
        theirs = several.join(to.withColumnsRenamed({f"{c}_": c for c in same}), [several[f"{c}_"].eqNullSafe(F.col(c)) for c in same]).select(*same, "shard")
        theirs = scratch.written(theirs.withColumn(row, F.monotonically_increasing_id()), "shards")
        number, chunk = unused(mine, "number", "chunk")
        counted = [_numbered_alike(t, same, row, number, chunk) for t in (mine, theirs)]
        dealt = found(counted[0], counted[1].drop(row).withColumnsRenamed({c: f"{c}_" for c in (*same, number)}), number)
        columns = [f"`{c}`" for c in (*docs.columns, "shard")]
        rows = settled.select(*columns, of_crc, of_id, F.lit(0).cast("long").alias(number)).unionByName(dealt.select(*columns, of_crc, of_id, number))
        rows = rows.join(F.broadcast(affected), "shard")
        rows = rows.repartition("shard", F.pmod(F.xxhash64(of_id, of_crc, number), F.col(pieces))).select(*columns)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def _numbered_alike(rows: DataFrame, keys: Sequence[str], row: str, name: str, chunk: str) -> DataFrame:
    """rows, a written table, with one column more: the row's number among those with its keys, nulls being alike. Rows of a key are numbered in chunks of neighbours, so that no task sees them all."""
    (before,) = unused(rows, "before")
    rows = rows.withColumn(chunk, F.floor(F.col(row) / CHUNK_ROWS))
    within = Window.partitionBy(*keys, chunk).orderBy(row)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, chunk).agg(F.count("*").alias("rows"))
    counts = counts.select(*(F.col(c).alias(f"{c}__") for c in (*keys, chunk)), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    fits = [rows[c].eqNullSafe(counts[f"{c}__"]) for c in (*keys, chunk)]
    numbered = rows.join(counts, fits).withColumn(name, F.col(before) + F.row_number().over(within) - 1)
    return numbered.drop(before, chunk, *(f"{c}__" for c in (*keys, chunk)))
