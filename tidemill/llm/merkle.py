"""Merkle fingerprints of texts, with DataFrame functions only.

A text is a tree: sections (cut at blank lines), paragraphs (cut at line ends), sentences
(cut at ". "), clauses (cut at ", "). A leaf is the SHA-256 of a clause, every node above it the SHA-256 of its
children's digests, and the fingerprint is the root. Cutting at fixed separators loses
nothing, so equal texts, and only they, have equal roots; where roots differ, the differing
branches say which section and paragraph was edited. The likeness of two fingerprints is
the Dice coefficient of their trees' different leaves that aren't empty.

Defined results: a null text counts as empty; two texts without such a leaf have likeness 1; rows with one
id are put in order by the MD5 of their texts; a null id comes first; a table of one row is followed by
itself; an empty table gives an empty table. Only the two named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What stands for a null id in the order of ids.
NO_ID = -(1 << 63)


def _sections(text: Column) -> Column:
    return F.split(text, "\n\n")


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def paragraph_nodes(text: Column) -> Column:
    """For each section, the digests of its paragraphs."""
    sentence = lambda s: _node(F.transform(F.split(s, ", "), lambda c: F.sha2(c, 256)))
    paragraph = lambda p: _node(F.transform(F.split(p, r"\. "), sentence))
    return F.transform(_sections(text), lambda section: F.transform(F.split(section, "\n"), paragraph))


def root(nodes: Column) -> Column:
    """The fingerprint above the nodes that paragraph_nodes gives."""
    return _node(F.transform(nodes, _node))


def leaves(text: Column) -> Column:
    """Short digests of the different clauses that the tree of text has, but for the empty one."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"\n\n|\n|[.,] "), lambda s: s != ""), lambda s: F.xxhash64(s)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves; 1 if both are empty."""
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1)))


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 0, of the first branch in which two arrays of nodes differ; null if they don't."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.nullif(F.array_position(differs, True), F.lit(0)) - 1


def _bucket(key: Column, bounds: list[float]) -> Column:
    """The number of bounds that are at most key, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    full = F.greatest(count(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    return full * width + count(F.element_at(F.lit([g + [math.inf] * (width - len(g)) for g in groups]), full + 1))


def _range(key: Column, part: Column, quantiles: list[float]) -> Column:
    """The range that a row falls in, by its key and then by its part (0 to 1). A key that fills several quantiles is cut into as many ranges by part."""
    bounds = sorted(set(quantiles))
    # From 2 ** 53 on, neighbouring ids are one double, so their rows must not be dealt by part; the value of a null id is alone in its place.
    more = [quantiles.count(b) - 1 if abs(b) < 2.0**53 or b == float(NO_ID) else 0 for b in bounds]
    bucket = _bucket(key.cast("double"), bounds)
    if not any(more):
        return bucket
    before = F.lit([0, *(i + sum(more[: i - 1]) for i in range(1, len(bounds) + 1))])
    extra, value = F.lit([0, *more]), F.lit([math.nan, *bounds])
    own = F.element_at(extra, bucket + 1)
    return F.element_at(before, bucket + 1) + F.when(key.cast("double") == F.element_at(value, bucket + 1), F.floor(part * (own + 1))).otherwise(own)


def with_next(docs: DataFrame, carried, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """id, text, and for each row the text of the next row in ascending order of id; after the last comes the first.

    carried(text) gives further columns to compute once per text, as a dict; each also comes
    with the prefix next_. Rows are dealt to ranges by the quantiles of their ids, and rows of an id that
    fills several by their texts' MD5, so no task sees more than its range; the first row of each range is also
    sent to the range before it. Only rows of equal id and text always share a range. One row per
    range is all that the driver sees.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))
    quantiles = rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    rows = rows.withColumn("part", F.conv(F.substring(F.md5(F.encode("text", "utf-8")), 1, 8), 16, 10).cast("long"))
    rows = rows.withColumn("bucket", _range(F.col("key"), F.col("part") / 2.0**32, quantiles).cast("int"))
    firsts = sorted((b, *first) for b, first in rows.groupBy("bucket").agg(F.min(F.struct("key", "part")).alias("first")).collect())
    if not firsts:
        firsts = [(0, 0, 0)]
    before = [(b, key, part, firsts[i - 1][0], int(i == 0)) for i, (b, key, part) in enumerate(firsts)]
    ranges = spark.createDataFrame(before, "bucket int, first long, first_part long, to int, wrapped int")
    dealt = rows.join(F.broadcast(ranges), "bucket").select(
        "id", "text", "key", "part",
        F.explode(F.concat(
            F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"), F.lit(0).alias("late"))),
            F.when((F.col("key") == F.col("first")) & (F.col("part") == F.col("first_part")), F.array(F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"), F.col("wrapped").alias("late")))).otherwise(F.array().cast("array<struct<bucket:int,guest:boolean,late:int>>")),
        )).alias("to"),
    ).select("id", "text", "key", "part", "to.*")
    more = carried(F.col("text"))
    dealt = dealt.repartition("bucket").withColumns(more)
    order = Window.partitionBy("bucket").orderBy("late", "key", "part", "text", "guest")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *more)}).where("not guest").drop("key", "part", "bucket", "guest", "late")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), root(paragraph_nodes(text)).alias("fingerprint"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, in which the next text's first code points replace the last half.

    Beside the likenesses, edited_section and edited_paragraph (within it) tell from the trees alone where the edit begins.
    """
    rows = with_next(docs, lambda text: {"leaves": leaves(text)}, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select(
        "id", n.cast("long").alias("n_chars"), "edited", "leaves",
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        paragraph_nodes(F.col("text")).alias("nodes"), paragraph_nodes(F.col("edited")).alias("edited_nodes"), leaves(F.col("edited")).alias("edited_leaves"),
    ).withColumn("section", first_difference(F.col("nodes"), F.col("edited_nodes")))
    at = (F.col("section") + 1).cast("int")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("nodes")).alias("fingerprint"), root(F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), "near_next",
        F.col("section").alias("edited_section"),
        first_difference(F.coalesce(F.try_element_at("nodes", at), F.array()), F.coalesce(F.try_element_at("edited_nodes", at), F.array())).alias("edited_paragraph"),
    )


_NODES = "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256(array_to_string(list_transform(string_split(p, '. '), lambda x: sha256(array_to_string(list_transform(string_split(x, ', '), lambda c: sha256(c)), ''))), ''))))"
_ROOT = "sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(s, ''))), ''))"
_LEAVES = "list_filter(list_distinct(flatten(list_transform(string_split({0}, chr(10)), lambda p: flatten(list_transform(string_split(p, '. '), lambda x: string_split(x, ', ')))))), lambda c: c <> '')"
_LIKE = "CASE WHEN len(own) + len({0}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(own, {0})) / (len(own) + len({0})) END"
_FIRST = "CAST(nullif(coalesce(list_position(list_transform(list_zip({0}, {1}), lambda z: z[1] IS DISTINCT FROM z[2]), true), 0), 0) - 1 AS BIGINT)"

#: The rows of edit_report.
ORACLE_SQL = f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, left(md5(coalesce(text, '')), 8), coalesce(text, '')) AS place
  FROM documents),
rows AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY place), first_value(text) OVER (ORDER BY place)) AS next
  FROM ordered),
edits AS (SELECT *, substring(text, 1, n - n // 2) || substring(next, 1, n // 2) AS edited FROM rows),
trees AS (
  SELECT *, {_LEAVES.format("text")} AS own, {_LEAVES.format("next")} AS nexts, {_LEAVES.format("edited")} AS editeds,
         {_NODES.format("text")} AS nodes, {_NODES.format("edited")} AS edited_nodes
  FROM edits),
located AS (SELECT *, {_FIRST.format("nodes", "edited_nodes")} AS edited_section FROM trees)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       {_ROOT.format("nodes")} AS fingerprint, {_ROOT.format("edited_nodes")} AS edited_fingerprint,
       {_LIKE.format("editeds")} AS near_edited, {_LIKE.format("nexts")} AS near_next, edited_section,
       {_FIRST.format("coalesce(nodes[edited_section + 1], [])", "coalesce(edited_nodes[edited_section + 1], [])")} AS edited_paragraph
FROM located"""
