"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a template: tokens (between white space) that hold a digit are <num>, capitalised
tokens are <name>, units of measure after a number are <unit>, and the rest stay. Windows of
WINDOW template tokens are hashed and joined with the benchmark's windows, so a question is found
however its numbers and names were changed. A document leaks an item if it has at least COVERAGE
of the item's windows and its slots are consistent: what stands for one value of the item is, for
at least CONSISTENT of the values, always the same in the document.

A document can hold several questions like the item. The rule is applied to each occurrence, that is the
windows at one distance from their places in the item, or at distances within one of DRIFTS (a name
can have more tokens than the item's), and to the whole document; one that fulfils it is enough.

Windows begin at every token on both sides, so every shared run of WINDOW tokens is met. No occurrence has more of an
item's windows than the whole text, so these are counted first, and slots and occurrences are looked at only for the pairs of a
text and an item that reach COVERAGE so. Equal texts are compared once.

Windows of which more than half are placeholders are no evidence. An item that has no other is
compared by its own words, in lower case and without the punctuation around them: by windows of WINDOW
words, or, if it has fewer words, by all of them in a row.

Defined results: null texts count as empty, and an item without words is no evidence; a very long text is read whole, in one
row; of a pair's occurrences the one with the most windows counts, then the one of the most consistent values, then one as in the item, then
the one of the most slots; rows of the
benchmark with equal item and text are one item, and repeated documents are each reported; an empty table on either side gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch, sized, unused

WINDOW, COVERAGE, CONSISTENT = 8, 0.5, 0.75
#: Tokens; each width is dealt twice, half a width apart.
DRIFTS = (4, 16)

UNITS = "mm cm m km mg g kg ml l ms s min h km/h m/s inch inches ft feet mile miles yd oz lb lbs gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees".split()


_MARK = r"[\p{Pi}\p{Pf}\p{Ps}\p{Pe}\"'.,;:!?¿¡]"


def template(text: Column) -> Column:
    """text with placeholders, token for token."""
    text = F.regexp_replace(text, r"(?<!\S)[^\s\d]*+\d\S*+", "<num>")
    text = F.regexp_replace(text, r"(?<!\S)\p{Lu}\S*+", "<name>")
    return F.regexp_replace(text, r"<num>(\s+)(?:" + "|".join(UNITS) + r")(?!\S)", "<num>$1<unit>")


def tokens(text: Column) -> Column:
    return F.split(text, r"\s+")


def plain(text: Column) -> Column:
    """The words of text as they stand, but for case and the punctuation around them."""
    text = F.regexp_replace(F.lower(text), rf"(?<!\S){_MARK}+(?=[^\s])|(?<=[^\s]){_MARK}+(?!\S)", "")
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _places(tokens: Column, size: Column) -> Column:
    """Where size tokens in a row begin, from 1."""
    last = F.size(tokens) - size + 1
    return F.when((last >= 1) & (size >= 1), F.sequence(F.lit(1), last, F.lit(1))).otherwise(F.array().cast("array<int>"))


def _template_hashes(tokens: Column) -> Column:
    return F.transform(_places(tokens, F.lit(WINDOW)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))


def _plain_hashes(words: Column, size: Column) -> Column:
    """A hash of each size words in a row, apart from those of templates."""
    return F.transform(_places(words, size), lambda i: F.xxhash64(F.lit("plain"), F.slice(words, i, size)))


def _slots(i: Column) -> Column:
    """The values in the placeholders of the window at i: what the column o has where the column t has a placeholder."""
    own = F.zip_with(F.slice("t", i, WINDOW), F.slice("o", i, WINDOW), lambda t, o: F.when(t.startswith("<"), o))
    return F.filter(own, lambda x: x.isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair of a document and an item that it leaks.

    matched_windows of item_windows are in the document; of slot_values values in the item's placeholders,
    consistent_values stand for one value of the document each; reparameterised: some stand for another value.
    """
    with Scratch(docs.sparkSession, "leaks") as scratch:
        return scratch.result(_leaks(docs, benchmark, scratch, id_col, text_col, item_col, item_text_col))


def _leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    none = F.array().cast("array<string>")
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    items = items.select(F.xxhash64("item", "text").alias("n"), "item", tokens(template(F.col("text"))).alias("t"), tokens(F.col("text")).alias("o"), plain(F.col("text")).alias("p"))
    literal = lambda part: F.size(F.filter(part, lambda t: ~t.startswith("<"))) * 2 >= WINDOW
    items = items.withColumn("usable", F.filter(_places(F.col("t"), F.lit(WINDOW)), lambda i: literal(F.slice("t", i, WINDOW)))).withColumn("size", F.least(F.size("p"), F.lit(WINDOW)))
    by_template = F.transform("usable", lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice("t", i, WINDOW)).alias("hash"), _slots(i).alias("slots")))
    by_words = F.transform(_plain_hashes(F.col("p"), F.col("size")), lambda h, i: F.struct((i + 1).alias("place"), h.alias("hash"), none.alias("slots")))
    sizes_asked = sorted(r[0] for r in items.where((F.size("usable") == 0) & (F.col("size") > 0)).select("size").distinct().collect())
    # An item's window counts once, with the slots of its first place.
    item_windows = items.select("n", "item", F.explode(F.when(F.size("usable") > 0, by_template).otherwise(by_words)).alias("w"))
    item_windows = item_windows.groupBy("n", "w.hash").agg(F.first("item").alias("item"), F.min_by("w.slots", "w.place").alias("slots"), F.min("w.place").alias("at"))
    item_windows = scratch.written(item_windows, "items")
    sizes = scratch.written(item_windows.groupBy("n").agg(F.count("*").alias("item_windows")), "item-sizes")
    known = scratch.written(item_windows.select("hash").distinct(), "hashes")

    # All windows of all texts, but for their slots, which only those that meet an item's get.
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    words = [plain(F.col("text")).alias("p")] if sizes_asked else []
    met = own.select("key", tokens(template(F.col("text"))).alias("t"), *words)
    kinds = [F.struct(F.lit(0).alias("kind"), _template_hashes(F.col("t")).alias("hashes"))] + [F.struct(F.lit(size).alias("kind"), _plain_hashes(F.col("p"), F.lit(size)).alias("hashes")) for size in sizes_asked]
    met = met.select("key", F.explode(F.array(*kinds)).alias("k")).select("key", "k.kind", F.posexplode("k.hashes").alias("place", "hash"))
    met = met.join(sized(known), "hash", "left_semi").select("key", "kind", "place", "hash").distinct().withColumn("place", F.col("place") + 1)
    met = scratch.written(met, "met")
    matched = met.select("key", "hash").distinct().join(sized(item_windows.select("n", "hash")), "hash").groupBy("key", "n").agg(F.count("*").alias("matched"))
    pairs = scratch.written(matched.join(sized(sizes), "n").where(F.col("matched") >= COVERAGE * F.col("item_windows")).select("key", "n"), "pairs")
    texts = own.join(sized(pairs.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = texts.join(met.groupBy("key").agg(F.collect_list(F.struct("kind", "place", "hash")).alias("met")), "key")
    texts = texts.select("key", "met", tokens(template(F.col("text"))).alias("t"), tokens(F.col("text")).alias("o"))
    slots = lambda m: F.when(m["kind"] == 0, _slots(m["place"])).otherwise(none)
    found = texts.select("key", F.explode(F.transform("met", lambda m: F.struct(m["place"].alias("place"), m["hash"].alias("hash"), slots(m).alias("values")))).alias("w")).select("key", "w.*")
    shift = F.col("place") - F.col("at")
    sort = lambda width, part, of: F.struct(F.lit(width).alias("width"), F.lit(part).alias("part"), of.cast("int").alias("of"))
    drifting = [sort(w, k, F.floor((shift + k * (w // 2)) / w)) for w in DRIFTS for k in (0, 1)]
    found = found.join(pairs.join(sized(item_windows), "n"), ["key", "hash"]).withColumn("occurrence", F.explode(F.array(sort(0, 0, F.lit(0)), sort(1, 0, shift), *drifting)))
    found = found.groupBy("key", "n", "occurrence", "hash").agg(F.first("item").alias("item"), F.first("slots").alias("slots"), F.min_by("values", "place").alias("values"))
    found = scratch.written(found, "found")

    enough = found.groupBy("key", "n", "occurrence").agg(F.first("item").alias("item"), F.count("*").alias("matched_windows")).join(sized(sizes), "n")
    enough = enough.where(F.col("matched_windows") >= COVERAGE * F.col("item_windows"))
    bare = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    slots = found.select("key", "n", "occurrence", F.explode(F.arrays_zip("slots", "values")).alias("s")).select("key", "n", "occurrence", bare(F.col("s.slots")).alias("slot"), bare(F.col("s.values")).alias("value"))
    slots = slots.groupBy("key", "n", "occurrence", "slot").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    slots = slots.groupBy("key", "n", "occurrence").agg(
        F.count("*").alias("slot_values"), F.count_if(F.col("low") == F.col("high")).alias("consistent_values"),
        F.bool_or((F.col("low") != F.col("slot")) | (F.col("high") != F.col("slot"))).alias("reparameterised"),
    )
    judged = enough.join(slots, ["key", "n", "occurrence"], "left").select(
        "key", "n", "item", "matched_windows", "item_windows", F.coalesce("slot_values", F.lit(0)).alias("slot_values"),
        F.coalesce("consistent_values", F.lit(0)).alias("consistent_values"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    ).where(F.col("consistent_values") >= CONSISTENT * F.col("slot_values"))
    # Of a pair's occurrences, the one with the most windows counts, then the most consistent, then one as it is in the item.
    best = F.max(F.struct("matched_windows", "consistent_values", (~F.col("reparameterised")).alias("same"), "slot_values", "item_windows", "item", "reparameterised")).alias("best")
    judged = judged.groupBy("key", "n").agg(best).select("key", "best.*")
    return docs.select(F.col(id_col).alias(id_col), F.xxhash64(text).alias("key")).join(judged, "key").select(
        id_col, F.col("item").alias("item_id"), "matched_windows", "item_windows", "slot_values", "consistent_values", "reparameterised"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with their columns as they are."""
    (leaking,) = unused(docs, "leaking_key")
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    bad = leaks(docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")), benchmark, "id", "text", item_col, item_text_col)
    with Scratch(docs.sparkSession, "leaks-dropped") as scratch:
        bad = scratch.result(bad.select(F.col("id").alias(leaking)).distinct())
    return docs.join(sized(bad), key == F.col(leaking), "left_anti")


_SQL_MARK = _MARK.replace("'", "''")

#: The rows of leaks: token by token where leaks uses look-around, and every window of every text joined.
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT DISTINCT 'd' AS side, NULL::BIGINT AS item, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT DISTINCT 'b', item_id, coalesce(text, '') FROM benchmark),
tokens AS (
  SELECT *, string_split_regex(text, '[\t-\r ]+') AS o, string_split_regex(lower(text), '[\t-\r ]+') AS l FROM texts),
typed AS (
  SELECT *, list_transform(o, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<num>' WHEN regexp_matches(x, '^\p{{Lu}}') THEN '<name>' ELSE x END) AS y,
         list_filter(list_transform(l, lambda x: CASE WHEN length(x) = 1 THEN x ELSE regexp_replace(x, '^{_SQL_MARK}+|{_SQL_MARK}+$', '', 'g') END), lambda x: x <> '') AS p
  FROM tokens),
templates AS (
  SELECT side, item, text, o, p,
         list_transform(y, lambda x, i: CASE WHEN i > 1 AND y[i - 1] = '<num>' AND list_contains({UNITS}, x) THEN '<unit>' ELSE x END) AS t
  FROM typed),
windows AS (
  SELECT side, item, text, i AS place, t[i:i + {WINDOW - 1}] AS w, list_transform(list_filter(range(i, i + {WINDOW}), lambda k: starts_with(t[k], '<')), lambda k: o[k]) AS slots,
         len(list_filter(t[i:i + {WINDOW - 1}], lambda x: NOT starts_with(x, '<'))) * 2 >= {WINDOW} AS usable
  FROM (SELECT *, unnest(range(1, len(t) - {WINDOW} + 2)) AS i FROM templates)),
worded AS (
  SELECT item, text, least(len(p), {WINDOW}) AS size FROM templates t
  WHERE side = 'b' AND len(p) > 0 AND NOT EXISTS (SELECT 1 FROM windows v WHERE v.side = 'b' AND v.usable AND v.item IS NOT DISTINCT FROM t.item AND v.text = t.text)),
plains AS (
  SELECT side, item, text, i AS place, list_concat(['plain'], p[i:i + size - 1]) AS w, []::VARCHAR[] AS slots
  FROM (SELECT t.*, s.size, unnest(range(1, len(p) - s.size + 2)) AS i FROM templates t JOIN (SELECT DISTINCT size FROM worded) s ON t.side = 'd' OR s.size = least(len(p), {WINDOW}))),
item_windows AS (
  SELECT item, text AS item_text, w, arg_min(slots, place) AS slots, min(place) AS at
  FROM (SELECT item, text, w, slots, place FROM windows WHERE side = 'b' AND usable
        UNION ALL SELECT item, text, w, slots, place FROM plains SEMI JOIN worded USING (item, text) WHERE side = 'b') GROUP BY ALL),
sizes AS (SELECT item, item_text, count(*) AS item_windows FROM item_windows GROUP BY ALL),
found AS (
  SELECT d.text, item, item_text, w, b.slots, d.slots AS "values", d.place, d.place - b.at AS shift
  FROM (SELECT text, w, slots, place FROM windows WHERE side = 'd' UNION ALL SELECT text, w, slots, place FROM plains WHERE side = 'd') d JOIN item_windows b USING (w)),
dealt AS (
  SELECT * EXCLUDE (shift), unnest([(0, 0, 0), (1, 0, shift), {", ".join(f"({w}, {k}, CAST(floor((shift + {k * (w // 2)}) / {w}) AS BIGINT))" for w in DRIFTS for k in (0, 1))}]) AS occurrence FROM found),
each AS (SELECT text, item, item_text, occurrence, w, any_value(slots) AS slots, arg_min("values", place) AS "values" FROM dealt GROUP BY text, item, item_text, occurrence, w),
enough AS (
  SELECT text, item, item_text, occurrence, count(*) AS matched, any_value(item_windows) AS item_windows
  FROM each JOIN sizes USING (item, item_text) GROUP BY ALL HAVING count(*) >= {COVERAGE} * any_value(item_windows)),
bare AS (
  SELECT text, item, item_text, occurrence, regexp_replace(z[1], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS slot, regexp_replace(z[2], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS value
  FROM (SELECT text, item, item_text, occurrence, unnest(list_zip(slots, "values")) AS z FROM each)),
kept AS (SELECT text, item, item_text, occurrence, slot, min(value) AS low, max(value) AS high FROM bare GROUP BY ALL),
slotted AS (
  SELECT text, item, item_text, occurrence, count(*) AS slot_values, count(*) FILTER (low = high) AS consistent, bool_or(low <> slot OR high <> slot) AS changed
  FROM kept GROUP BY ALL),
judged AS (
  SELECT e.text, e.item, e.item_text, matched, item_windows, coalesce(slot_values, 0) AS slot_values, coalesce(consistent, 0) AS consistent, coalesce(changed, false) AS changed
  FROM enough e LEFT JOIN slotted s USING (text, item, item_text, occurrence)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY text, item, item_text ORDER BY matched DESC, consistent DESC, changed, slot_values DESC) AS k
  FROM judged WHERE consistent >= {CONSISTENT} * slot_values)
SELECT doc_id, item AS item_id, matched AS matched_windows, item_windows, slot_values, consistent AS consistent_values, changed AS reparameterised
FROM best JOIN documents ON best.text = coalesce(documents.text, '') WHERE k = 1"""
