"""Language-model scoring with a probabilistic suffix tree.

A text is a row of tokens: its words, lower-cased, then one end. A word is spelled in symbols by its bytes and a
space, the end by END. The tree's states are contexts, rows of up to DEPTH symbols of any length. A
context is a state if its next-symbol distribution, smoothed towards that of its longest suffix that is a state,
diverges from it by MIN_EVIDENCE nats over all its occurrences in the training texts. Longer contexts than DEPTH aren't tried;
nothing else bounds the states, so they grow with the corpus. Each symbol is scored in the state of the longest suffix before it.

A token's probability is mixed from its spelling by the tree (TREE_SHARE) and the add-one unigram estimate, so
that frequent words keep the weight that no short context can give them; the unigram estimate of a token that
training lacks is spelled by the tree as well, so a text of many unknown words scores below base_score, which spares it the spelling. Over all next tokens the mixture sums to 1 at most, so score is the
log10 of a probability of the text.

All of the corpus is counted. The tree is a table: a row for each different row of DEPTH + 1 symbols in
the texts, with the probability of the last one in the state of the longest suffix; levels of it are made from
shorter to longer contexts, by joins. Word counts are a table too. Neither is ever in one place: texts
are dealt to blocks of about BLOCK_BYTES by a hash of id and text, so a task that is run again finds the same texts; each block joins the
rows for its own words and symbols, and one that lacks any is an error.

Defined results: a null text is empty and has the one token end; repeated rows are scored each, those of equal id and text in
one block; a very long text is scored whole, in a block that holds at least all of it, with some 60 bytes of memory for each of its own;
with nothing to learn from, every count is 0 and every symbol equally likely; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch
from tidemill.llm.words import _LOWER, Words, bound_batches, group_sum, raw, releasing, releasing_table, slices, words

#: A context and its next symbol are packed in a long, a byte each.
DEPTH, SYMBOLS = 5, 256
MIN_EVIDENCE, PARENT_WEIGHT = 20.0, 8.0
TREE_SHARE = 0.7
END = 10  # a line feed never occurs inside or between words
#: Bytes of text in a block, about.
BLOCK_BYTES = 16_000_000
#: The word hash that stands for the token end.
END_TOKEN = np.uint64(0)
#: What a row that a block is given says: a word's count, the log10 probability of a row of symbols, or one of the totals.
WORD, GRAM, TOKENS, DISTINCT = range(4)


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Symbols of all texts as bytes, each text with DEPTH times END before it; where a text's own symbols begin; the place after each word's symbols; the words."""
    data, offsets = raw(texts)
    found = words(texts)
    n_texts, per_text = len(offsets) - 1, np.diff(found.before)
    owner = np.repeat(np.arange(n_texts), per_text)
    sizes = found.stops - found.starts + 1  # with the space
    ends = np.cumsum(sizes) + owner * (DEPTH + 1) + DEPTH
    total = int(sizes.sum())
    symbols = np.full(total + n_texts * (DEPTH + 1), END, dtype=np.uint8)
    at = np.arange(total) + np.repeat(found.starts - np.cumsum(sizes) + sizes, sizes)
    kept = _LOWER[np.append(data, np.uint8(32))[at]]
    kept[np.cumsum(sizes) - 1] = 32
    symbols[np.arange(total) + np.repeat(ends - np.cumsum(sizes), sizes)] = kept
    before = np.concatenate(([0], np.cumsum(sizes)))[found.before]
    begins = before[:-1] + np.arange(n_texts) * (DEPTH + 1) + DEPTH
    return symbols, begins, ends, found


def grams(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places have symbols to be predicted, all but those that stand before a text, and each symbol there with the DEPTH before it, packed."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[(begins[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    code = np.zeros(len(symbols), dtype=np.int64)
    for i in range(DEPTH, -1, -1):
        code <<= 8
        code[i:] |= symbols[: len(symbols) - i]
    return keep, code[keep]


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, ascending, and how often each comes, or its weights' sum."""
    order = None if weights is None else np.argsort(codes, kind="stable")
    codes = np.sort(codes) if order is None else codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    if order is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _kinds(symbols: np.ndarray, begins: np.ndarray, found: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """WORD and the hashes of all tokens, then GRAM and all rows of DEPTH + 1 symbols; each with how many are each text's."""
    own, before = token_hashes(found, len(begins))
    yield WORD, own.view(np.int64), np.diff(before)
    yield GRAM, grams(symbols, begins)[1], np.diff(np.append(begins, len(symbols) + DEPTH)) - DEPTH


def _counts(rows: DataFrame) -> DataFrame:
    """kind, key and n: each different token and row of DEPTH + 1 symbols in the texts, and how often training texts have it. rows: text, training."""

    @releasing
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], GRAM: []}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return _counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))

        def given(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            held[kind] = []
            for a in range(0, len(key), 500_000):
                part = key[a : a + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[a : a + 500_000])], ["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                training = part.column("training").to_numpy(zero_copy_only=False)
                symbols, begins, _, found = spelled(part.column("text"))
                for kind, key, each in _kinds(symbols, begins, found):
                    learned = np.repeat(training, each)
                    for some, times in ((learned, 1), (~learned, 0)):
                        own, n = _counted(key[some])
                        held[kind].append((own, n * times))
                    if sum(len(k) for k, _ in held[kind]) > 2_000_000:
                        key, n = merged(kind)
                        if len(key) > 1_000_000:
                            yield from given(kind, key, n)
                        else:
                            held[kind] = [(key, n)]
        for kind in held:
            if held[kind]:
                yield from given(kind, *merged(kind))

    return rows.mapInArrow(counted, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _low(code: Column, symbols: int) -> Column:
    """The last symbols of a code."""
    return code.bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def suffix_tree(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """code (DEPTH + 1 symbols) and log10 (of its last one's probability in the state of its longest suffix), from counts: code and n of each code in the texts."""
    levels = [scratch.written(counts, "grams")]
    for depth in range(DEPTH - 1, -1, -1):
        levels.append(scratch.written(levels[-1].groupBy(_low(F.col("code"), depth + 1).alias("code")).agg(F.sum("n").alias("n")), "grams"))
    total = levels[-1].agg(F.sum("n")).first()[0] or 0
    known = levels[-1].select("code", ((F.col("n") + 1) / F.lit(float(total + SYMBOLS))).alias("p"))
    for depth in range(1, DEPTH + 1):
        known = scratch.written(_next_level(levels[DEPTH - depth], known, depth), "states")
        scratch.drop(levels[DEPTH - depth])
    return known.select("code", F.log10("p").alias("log10"))


def _next_level(level: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """code and p for codes of depth + 1 symbols, from their counts and from known, the same for codes one shorter."""
    weight = F.lit(PARENT_WEIGHT)
    each = level.select("code", "n", _low(F.col("code"), depth).alias("shorter")).join(known.select(F.col("code").alias("shorter"), F.col("p").alias("q")), "shorter")
    # N * KL of the smoothed distribution against that of the longest suffix; what follows the context nowhere has weight / (N + weight) times the suffix's probability.
    share, seen = F.col("n") + weight * F.col("q"), F.col("n") > 0
    context = Window.partitionBy("context")  # 256 rows at most; dealt before the sums' terms are made, as these needn't travel
    each = each.select("code", "n", "q", F.shiftright("code", 8).alias("context")).repartition("context")
    each = each.select("code", "n", "q", F.sum("n").over(context).cast("double").alias("total"), F.sum(F.when(seen, share * F.log(share / F.col("q"))).otherwise(0.0)).over(context).alias("a"), F.sum(F.when(seen, share).otherwise(0.0)).over(context).alias("b"))
    whole = F.col("total") + weight
    divergence = (F.col("a") - F.col("b") * F.log(whole)) / whole + (1 - F.col("b") / whole) * F.log(weight / whole)
    return each.select("code", F.when(F.col("total") * divergence >= MIN_EVIDENCE, share / whole).otherwise(F.col("q")).alias("p"))


def token_hashes(found: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text's words, and the tokens before each text."""
    before = found.before + np.arange(n_texts + 1)
    out = np.full(int(before[-1]), END_TOKEN, dtype=np.uint64)
    out[np.arange(len(found.starts)) + np.repeat(np.arange(n_texts), np.diff(found.before))] = found.hashes() | np.uint64(1)
    return out, before


def _own(table: pa.Table) -> pa.Table:
    """The different tokens and rows of DEPTH + 1 symbols in a block."""
    held: dict[int, list[np.ndarray]] = {WORD: [], GRAM: []}
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            symbols, begins, _, found = spelled(part.column("text"))
            for kind, key, _ in _kinds(symbols, begins, found):
                held[kind].append(_counted(key)[0])
                if sum(map(len, held[kind][1:])) > 1_000_000:
                    held[kind] = [_counted(np.concatenate(held[kind]))[0]]
    keys = {kind: _counted(np.concatenate(held[kind]))[0] for kind in held}
    kinds = np.repeat(list(keys), [len(k) for k in keys.values()]).astype(np.int8)
    return pa.table({"block": pa.array(np.full(len(kinds), table.column("block")[0].as_py(), np.int32)), "kind": pa.array(kinds), "key": pa.array(np.concatenate(list(keys.values())))})


def _looked_up(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The value of each of keys in known, ascending keys and their values."""
    if not len(keys):
        return known[1][:0]
    place = np.minimum(np.searchsorted(known[0], keys), max(len(known[0]) - 1, 0))
    if not len(known[0]) or (known[0][place] != keys).any():
        raise ValueError("a block has texts that it was given no counts for: the input has changed while it was read")
    return known[1][place]


def _scored(table: pa.Table, given: pa.Table) -> pa.Table:
    """The scores of a block's texts; given: kind, key and value of what the block has been given."""
    if not table.num_rows:
        none = np.zeros(0)
        return pa.table({"id": table.column("id"), **{c: pa.array(none, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array(none) for c in ("base_score", "score", "tree_score")}})
    kind = given.column("kind").to_numpy()
    of = lambda k: tuple(given.column(c).filter(pa.array(kind == k)).to_numpy() for c in ("key", "value"))
    known = {}
    for k in (WORD, GRAM):
        keys, values = of(k)
        order = np.argsort(keys)
        known[k] = keys[order], values[order]
        del keys, values, order
    tokens, distinct = int(of(TOKENS)[1][0]), int(of(DISTINCT)[1][0])
    ln10 = math.log(10)
    out = []
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            n = part.num_rows
            symbols, begins, ends, found = spelled(part.column("text"))
            own, before = token_hashes(found, n)
            count = _looked_up(known[WORD], own.view(np.int64))
            keep, code = grams(symbols, begins)
            code, place = np.unique(code, return_inverse=True)
            sums = np.zeros(len(symbols) + 1)
            sums[1:][keep] = _looked_up(known[GRAM], code)[place]
            np.cumsum(sums, out=sums)
            stop = np.empty(len(own), dtype=np.int64)  # the place after each token's symbols
            final = before[1:] - 1
            is_word = np.ones(len(own), dtype=bool)
            is_word[final] = False
            stop[is_word] = ends
            stop[final] = np.append(begins[1:] - DEPTH, len(symbols))
            start = np.empty_like(stop)
            start[1:] = stop[:-1]
            start[before[:-1]] = begins
            by_tree = sums[stop] - sums[start]
            base = np.log10((count + 1) / (tokens + distinct + 1))
            unigram = np.where(count > 0, base, base + by_tree)
            mixed = np.logaddexp(by_tree * ln10 + math.log(TREE_SHARE), unigram * ln10 + math.log(1 - TREE_SHARE)) / ln10
            out.append(pa.table({
                "id": part.column("id"), "n_tokens": pa.array(np.diff(before)), "n_known": pa.array(group_sum((count > 0).astype(np.int64), before)),
                "train_tokens": pa.array(np.full(n, tokens, dtype=np.int64)), "base_score": pa.array(group_sum(base, before)), "score": pa.array(group_sum(mixed, before)), "tree_score": pa.array(group_sum(by_tree, before)),
            }))
    return pa.concat_tables(out)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, tree_score (the tree's alone) of every row; training says which rows are learned from."""
    bound_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "suffix-tree") as scratch:
        return scratch.result(_scores(docs, training, id_col, text_col, scratch))


def _scores(docs: DataFrame, training: Column, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = scratch.written(_counts(rows.select("text", "training")), "counts")
    of_words = counts.where(F.col("kind") == WORD)
    totals = scratch.written(of_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")), "totals")
    tree = suffix_tree(counts.where(F.col("kind") == GRAM).select(F.col("key").alias("code"), "n"), scratch)
    kind = lambda k: F.lit(k).cast("tinyint").alias("kind")
    # A probability's logarithm is rounded to 24 bits, which the shuffle compresses.
    values = of_words.select(kind(WORD), "key", F.col("n").cast("double").alias("value")).union(tree.select(kind(GRAM), "code", F.col("log10").cast("float").cast("double")))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    given = dealt.groupBy("block").applyInArrow(releasing_table(_own), "block int, kind tinyint, key long").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    of_all = F.explode(F.array(*[F.struct(kind(k), F.lit(0).cast("long").alias("key"), F.col(c).cast("double").alias("value")) for k, c in ((TOKENS, "tokens"), (DISTINCT, "distinct"))])).alias("v")
    each_block = docs.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    given = given.union(each_block.join(F.broadcast(totals.select(of_all))).select("block", "v.*"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, tree_score double"
    scored = dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(releasing_table(_scored), schema)
    return scored.withColumnRenamed("id", id_col)
