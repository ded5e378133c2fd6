"""Merkle fingerprints, resharding and language-model scoring."""

import functools
import hashlib
import heapq
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations, product, zip_longest
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import language_id, merkle, reshard, suffix_tree_lm
from tidemill.llm.storage import Scratch

ROWS = [(1, "One, two. Three\n\nfour"), (2, "One, two. Three\n\nfour"), (3, None), (4, ""), (7, "ünï, cödé. " * 50), (9, "x" * 9000), (None, "nobody. Nothing"), (5, "a b c")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text, cuts=("\n\n", "\n", ". ", ", ")):
    return sha("".join(tree(part, cuts[1:]) for part in text.split(cuts[0]))) if cuts else sha(text)


def cuts(text, separators=("\n\n", "\n", ". ", ", ")):
    return {x for part in text.split(separators[0]) for x in cuts(part, separators[1:])} if separators else {text} - {""}


def like(a, b):
    return 2 * len(cuts(a) & cuts(b)) / (len(cuts(a)) + len(cuts(b))) if cuts(a) | cuts(b) else 1.0


def first_edit(a, b):
    """The first section, and the first paragraph in it, that differ."""
    for section, (x, y) in enumerate(zip_longest(a.split("\n\n"), b.split("\n\n"))):
        if x != y:
            return section, next(k for k, (p, q) in enumerate(zip_longest(*((z.split("\n") if z is not None else []) for z in (x, y)))) if p != q)
    return None, None


def merkle_differs(found, rows):
    """Rows of edit_report, in order, that aren't what brute force gives for rows of id and text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()[:8], r[1]))
    expected = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((str(i), len(text), sha(edited), tree(text), tree(edited), round(like(text, edited), 9), round(like(text, after), 9), *first_edit(text, edited)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.edited_section, r.edited_paragraph) for r in found]
    return (Counter(got) - Counter(expected)) + (Counter(expected) - Counter(got))


def test_merkle_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "n") for r in ROWS], "doc_id long, text string, next_text string")
    assert not merkle_differs(merkle.edit_report(docs).collect(), ROWS)
    assert merkle.edit_report(docs.limit(0)).count() == 0 and merkle.edit_report(docs.limit(1)).count() == 1


def test_merkle_of_repeated_and_null_ids(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", ". ", ", ", "\n", "\n\n", " "]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(rng.choice([7, 7, None, 1 << 62, (1 << 62) + 1, i]), t) for i, t in enumerate(texts)] + [(7, texts[0])] * 5 + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not merkle_differs(merkle.edit_report(docs).collect(), rows)
    keys = spark.createDataFrame([(key, part / 10) for key in (6, 7, 8, 20, 21) for part in range(10)], "key long, part double")
    dealt = [r.b for r in keys.select("key", "part", merkle._range(F.col("key"), F.col("part"), [7.0] * 4 + [8.0, 20.0, 20.0]).alias("b")).orderBy("key", "part").collect()]
    assert dealt == sorted(dealt) and [len(set(dealt[a : a + 10])) for a in range(0, 50, 10)] == [1, 4, 1, 2, 1]  # one id's rows are spread


def test_merkle_of_a_long_text_of_many_paragraphs(spark):
    long = "\n\n".join("\n".join(f"Paragraph {s} {p}, with a clause. And another sentence, of two clauses" for p in range(5)) for s in range(4000))
    rows = [(1, long), (2, "short. text"), (3, long[:-1])]
    assert len(long) > 1_000_000
    assert not merkle_differs(merkle.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_merkle_likeness_of_texts_without_a_clause_in_common(spark):
    docs = spark.createDataFrame([(1, "apple\n\nbread"), (2, "chair\n\ndoor\n"), (3, "\n")], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in merkle.edit_report(docs).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def fewest_bytes(rows, shards):
    """The fewest bytes that must move so that the shards' row counts differ by one at most, rows being old shard and size.

    A shard that keeps k of its rows keeps its k largest; so for each set of shards that get a row more, all keep as many as they may.
    """
    least, more = divmod(len(rows), shards)
    own = [sorted((size for old, size in rows if old == shard), reverse=True) for shard in range(shards)]
    best = max(sum(sum(own[shard][: least + (shard in extra)]) for shard in range(shards)) for extra in combinations(range(shards), more))
    return sum(size for _, size in rows) - best


def check_resharded(found, rows, shards):
    """found has a row for each of rows (id, text, old shard), sound shards and slots, and moves the fewest bytes."""
    own = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.old_shard) for r in found) == Counter((i, *own(t), old or 0) for i, t, old in rows)
    counts = Counter(r.shard for r in found)
    assert set(counts) <= set(range(shards)) and max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(counts[shard]))
    moved = sum(r.size for r in found if r.shard != r.old_shard)
    fewest = fewest_bytes([(old or 0, own(t)[0]) for _, t, old in rows], shards)
    assert moved == fewest, (fewest, moved)


@pytest.mark.parametrize("skew", [False, True])
def test_reshard_moves_the_fewest_bytes(spark, skew, monkeypatch):
    monkeypatch.setattr(reshard, "CHUNK_ROWS", 10)  # many chunks in each block and shard
    rng = random.Random(7)
    rows = [(i, "wé" * int(rng.expovariate(1 / 40)), 0 if skew else min(3, int(rng.expovariate(1)))) for i in range(403)] + [(900, None, None)] * 30 + [(901, "long " * 50_000, 2)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, old int, size int, shard int, chunk int, row int")
    check_resharded(reshard.reshard(docs, F.col("old"), shards=4).collect(), rows, 4)
    assert reshard.reshard(docs.limit(0), F.col("old")).count() == 0


def test_reshard_of_old_shards_that_are_no_more(spark):
    rows = [(i, "w" * (i % 9), i % 6) for i in range(50)]
    found = reshard.reshard(spark.createDataFrame(rows, "doc_id long, text string, old int"), F.col("old"), shards=3).collect()
    check_resharded(found, rows, 3)


@pytest.mark.parametrize("columns", ["plain", "clashing"])
def test_affected_shards_are_rewritten(spark, tmp_path, monkeypatch, columns):
    monkeypatch.setattr(reshard, "CHUNK_ROWS", 3)
    monkeypatch.setattr(reshard, "FILE_BYTES", 60)
    rows = [(i, "w" * i, 0) for i in range(20)] + [(None, None, 0)] * 15 + [(7, "same", 1)] * 11 + [(7, "other", 0), (None, "x", None)]
    more = ["extra int"] if columns == "plain" else ["row int", "number int", "pieces int", "of_id int"]
    docs = spark.createDataFrame([(*r, *[k] * len(more)) for k, r in enumerate(rows)], "doc_id long, text string, old int, " + ", ".join(more)).repartition(5)
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    places = reshard.reshard(docs, F.col("old"), shards=4)
    reshard.rewrite_affected(docs, places, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    strip = lambda r: tuple(r[c] for c in docs.columns)
    assert Counter(map(strip, back.collect())) == Counter(map(strip, docs.collect()))
    key = lambda r: (r.doc_id, zlib.crc32((r.text or "").encode()), r.shard)
    assert Counter(map(key, back.collect())) == Counter((r.doc_id, r.text_crc32, r.shard) for r in places.collect())


def test_unaffected_shards_are_left_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * i, (0, 0, 0, 1, 2, 2)[i % 6]) for i in range(30)], "doc_id long, text string, old int")
    places = reshard.reshard(docs, F.col("old"), shards=3)
    assert {r.shard for r in places.where("shard = 2").where("old_shard <> 2").collect()} == set()
    reshard.rewrite_affected(docs, places, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1"]


def min_cost_flow(nodes, arcs, source, sink):
    """Successive shortest paths with node potentials: the flow on each arc (from, to, capacity, cost at least 0)."""
    graph, to, left, cost = [[] for _ in range(nodes)], [], [], []
    for a, b, capacity, price in arcs:
        for start, end, room, c in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[start].append(len(to))
            to.append(end), left.append(room), cost.append(c)
    potential = [0.0] * nodes
    while True:
        distance, by = [math.inf] * nodes, [-1] * nodes
        distance[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k in graph[a]:
                reach = d + max(0.0, cost[k] + potential[a] - potential[to[k]])
                if left[k] and reach < distance[to[k]] - 1e-9:
                    distance[to[k]], by[to[k]] = reach, k
                    heapq.heappush(heap, (reach, to[k]))
        if distance[sink] == math.inf:
            return [left[2 * i + 1] for i in range(len(arcs))]
        potential = [p + d if d < math.inf else p for p, d in zip(potential, distance, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = to[by[at] ^ 1]
        amount = min(left[k] for k in path)
        for k in path:
            left[k] -= amount
            left[k ^ 1] += amount


def cost_by_shortest_paths(blocks, shards):
    least, more = divmod(sum(b[2] for b in blocks), shards)
    dear, arcs, hub, first = 2.0 * max(1.0, *(b[3] for b in blocks)), [], 2, 3
    for i, (old, _, rows, mean) in enumerate(blocks):
        arcs += [(0, first + shards + i, rows, 0.0), (first + shards + i, hub, rows, mean)] + ([(first + shards + i, first + old, rows, 0.0)] if old < shards else [])
    for shard in range(shards):
        arcs += [(hub, first + shard, 10**9, 0.0), (first + shard, 1, least, 0.0)] + ([(first + shard, 1, 1, dear)] if more else [])
    flow = min_cost_flow(first + shards + len(blocks), arcs, 0, 1)
    return sum(f * c for f, (_, b, _, c) in zip(flow, arcs, strict=True) if b == hub)


def test_flow_costs_as_little_as_by_shortest_paths():
    assert min_cost_flow(4, [(0, 1, 2, 0.0), (0, 2, 2, 0.0), (1, 3, 1, 1.0), (1, 2, 2, 1.0), (2, 3, 3, 1.0)], 0, 3) == [2, 2, 1, 1, 3]
    rng = random.Random(3)
    for _ in range(150):
        shards, olds = rng.randrange(1, 7), rng.randrange(1, 9)
        blocks = [(old, k, rng.randrange(1, 30), rng.choice((1.0, 2.5, 7.0, rng.uniform(1, 100)))) for old in range(olds) for k in range(rng.randrange(0, 5))]
        if not blocks:
            continue
        leaving, moves = reshard.solve(blocks, shards)
        mean = {(old, k): m for old, k, _, m in blocks}
        assert math.isclose(sum(n * mean[b] for b, n in leaving.items()), cost_by_shortest_paths(blocks, shards), rel_tol=1e-9, abs_tol=1e-6)
        after = Counter()
        for old, _, rows, _ in blocks:
            after[old] += rows
        for old, parts in moves.items():
            assert sum(n for _, n in parts) == sum(n for (o, _), n in leaving.items() if o == old)
            for shard, n in parts:
                after[old] -= n
                after[shard] += n
        counts = [after[s] for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == sum(b[2] for b in blocks)


def test_flow_of_a_thousand_shards_is_soon_found():
    rng = random.Random(5)
    blocks = [(old, k, rng.randrange(1, 10_000), 2.0**k + rng.random()) for old in range(1000) for k in range(30)]
    began = time.time()
    leaving, _ = reshard.solve(blocks, 1000)
    assert leaving and time.time() - began < 30


def test_language_model_counts_and_scores(spark):
    texts = ["The cat sat on the mat and the cat sat again " * 3, "the cat sat on the mat", None, "", "zq xv jj kw", "Ünï cödé", " \t "] * 6 + ["the cat " * 4000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, block string")
    held = language_id.held_out("doc_id", 7, 2)
    found = {r.doc_id: r for r in suffix_tree_lm.score(docs, ~held).collect()}
    low = lambda t: [*re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    count = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in low(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(low(t)), sum(count[w] > 0 for w in low(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in low(t)), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert found[1].tree_score / found[1].n_tokens > found[4].tree_score / found[4].n_tokens
    assert suffix_tree_lm.score(docs.limit(0), ~held).count() == 0


def brute_force_tree(texts):
    """log10 of the probability of a symbol after a history, by dicts, from texts spelled as rows of symbols."""
    depth, follows = suffix_tree_lm.DEPTH, [Counter() for _ in range(suffix_tree_lm.DEPTH + 1)]
    for symbols in texts:
        for at in range(depth, len(symbols)):
            for d in range(depth + 1):
                follows[d][symbols[at - d : at], symbols[at]] += 1
    total = [Counter() for _ in range(depth + 1)]
    for d in range(depth + 1):
        for (context, _), n in follows[d].items():
            total[d][context] += n

    @functools.cache
    def given(context):
        """The distribution in the state of the longest suffix of context."""
        if not context:
            n = total[0][b""]
            return [(follows[0][b"", s] + 1) / (n + 256) for s in range(256)]
        shorter, n = given(context[1:]), total[len(context)][context]
        own = [(follows[len(context)][context, s] + 8 * q) / (n + 8) for s, q in enumerate(shorter)]
        evidence = n * sum(p * math.log(p / q) for p, q in zip(own, shorter, strict=True))
        return own if evidence >= suffix_tree_lm.MIN_EVIDENCE else shorter

    return lambda history, symbol: math.log10(given(history[-depth:])[symbol])


def spelled(text):
    """END five times, each word with a space, END."""
    return b"\n" * 5 + b"".join(w.encode() + b" " for w in re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + b"\n"


@pytest.mark.parametrize("block_bytes", [16_000_000, 700])
def test_language_model_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_BYTES", block_bytes)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary[: 10 + i % 30]) for _ in range(rng.randrange(60))) for i in range(60)] + [None, "", "zz unknown ÿ", None, ""]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(3, texts[3], 2.0), (None, texts[4], 2.0)], "doc_id long, text string, score double")
    found = suffix_tree_lm.score(docs, F.col("doc_id") < 40).collect()
    assert len(found) == len(texts) + 2
    learned = texts[:40] + [texts[3]]
    tree = brute_force_tree([spelled(t) for t in learned])
    count = Counter(w for t in learned for w in [*spelled(t)[5:-1].split(b" ")[:-1], b""])
    n, v = sum(count.values()), len(count)
    for r in found:
        symbols, at = spelled(texts[r.doc_id] if r.doc_id is not None else texts[4]), 5
        score = tree_score = 0.0
        for token in [*symbols[5:-1].split(b" ")[:-1], b""]:
            stop = at + len(token) + 1
            by_tree = sum(tree(symbols[:k], symbols[k]) for k in range(at, stop))
            base = math.log10((count[token] + 1) / (n + v + 1)) + (0 if count[token] else by_tree)
            tree_score += by_tree
            score += math.log10(0.7 * 10**by_tree + 0.3 * 10**base)
            at = stop
        assert math.isclose(r.tree_score, tree_score, rel_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-6) and r.train_tokens == n


def test_keys_that_a_block_lacks_are_an_error():
    known = np.array([2, 5, 9]), np.array([0.1, 0.2, 0.3])
    assert suffix_tree_lm._looked_up(known, np.array([9, 2, 2])).tolist() == [0.3, 0.1, 0.1]
    for keys in ([3], [10], [1]):
        with pytest.raises(ValueError):
            suffix_tree_lm._looked_up(known, np.array(keys))


def test_probabilities_of_texts_sum_to_one_at_most(spark):
    letters = "ab"
    learn = [" ".join("".join(random.Random(i + k).choice(letters) for _ in range(2)) for k in range(i % 3)) for i in range(80)]
    one = ["".join(x) for n in (1, 2, 3) for x in product(letters, repeat=n)]
    every = ["", *one, *(f"{a} {b}" for a in one for b in one)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(learn)] + [(1000 + i, t) for i, t in enumerate(every)], "doc_id long, text string")
    found = [r for r in suffix_tree_lm.score(docs, F.col("doc_id") < 1000).collect() if r.doc_id >= 1000]
    assert 0.5 < sum(10**r.score for r in found) <= 1 and sum(10**r.tree_score for r in found) <= 1


def test_language_model_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_tree_lm.score(docs, F.lit(False)).collect()}
    assert found[1].train_tokens == found[1].n_known == 0 and math.isclose(found[1].tree_score, 5 * math.log10(1 / 256), rel_tol=1e-6) and math.isclose(found[2].tree_score, math.log10(1 / 256), rel_tol=1e-6)


def test_language_model_grows_with_the_corpus(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(4)) for _ in range(400)]
    states = []
    for n in (20, 400):
        docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(60)), True) for i in range(n)], "doc_id long, text string, training boolean")
        with Scratch(spark, "test") as scratch:
            counts = suffix_tree_lm._counts(docs.select("text", "training")).where(F.col("kind") == suffix_tree_lm.GRAM)
            tree = suffix_tree_lm.suffix_tree(counts.select(F.col("key").alias("code"), "n"), scratch)
            states.append(tree.groupBy(F.shiftright("code", 8)).agg(F.count("*")).count())
    assert states[1] > states[0]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0.5 * sizes[0], sizes
    print(sizes)
    encoded = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert encoded.count() == sizes[-1]
