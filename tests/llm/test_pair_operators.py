"""The n-gram join, substring dedup, decontamination and components, against brute force."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ngram_join, substring_dedup, template_decontam, words
from tidemill.llm.components import components
from tidemill.llm.storage import Scratch

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from brute import grams, low  # noqa: E402


def prose(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.randrange(3, 200))) for _ in range(60)]
    for i in range(40):  # near copies with a few edits, some beyond the threshold
        w = texts[rng.randrange(30)].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(i)
        texts.append(" ".join(w))
    passages = [" ".join(prose(rng, n)) for n in (50, 51, 70, 140)]
    for i in range(24):
        texts.append(" ".join(prose(rng, rng.randrange(0, 90))) + ("\n" if i % 3 else " ") + passages[i % 4] + " " + " ".join(prose(rng, rng.randrange(0, 90))))
    texts += [texts[0], texts[0].upper(), "same short", "same  short", None, "", None, "of " * 300, "of " * 300 + "end", " ".join(prose(rng, 3000))]
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_join_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, key string")
    links, group = brute.groups([t for _, t, _ in corpus])
    found = {r.doc_id: r for r in ngram_join.join_groups(docs).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in found.items() if (r.class_id, r.n_links) != (group[i], len(links[i]))} == {}
    assert found.keys() == set(range(len(corpus)))
    kept = ngram_join.first_of_each_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in enumerate(group) if g == i}


def test_join_of_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z y")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in ngram_join.join_groups(docs).collect()) == [("1", 1, 2), ("1", 1, 2), ("2", 2, 0), ("None", 1, 2)]
    assert ngram_join.join_groups(docs.limit(0)).count() == 0


def test_first_of_each_group_removes_rows_not_ids(spark):
    rows = [(1, "a b c d e f", 1), (None, "a b c d e f", 2), (None, "unlike all others", 3), (None, None, 4), (5, "g h i j k l", 5), (6, "g h i j k l", 6), (6, "a clean namesake", 7), (None, "m n o p q", 8), (None, "m n  o p q", 9), (None, "m n o p q", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = ngram_join.first_of_each_group(docs)
    assert kept.columns == docs.columns
    found = sorted(r.row for r in kept.collect())
    assert found[:5] == [1, 3, 4, 5, 7] and len(found) == 6 and found[5] in (8, 9, 10)


def edited(rng, base, edits):
    w = list(base)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"edit{rng.random()}"
    return " ".join(w)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    rng = random.Random(3)
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.randrange(4)) for _ in range(90)] + [edited(rng, prose(rng, 40_000), 0)] * 2 + [" ".join(prose(rng, 60)) for _ in range(20)]
    texts[91] += " and an end"
    links, group = brute.groups(texts)
    found = {r.doc_id: r for r in ngram_join.join_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all((found[i].n_links, found[i].class_id) == (len(links[i]), group[i]) for i in range(len(texts)))


def boilerplate(rng, n, pairs):
    """Lines of 60 words that have 40 in common (Jaccard 0.47), then pairs of such with one word changed (0.836)."""
    shared = prose(rng, 40)
    lines = [shared + [f"own{i}x{k}" for k in range(20)] for i in range(n + pairs)]
    for w in lines[n:][:pairs]:
        lines.append(w[:45] + [f"other{rng.random()}"] + w[46:])
    return [" ".join(w) for w in lines]


def test_pairs_that_share_no_band_are_not_compared():
    texts = boilerplate(random.Random(8), 500, 50)
    bands, rows = ngram_join.banding()
    hashes, before = words.word_hashes(pa.array(texts))
    found = ngram_join.minhash_bands(*words.shingles(hashes, before, 5), bands, rows)
    share = {(a, b) for a in range(len(texts)) for b in np.flatnonzero((found[a] == found).any(axis=1)).tolist() if a < b}
    compared = Counter()
    for band in range(bands):
        for value in np.unique(found[:, band]):
            inside = np.flatnonzero(found[:, band] == value)
            a, b = np.nonzero(ngram_join._wanted(found[inside], band, slice(0, len(inside)), slice(0, len(inside))))
            compared.update(zip(inside[a].tolist(), inside[b].tolist(), strict=True))
    assert set(compared) == share and set(compared.values()) == {1} and len(share) < 0.9 * len(texts) ** 2 / 2
    assert sum((500 + i, 550 + i) in share for i in range(50)) == 50


def test_clashing_names_are_carried(spark, corpus):
    clashing = ["gone_id", "gone_raw", "own_raw", "cut_id", "cut_text", "cut_passages", "leaking_key", "key", "id", "raw", "t", "rows", "is_lead"]
    docs = spark.createDataFrame([(i, t, *range(len(clashing))) for i, t, _ in corpus[80:110]], ", ".join(["doc_id long", "text string", *(f"{c} int" for c in clashing)]))
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for kept in (ngram_join.first_of_each_group(docs), substring_dedup.without_repeats(docs), template_decontam.without_leaks(docs, benchmark)):
        assert kept.columns == docs.columns
        assert {tuple(r)[2:] for r in kept.collect()} == {tuple(range(len(clashing)))}


def test_banding_meets_recall_with_the_fewest_false_candidates():
    bands, rows = ngram_join.banding(0.8, 0.999, 128)
    met = lambda s, r, b: 1 - (1 - s**r) ** b
    assert met(0.8, rows, bands) >= 0.999 > met(0.8, rows, bands - 1) and bands * rows <= 128
    false = lambda r, b: sum(met(s / 1000, r, b) for s in range(800))
    assert all(false(r, b) >= false(rows, bands) for r in range(1, 9) for b in range(1, 128 // r + 1) if met(0.8, r, b) >= 0.999)


def test_no_repeated_passage_stays_and_each_removed_one_has_its_like_before(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, cut string")
    words = {i: low(t) for i, t, _ in corpus}
    found = substring_dedup.repeats(docs).collect()
    assert found
    for r in found:
        part, kept = words[r.doc_id][r.first_word : r.first_word + r.n_words], words[r.kept_id]
        assert r.kept_id < r.doc_id and len(part) == r.n_words >= substring_dedup.MIN_WORDS
        exact = any(kept[i : i + r.n_words] == part for i in range(len(kept) - r.n_words + 1))
        inside = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
        assert exact or len(inside & grams(" ".join(kept))) >= 0.8 * len(inside)
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    left = {r.doc_id: r.text for r in left.collect()}
    where = defaultdict(set)
    for i, t in left.items():
        w = low(t)
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    assert all(len(x) == 1 for x in where.values())
    touched = {r.doc_id for r in found}
    assert all(left[i] == t for i, t, _ in corpus if i not in touched and (t or "").strip())


def test_lines_are_compared_with_all_of_their_bucket(spark):
    rng = random.Random(13)
    base = prose(rng, 100)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):  # each is like the base, hardly any like another
        w = list(base)
        for at in rng.sample(range(10, 90), 2):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = {i: grams(t) for i, t in rows}
    like = {i for i in sets if i and len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0])}
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = {r.doc_id for r in found.collect() if r.n_words == 100 and r.kept_id == 0}
    assert len(like) > 100 and len(whole & like) >= 0.95 * len(like)


def test_a_passage_of_which_earlier_documents_hold_only_pieces_is_cut(spark):
    rng = random.Random(11)
    rows, whole = [], {}
    for k in range(40):
        passage = prose(rng, rng.randrange(50, 61))
        for j, part in enumerate((passage[:45], passage[-45:], passage, passage, passage)):
            rows.append((5 * k + j, " ".join(prose(rng, 60) + part + prose(rng, 60))))
        whole[5 * k + 3] = whole[5 * k + 4] = (len(passage), 5 * k + 2)
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.kept_id) for r in found if r.first_word == 60} == whole and len(found) == len(whole)


def test_two_short_runs_with_other_words_between_them_are_no_passage(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):
        left, right = prose(rng, 36), prose(rng, 36)
        for j in range(2):
            rows.append((2 * k + j, " ".join(prose(rng, 60) + left + [f"own{k}x{j}"] + right + prose(rng, 60))))
    assert substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_repeats_in_periodic_texts_are_all_cut(spark):
    rng = random.Random(29)
    rows = []

    def text(words):  # in lines of under 50 words, so that no line is compared as a whole
        return "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))

    for pair in range(160):
        period = 1 + pair % 23
        beat = [f"beat{pair}x{i}" for i in range(period)]
        passage = (beat * 80)[: rng.randrange(50, 75)]
        if pair % 3 == 0:  # the passage runs on beyond the periodic words
            passage = passage[: rng.randrange(20, 45)] + prose(rng, 40)
        if pair % 3 == 1:
            passage = prose(rng, 40) + passage[: rng.randrange(20, 45)]
        for side in range(2):
            before = prose(rng, rng.randrange(0, 30)) + (beat * 9)[rng.randrange(period) :][: rng.randrange(0, 60)] + [f"own{pair}x{side}"]
            after = [f"end{pair}x{side}"] + (beat * 9)[rng.randrange(period) :][: rng.randrange(0, 60)] + prose(rng, rng.randrange(0, 30))
            rows.append((2 * pair + side, before + passage + after))
    expected = brute.without_windows([(i, " ".join(w)) for i, w in rows])
    docs = spark.createDataFrame([(i, text(w)) for i, w in rows], "doc_id long, text string")
    left = {r.doc_id: r.text.split() for r in substring_dedup.without_repeats(docs).collect()}
    assert [left.get(i, []) for i, _ in rows] == expected and sum(len(w) > len(e) for (_, w), e in zip(rows, expected, strict=True)) >= 150
    found = substring_dedup.repeats(docs).collect()
    assert all(r.likeness == 1 and r.cluster is not None for r in found)


def test_pairs_that_sizes_keep_apart_are_not_compared():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in (5, 40, 50, 51, 400, 480, 3000)] * 3
    sizes, whole = np.array([len(s) for s in sets]), slice(0, len(sets))
    wanted = np.triu(ngram_join._of_like_size(sizes, 0.8, whole, whole), 1)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    can = {(i, j) for i, j in pairs if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])}
    like_ones = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(wanted), strict=True)} == can and like_ones <= can and len(can) < 0.5 * len(pairs)


@pytest.mark.parametrize("n", [0, 3, 20_000])
def test_filter_follows_the_number_of_buckets(spark, n):
    rng = np.random.default_rng(n)
    hashes, others = rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, 20_000)
    filtered = substring_dedup._filter(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    assert 8 * len(filtered) <= max(64 * n, 1 << 13)

    def passes(x):
        bit = x.view(np.uint64) & np.uint64(8 * len(filtered) - 1)
        return (filtered[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1

    assert passes(hashes).all() and passes(others).mean() < 0.05


def test_a_chain_of_lines_tells_its_likeness(spark):
    rng = random.Random(31)
    lines = [prose(rng, 80)]
    for k in range(6):  # each is like the one before it
        w = list(lines[-1])
        for at in range(k * 12, k * 12 + 4):
            w[at] = f"new{k}x{at}"
        lines.append(w)
    texts = [" ".join(w) for w in lines]
    found = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.n_words == 80}
    sets = [grams(t) for t in texts]
    likeness = [len(a & sets[0]) / len(a | sets[0]) for a in sets]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets, sets[1:], strict=False)) and likeness[6] < 0.5
    assert set(found) == set(range(1, 7)) and all(r.kept_id == 0 and abs(r.likeness - likeness[i]) < 1e-9 for i, r in found.items())


@pytest.mark.parametrize("others", [200, 2000])
def test_pairs_of_lines_in_crowded_buckets_are_found(spark, others):
    texts = boilerplate(random.Random(others), others, 200)
    found = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    caught = {(r.doc_id, r.kept_id) for r in found if r.n_words == 60}
    pairs = {(others + 200 + i, others + i) for i in range(200)}
    assert caught <= pairs and len(caught) >= (substring_dedup.RECALL - 0.02) * len(pairs), len(caught)


def test_substring_dedup_of_null_ids_and_repeated_rows(spark):
    rng = random.Random(21)
    passage, own = " ".join(prose(rng, 60)), [" ".join(prose(rng, 20)) for _ in range(5)]
    rows = [(1, f"{own[0]} {passage}"), (1, f"{own[0]} {passage}"), (None, f"{own[1]} {passage}"), (None, f"{own[2]} clean"), (7, f"{passage} {own[3]}"), (None, None), (7, f"{own[4]} namesake"), (8, "x " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert left == Counter([(1, own[0] + " "), (1, own[0] + " "), rows[2], rows[3], (7, own[3]), rows[5], rows[6], rows[7]])


def test_substring_dedup_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "doc_id long, text string")
    assert substring_dedup.repeats(docs).count() == 0 and substring_dedup.repeats(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in substring_dedup.without_repeats(docs).collect()) == [1, 2, 3]


ITEM = "A train leaves Paris at 9 with 40 passengers and 12 kg of mail , how many stops does it make before Rome"


def test_decontamination_finds_reparameterised_questions(spark):
    other = ITEM.replace("Paris", "Oslo").replace("40", "77").replace("12", "31").replace("Rome", "Bergen")
    texts = [ITEM, "before it " + other + " after it", "a train of thought leaves nobody with anything to say about mail or stops in general today", None, "", ITEM[:40], "x " * 5000 + ITEM]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, ITEM, 1)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    found = template_decontam.leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 7), (0, 7), (1, 7), (6, 7)]
    assert {r.doc_id: r.reparameterised for r in found}[1] and not {r.doc_id: r.reparameterised for r in found}[0]
    left = template_decontam.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert template_decontam.leaks(docs, benchmark.limit(0)).count() == 0 and template_decontam.leaks(docs.limit(0), benchmark).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "give Anna 3 of the pears and give Anna 4 of the plums and then tell Anna that she owes Anna 3 pears"
    mixed = item
    for name in ("Bob", "Cyd", "Dan", "Eve"):
        mixed = mixed.replace("Anna", name, 1)
    docs = spark.createDataFrame([(0, item), (1, mixed.replace("3", "5", 1)), (2, item.replace("Anna", "Zoe"))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in template_decontam.leaks(docs, benchmark).collect()) == [0, 2]


def test_leaks_are_met_at_every_word_offset(spark):
    item = "which of the nine pears did they eat Anna Bob Cyd Dan Eve Fay Gus Hal Ida Joe Kim"
    docs = spark.createDataFrame([(i, "x " * i + item) for i in range(8)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "Anna Bob Cyd Dan Eve Fay Gus which of the nine Hal Ida Joe Kim Lea Max Ned")], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(10 + i, "x " * i + "Anna Bob Cyd Dan which of the nine Hal Ida") for i in range(8)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in template_decontam.leaks(docs, benchmark).collect()) == [10 + i for i in range(8)]


def test_items_without_a_usable_window_are_found_by_their_words(spark):
    items = ["Who wrote Faust?", "Name The River That Flows Through Rome And Into The Sea", "2 + 3 * 4 - 5 + 6 * 7 = ?", None, ""]
    texts = ["they asked: who wrote Faust? nobody knew", "so name the river that flows through Rome and into the sea", "is 2 + 3 * 4 - 5 + 6 * 7 = ? hard", "who wrote of Faust", "2 - 3 * 4 + 5 - 6 * 7 = ?", "Name The Sea That Lies Beside Oslo And Behind The Hill", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in template_decontam.leaks(docs, benchmark).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_a_leak_after_a_part_of_a_like_question_is_found(spark):
    other = ITEM
    for a, b in (("Paris", "Oslo"), ("at 9", "at 5"), ("40", "77"), ("12", "31"), ("Rome", "Bergen")):
        other = other.replace(a, b)
    part = " ".join(other.split()[:16])
    longer = ITEM.replace("Rome", "Rome San Pietro")
    docs = spark.createDataFrame([(0, part + " and so on . " + ITEM), (1, part + " and so on . " + longer), (2, part)], "doc_id long, text string")
    found = {r.doc_id: r for r in template_decontam.leaks(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    assert {0, 1} <= found.keys() and not found[0].reparameterised and found[0].consistent_values == found[0].slot_values


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(17)
    plain, slots = ["how", "many", "of", "the", "pears", "did", "they", "eat"], ["Anna", "Bob", "7", "12kg", "3", "km", "Rome,"]
    sentence = lambda n: [rng.choice(plain if rng.random() < 0.7 else slots) for _ in range(n)]
    items = [" ".join(sentence(rng.randrange(9, 24))) for _ in range(12)]
    items = [i for i in items if any(sum(not t.startswith("<") for t in brute.template(i).split()[k : k + 8]) >= 4 for k in range(len(i.split()) - 7))]
    texts = [None, "", " \n"]
    for _ in range(150):
        w = sentence(rng.randrange(0, 12))
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(items).split()
            part = [rng.choice(slots[:2]) if x in slots[:2] and rng.random() < 0.4 else x for x in part]
            w += part[rng.randrange(0, 5) : rng.randrange(6, 30)] + sentence(rng.randrange(0, 4))
        texts.append("  ".join(w) if rng.random() < 0.2 else " ".join(w))
    texts.append("pears " * 20_000 + items[0])
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[9], "k"), (4, texts[9], "k")], "doc_id long, text string, key string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    names = ("matched_windows", "item_windows", "slot_values", "consistent_values", "reparameterised")
    found = Counter((str(r.doc_id), r.item_id, *(r[c] for c in names)) for r in template_decontam.leaks(docs, benchmark).collect())
    judged = [(d, i, brute.leak(t or "", item)) for d, t in [*enumerate(texts), (None, texts[9]), (4, texts[9])] for i, item in enumerate(items)]
    expected = Counter((str(d), i, *x) for d, i, x in judged if x)
    assert len(expected) > 50 and found == expected, (found - expected, expected - found)


def test_a_window_that_a_thousand_items_share_is_counted_before_anything_is_made_of_it(spark, monkeypatch):
    rng = random.Random(47)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = "which of the following is the best answer to"
    items = [(i, shared + " " + plain(12)) for i in range(1000)]
    texts = [f"{plain(5)} {shared} {plain(5)}" for _ in range(30)] + ["so " + items[77][1] + " or not"]
    made = {}
    written = Scratch.written

    def recorded(self, df, name):
        out = written(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "written", recorded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = template_decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(30, 77)]
    assert made["pairs"] == 1 and made["found"] < 200 < 30 * 1000


def test_an_item_more_changes_no_other_items_leaks(spark):
    docs = spark.createDataFrame([(i, "so " * i + ITEM + " nine red pears") for i in range(4)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    more = benchmark.union(spark.createDataFrame([(2, "nine red pears")], "item_id long, text string"))
    alone = sorted(tuple(r) for r in template_decontam.leaks(docs, benchmark).collect())
    both = sorted(tuple(r) for r in template_decontam.leaks(docs, more).collect())
    assert alone and [r for r in both if r[1] == 1] == alone and len(both) == 8


@pytest.mark.parametrize("in_one_task", [1 << 19, 0])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr("tidemill.llm.components.TASK_EDGES", in_one_task)
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100 + i) for i in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(5, None)]
    group = {x: x for p in pairs if None not in p for x in p}
    for _ in range(100):
        for a, b in pairs:
            if b is not None:
                group[a] = group[b] = min(group[a], group[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == group
