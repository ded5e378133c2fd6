"""Language ID, byte-level BPE, toxicity and URL filter: operators that judge each row alone."""

import base64
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, language_id, toxicity, url_filter
from tidemill.llm import words as words_module

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "plain words here, and 1234 numbers", None, "", "   \n\n\t x", "ünïcödé ßtraße 漢字かな交じり文 🙂🙂", "a" * 5000, "ab" * 3000, "of " * 2000,
    "<|endoftext|> is text", "plain words here, and 1234 numbers", "don't DON'T  we'll\r\n" * 3, "\u0000​﻿",
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode_table(docs, VOCABULARY, public_tokenizers.PATTERN)
    known = reference()
    for r in encoded.collect():
        ids = known.encode_ordinary(TEXTS[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in byte_bpe.decode_table(encoded, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe.encode_table(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_repeated_rows_and_decoding_of_nulls(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300_000))  # one pre-token
    rows = [(1, "the same row"), (1, "the same row"), (None, "no id"), (None, None), (2, long)]
    encoded = byte_bpe.encode_table(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN).collect()
    known = reference()
    assert sorted((str(r.doc_id), r.n_tokens) for r in encoded) == sorted((str(i), len(known.encode_ordinary(t or ""))) for i, t in rows)
    ids = {r.n_tokens: bytes(r.ids) for r in encoded}
    table = spark.createDataFrame([(1, ids[max(ids)], "old"), (2, None, "old"), (3, b"", "old")], "doc_id long, ids binary, text string")
    back = byte_bpe.decode_table(table, VOCABULARY)
    assert back.columns == ["doc_id", "ids", "text"] and {r.doc_id: r.text for r in back.collect()} == {1: long, 2: None, 3: ""}


def test_rank_queue_pops_lowest_rank_first():
    queue = byte_bpe.RankQueue(50_000)
    for rank in (49_999, 64, 0, 4096, 64):
        queue.push(rank, np.array([rank]))
    assert [queue.pop()[0] for _ in range(4)] == [0, 64, 4096, 49_999] and queue.pop() is None


@pytest.fixture(scope="module")
def languages(spark):
    english, german = "the quick brown fox and then there was nothing of it ", "der schnelle braune Fuchs und dann war nichts davon übrig "
    rows = [(i, (english if i % 2 else german) * (1 + i % 4), "en" if i % 2 else "de", "s") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_id(spark, languages):
    held = language_id.held_out("doc_id", 5, 0)
    model = language_id.train_from_table(languages, ~held)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 34 !?"), (-4, "der und das " * 20000), (None, "the fox")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(languages.select("doc_id", "text").union(odd), model).collect()}
    assert all(found[r.doc_id].lang_pred == r.lang for r in languages.where(held).collect())
    assert [found[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and found[-1].score == 0
    assert found[-4].lang_pred == "de" and all(0 <= r.score <= 1 for r in found.values())
    kept = language_id.keep_identified(languages, model)
    assert kept.columns == languages.columns and kept.count() >= 195
    assert language_id.predict(languages.limit(0), model).count() == 0


def test_language_id_rejects_what_it_has_not_learned(spark, languages):
    model = language_id.train_from_table(languages, F.lit(True))
    texts = ["это предложение на русском языке и больше ничего " * 3, "漢字かな交じり文です " * 5, "the fox", "the fox", "der Fuchs und der Fuchs"]
    docs = spark.createDataFrame([(min(i, 3), t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    found = sorted(language_id.predict(docs, model).collect(), key=lambda r: r.score)
    assert sum(r.rejected for r in found) >= 2 and not found[-1].rejected and not any(r.rejected for r in found if r.doc_id == 2 or r.doc_id == 3)
    assert {r.text for r in language_id.keep_identified(docs, model).collect()} >= {"the fox", "der Fuchs und der Fuchs"}
    assert not {r.text for r in language_id.keep_identified(docs, model).collect()} & set(texts[:2])


def brute_force_prediction(model, text):
    """The probabilities, n-gram by n-gram."""
    data = bytes(x if 97 <= x <= 122 or x >= 128 else x + 32 if 65 <= x <= 90 else 32 for x in text.encode())
    data, total, count = b" " + data + b" ", np.zeros(len(model.languages)), 0
    for n in language_id.GRAMS:
        for k in range(len(data) - n + 1):
            gram = data[k : k + n]
            if 32 in gram[1:-1] or not gram.strip(b" "):
                continue
            code = gram[0]
            for x in gram[1:]:
                code = (code * 1099511628211 + x) % 2**64
            total += model.table[((code * 0x9E3779B97F4A7C15 + n * 0x2545F491) % 2**64) >> 48]
            count += 1
    z = (total / max(count, 1) + model.bias) / model.temperature
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_id_equals_brute_force(spark, languages):
    model = language_id.train_from_table(languages, F.lit(True))
    texts = ["The fox, and 3 füchse", "x", "über ALLES", "a-b c" * 50, "der schnelle braune Fuchs " * 3000]
    for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        p = brute_force_prediction(model, texts[r.doc_id])
        assert math.isclose(r.score, p.max(), abs_tol=1e-6) and r.lang_pred == model.languages[p.argmax()]
    tied = language_id.Model(["a", "b"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2, np.float32), np.ones(language_id.BUCKETS, bool))
    assert {r.lang_pred for r in language_id.predict(languages, tied).collect()} == {"a"}


def test_language_id_with_nothing_to_learn(spark, languages):
    model = language_id.train_from_table(languages.limit(0), language_id.held_out("doc_id", 5, 0))
    assert {r.lang_pred for r in language_id.predict(languages, model).collect()} == {"und"}
    assert language_id.keep_identified(languages, model).count() == 0


def test_language_id_of_200_languages_learns_from_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(41)
    monkeypatch.setattr(language_id, "ALL_ROWS", 2000)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(30)] for _ in range(200)]
    rows = [(200 * k + i, " ".join(rng.choice(words[i]) for _ in range(40)), f"l{i:03}") for k in range(15) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sizes = []
    monkeypatch.setattr(language_id, "fitted", lambda sample, fit: (sizes.append(sample.count()), words_module.fitted(sample, fit))[1])
    model = language_id.train_from_table(docs, F.col("doc_id") < 2800)
    assert len(model.languages) == 200 and 1500 < sizes[0] < 2300
    found = language_id.predict(docs.where("doc_id >= 2800"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) == 190


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_rows_of_the_test_tables(spark):
    docs, held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), language_id.held_out("doc_id", 5, 0)
    found = language_id.predict(docs, language_id.train_from_table(docs, ~held)).join(docs, "doc_id").where(held)
    right, all_of_them, lost = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right >= 0.99 * all_of_them and lost <= 0.02 * all_of_them
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # the smaller table has few toxic rows
    severity = toxicity.grade(docs, toxicity.train_from_table(docs, labels.where(~held))).join(labels, "doc_id").where(held)
    rows = severity.select(labels["toxic"].alias("label"), "severity").collect()
    bad, good = ([r.severity for r in rows if r.label == k] for k in (1, 0))
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area >= 0.95


def test_severity_is_judged_by_features_of_other_folds():
    rng = random.Random(43)
    rows = [np.unique([rng.randrange(30, 400) for _ in range(12)] + [w for w in range(12) if k % 3 == 0 and rng.random() < 0.5]).astype(np.int32) for k in range(300)]
    toxic = np.array([int(k % 3 == 0) for k in range(300)])
    expected = []
    for k, own in enumerate(rows):
        others = [j for j in range(300) if j % 5 != k % 5]
        bad = sum(toxic[j] for j in others)
        telling = set()
        for w in set(own.tolist()):
            has = [j for j in others if w in rows[j]]
            df, inside = len(has), sum(toxic[j] for j in has)
            expect = df * bad / len(others)
            spread = max(expect * (1 - bad / len(others)) * (1 - df / len(others)), 1e-9)
            if df >= 3 and max(abs(inside - expect) - 0.5, 0) ** 2 / spread >= toxicity.CHI_SQUARED and inside * 2 > df:
                telling.add(w)
        expected.append((1 + (len(telling) > 2) + (len(telling) > 5)) if toxic[k] else 0)
    assert toxicity.severity_grades(rows, toxic).tolist() == expected and len(set(expected)) == 4
    assert toxicity.severity_grades([], np.zeros(0, np.int64)).tolist() == []


def test_toxicity_separates_and_orders(spark):
    clean, bad = "a calm text about gardens number ", "a vile horrid text you scum "
    docs = spark.createDataFrame([(i, (bad if i % 3 == 0 else clean) + str(i % 7), 1) for i in range(150)] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(5000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_from_table(docs, labels)
    found = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert all(found[i].toxic == (i % 3 == 0) for i in range(120, 150)) and not found[900].toxic and not found[901].toxic
    assert min(found[i].severity for i in range(0, 150, 3)) > max(found[i].severity for i in range(1, 150, 3))
    assert toxicity.grade(docs.limit(0), model).count() == 0
    none = toxicity.train_from_table(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade(docs, none).collect())


def penalised_loss(model, rows, grades, decay=1e-4):
    """The mean of -log P(grade) by its definition, row by row, with the decay that train has by default."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    total = 0.0
    for ids, grade in zip(rows, grades, strict=True):
        z = sum(float(model.weights[i]) for i in ids)
        above = [1.0, *(sigmoid(z - t) for t in model.thresholds), 0.0]
        total -= math.log(above[grade] - above[grade + 1])
    return total / len(rows) + decay / 2 * float((model.weights.astype(float) ** 2).sum())


def ordered(rng, n):
    """Rows whose grades follow a cumulative-link model of known weights."""
    rows = [np.unique(rng.integers(0, 12, 5).astype(np.int32)) for _ in range(n)]
    latent = np.array([sum((i - 6) * 0.5 for i in r) for r in rows]) + rng.logistic(size=n)
    return rows, np.searchsorted([-1.0, 1.5, 3.0], latent)


def test_ordinal_fit_is_the_least_of_the_brute_force_loss():
    rng = np.random.default_rng(5)
    rows, grades = ordered(rng, 600)
    model = toxicity.train(rows, grades)
    used = np.flatnonzero(model.weights)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all() and len(used) > 5
    best = penalised_loss(model, rows, grades)
    for _ in range(60):  # no step in any direction lowers the loss
        size = 10 ** rng.uniform(-2.5, -0.5)
        weights = model.weights.copy()
        weights[used] += rng.normal(0, size, len(used))
        other = toxicity.Model(weights, np.sort(model.thresholds + rng.normal(0, size, 3)))
        assert penalised_loss(other, rows, grades) > best - 1e-6
    held, own = ordered(rng, 600)
    before = np.cumsum([0, *map(len, held)])
    severity = model.above(model.linear(np.concatenate(held), before)).sum(axis=1)
    means = [severity[own == g].mean() for g in range(4)]
    assert means == sorted(means) and np.corrcoef(severity, own)[0, 1] > 0.6


def test_equally_probable_grades_and_null_ids(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), np.array([0.0, 40.0]))
    docs = spark.createDataFrame([(None, "a text", 1), (1, "a text", 1), (1, "a text", 1), (None, None, 1)], "doc_id long, text string, grade int")
    found = toxicity.grade(docs, model).collect()
    assert sorted((str(r.doc_id), r.grade, r.toxic, round(r.severity, 9)) for r in found) == [("1", 0, False, 0.5)] * 2 + [("None", 0, False, 0.0), ("None", 0, False, 0.5)]


def test_toxicity_learns_supplied_grades_of_repeated_and_long_rows(spark):
    words = ["calm", "rude", "vile"]
    docs = spark.createDataFrame([(i, f"a {words[i % 3]} text number {i % 5}") for i in range(120)] * 2 + [(500, "vile text " * 60_000), (501, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(90)] * 2 + [(500, 2)], "doc_id long, toxic int")
    model = toxicity.train_from_table(docs, labels, binary=False)
    found = toxicity.grade(docs, model).collect()
    assert len(found) == 242 and all(r.grade == r.doc_id % 3 for r in found if r.doc_id < 120)
    assert {r.grade for r in found if r.doc_id == 500} == {2} and all(0 <= r.severity <= 2 for r in found)
    assert len({(r.doc_id, r.severity) for r in found}) == 122


def test_url_rules_and_model(spark):
    urls = {
        0: ("https://www.Example.COM/en/7?q=1", "www.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("http://x.com/en/8#f", "x.com", "/en/8", "com/en/", "block"),
        2: ("http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"), 3: ("http://b.net/de/", "b.net", "/de/", "net/de/", "allow"),
        4: (None, "", "", None, None), 5: ("no scheme/com/en/", "", "", None, None), 6: ("http://notcom/en/x", "notcom", "/en/x", None, None),
    }
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in urls.items()], "page_id long, url string, host string")
    weights = url_filter.train_from_table(spark.createDataFrame(url_filter.labelled(), "url string, label string"))
    found = {r.page_id: r for r in url_filter.filter_urls(pages, weights, url_filter.RULES).collect()}
    for i, (_, host, path, rule, verdict) in urls.items():
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == (verdict or ("block" if found[i].block_probability >= 0.5 else "allow"))
    assert found[4].verdict == found[5].verdict == "allow"


def test_url_model_judges_urls_that_it_has_not_seen(spark):
    learned, other = url_filter.labelled(), url_filter.labelled(1)
    fresh = [x for x in other if x not in set(learned)]
    assert len(fresh) > 400
    weights = url_filter.train_from_table(spark.createDataFrame(learned, "url string, label string"))
    judged = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string"), weights).collect()
    assert sum(r.verdict == fresh[r.page_id][1] for r in judged) >= 0.97 * len(fresh)


def test_url_model_is_cross_validated_by_groups(spark):
    rows = url_filter.labelled_groups()
    table = spark.createDataFrame(rows, "url string, label string, word_group string")
    model = url_filter.model_from_table(table, group="word_group")
    # By hand: no row is judged by a model that has learned from its group.
    parsed = [re.match(r"([^/?#]*)([^?#]*)", u.partition("://")[2]).groups() for u, _, _ in rows]
    y, fold = np.array([label == "block" for _, label, _ in rows]), np.array([zlib.crc32(g.encode()) % url_filter.FOLDS for _, _, g in rows])
    z = np.zeros(len(rows))
    for k in range(url_filter.FOLDS):
        learned = [i for i in np.flatnonzero(fold != k)]
        assert not {rows[i][2] for i in learned} & {rows[i][2] for i in np.flatnonzero(fold == k)}
        weights = url_filter.train([parsed[i][0] for i in learned], [parsed[i][1] for i in learned], y[learned], decay=model.decay)
        out = np.flatnonzero(fold == k)
        z[out] = url_filter.logits(pa.array([parsed[i][0] for i in out]), pa.array([parsed[i][1] for i in out]), weights)
    blocked = 1 / (1 + np.exp(-z)) >= model.threshold
    assert abs(blocked[~y].mean() - model.false_blocks) < 0.005 and abs(blocked[y].mean() - model.recall) < 0.02
    # Words that it hasn't learned it knows by a quarter only, at 5 % false blocks; README says so.
    assert model.false_blocks <= 0.05 and model.recall >= 0.2
    unknown = ["https://github.com/apache/spark", "https://stackoverflow.com/questions/1", "https://en.wikipedia.org/wiki/Bayes", "http://ththing.example.net/de/1", "http://tiontion.example.net/en/8.html", None]
    judged = url_filter.filter_urls(spark.createDataFrame([(None, u) for u in unknown], "page_id long, url string"), model).collect()
    assert len(judged) == len(unknown) and all(r.verdict == "allow" and r.page_id is None for r in judged)
    bad = spark.createDataFrame([(1, "http://www.casino-bonus.com/"), (1, "http://www.casino-bonus.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(bad, model).collect()] == ["block"] * 2
    one_sort = url_filter.model_from_table(table.where("label = 'block'"), group="word_group")
    assert one_sort.threshold == 0.5 and url_filter.model_from_table(table.limit(0)).weights.tolist() == [0.0] * (url_filter.BUCKETS + 1)


def brute_force_probability(url, weights):
    """The model's probability, gram by gram."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    total, n_grams = 0.0, 0
    for salt, part in ((1, host), (2, path)):
        data = b"\0" + part.encode() + b"\0"
        for n in url_filter.GRAMS:
            for k in range(len(data) - n + 1):
                code = salt * 16 + n
                for byte in data[k : k + n]:
                    code = (code * 257 + byte) % 2**64
                total += weights[int(url_filter.mix(np.array([code], dtype=np.uint64))[0]) % url_filter.BUCKETS]
                n_grams += 1
    return 1 / (1 + math.exp(-(total / math.sqrt(max(n_grams, 1)) + weights[-1])))


def test_url_filter_equals_brute_force(spark):
    long = "http://" + "a" * 100_000 + ".example.com/" + "b" * 100_000
    urls = ["http://Example.COM", "", None, "http://ads.example.com/é?x", "no scheme", "http://ads.example.com/é?x", "x://y#z", long]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    weights = url_filter.train_from_table(spark.createDataFrame(url_filter.labelled(), "url string, label string"))
    found = {r.page_id: r for r in url_filter.filter_urls(pages, weights).collect()}
    assert len(found) == len(urls) and all(math.isclose(found[i].block_probability, brute_force_probability(u, weights), abs_tol=1e-9) for i, u in enumerate(urls[:-1]))
    assert found[3][1:] == found[5][1:] and found[0].verdict == "allow" and found[7].host.startswith("aaa")
    assert url_filter.filter_urls(pages.limit(0), weights).count() == 0
    none = url_filter.train_from_table(pages.limit(0).select("url", F.col("host").alias("label")))
    assert {r.block_probability for r in url_filter.filter_urls(pages, none).collect()} == {0.5}


def test_of_rules_of_one_length_one_wins(spark):
    pages = spark.createDataFrame([(1, "http://b.a.com/x/y")], "page_id long, url string")
    rules = [("block", "a.com/x/y"), ("allow", "b.a.com/x/"), ("allow", "a.com/x/"), ("block", "com/x/")]
    assert len("a.com/x/y") + 1 == len("b.a.com/x/")
    assert url_filter.filter_urls(pages, np.zeros(url_filter.BUCKETS + 1), rules).first().rule == "b.a.com/x/"
    assert url_filter.filter_urls(pages, np.zeros(url_filter.BUCKETS + 1), [("allow", "com/x/"), ("block", "com/x/")]).first().rule == "com/x/"
