"""SimHash by Golay codes, periodic runs and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tidemill.llm import periodic_runs, queries, simhash_golay, vector_codes
from tidemill.llm.storage import Scratch

NAMES = "the of river stone light winter garden paper engine silver morning quiet letter window market bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(NAMES) + str(rng.randrange(60)) for _ in range(n))


# --- SimHash -------------------------------------------------------------------------------------


def fingerprint(text):
    w = brute.low(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def least_reachable(ids, prints):
    group = list(range(len(ids)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_any_two_prints_of_three_differing_bits_share_a_key():
    rng = random.Random(5)
    for _ in range(60):
        x = rng.getrandbits(64)
        prints = [x] + [x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))) for _ in range(40)]
        owner, key, role = simhash_golay.keys(np.array(prints, dtype=np.uint64))
        own = [{} for _ in prints]
        for place, k, r in zip(owner.tolist(), key.tolist(), role.tolist(), strict=True):
            assert k not in own[place]
            own[place][k] = r
        assert max(map(len, own)) <= 77
        assert all(any(r | other.get(k, 0) == 3 for k, r in own[0].items() if k in other) for other in own[1:])


def test_golay_code_is_perfect():
    _, errors, count = simhash_golay._errors()
    assert sorted(Counter(count.tolist()).items()) == [(1, 277), (6, 1771)] and len(set(errors[:, 0].tolist())) == 2048


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One  two"), (5, "another text of the same id"), (None, "no id here at all"), (None, prose(rng, 30)), (6, "x " * 3000), (7, "ünï çödé " * 9), (8, "a b\tc\x0bd\r\ne")]
    for k in range(12):
        base = prose(rng, 400).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(NAMES)
            rows.append((100 + len(rows) * 7 % 91 + k, " ".join(copy)))
    rows += [(900, rows[20][1]), (900, rows[20][1].upper())]
    frame = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    prints = [fingerprint(t) for _, t in rows]
    expected = Counter(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], least_reachable([i for i, _ in rows], prints), strict=True))
    assert any((prints[a] ^ prints[b]).bit_count() in (1, 2, 3) for a in range(len(rows)) for b in range(a))
    assert Counter(map(tuple, queries.op11_simhash_golay(spark, str(tmp_path)).collect())) == expected
    empty = simhash_golay.near_groups(frame.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_long_text_is_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = [prose(rng, n) for n in (3, 500, 1, 77)] + [None, "two words", prose(rng, 300)]
    monkeypatch.setattr(simhash_golay, "PIECE", 50)
    assert simhash_golay._prints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_large_group_of_near_prints_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_golay, "BLOCK", 40)
    monkeypatch.setattr(simhash_golay, "TASK_ROWS", 300)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    with Scratch(spark, "test") as scratch:
        table = scratch.written(spark.createDataFrame([(p,) for p in signed], "print long"), "prints")
        edges = [tuple(r) for r in simhash_golay.links(table, scratch).collect()]
        with pytest.raises(ValueError):
            simhash_golay.links(table, scratch, bits=4)
    assert len(edges) < 40 * len(prints)  # not all pairs
    label = {p: p for p in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    expected = least_reachable(signed, [p & (1 << 64) - 1 for p in signed])
    assert [find(p) for p in signed] == expected and len(set(expected)) < len(prints) - 200


# --- Periodic runs -------------------------------------------------------------------------------


def all_runs(x, exponent=4, min_length=6):
    out = set()
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            size = i + q - start
            if size >= max(exponent * q, min_length) and not any(all(x[k] == x[k + d] for k in range(start, start + size - d)) for d in range(1, q)):
                out.add((start, size, q))
            i += 1
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for trial in range(1500):
        k, n = rng.choice((1, 2, 2, 3, 5)), rng.randint(0, 40)
        x = [rng.randrange(k) for _ in range(n)]
        if trial % 3 == 0:
            x = ((x[: rng.randint(1, 6)] or [0]) * 50)[:n]
            for _ in range(rng.randint(0, 2) if x else 0):
                x[rng.randrange(len(x))] = rng.randrange(k)
        for exponent, least in ((2, 2), (3, 2), (4, 6)):
            assert periodic_runs.maximal_runs(x, exponent, least) == all_runs(x, exponent, least)
    for x in (fibonacci(300), [bin(i).count("1") & 1 for i in range(300)]):
        assert periodic_runs.maximal_runs(x) == all_runs(x, 2, 2)


def test_words_read_grow_with_the_text():
    rng, n = random.Random(4), 20_000
    hard = {"one word": [0] * n, "fibonacci": fibonacci(n), "thue-morse": [bin(i).count("1") & 1 for i in range(n)], "random": [rng.randrange(2) for _ in range(n)], "period": [i % 7 for i in range(n)], "two blocks": ([0] * (n // 2 - 1) + [1]) * 2}
    for name, x in hard.items():
        for own in ([*x, -1], [*(9 - v for v in x), -1]):
            reads = []
            periodic_runs.lyndon_roots(own, 2, reads)
            assert sum(reads) < 8 * n, name


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs_row(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = all_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(w), len(runs), digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)), *longest)


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 40), (None, None), (4, "no no no no no no yes yes yes yes yes"), (4, "No no No no No no"), (5, "x\ty\r\nx y x y x y\x0bx y"), (6, "tie " * 6 + "and " * 6), (7, "ünï " * 7 + "漢字 かな " * 5)]
    rows += [(100 + k, prose(rng, rng.choice((1, 2, 5, 6, 30, 120)))) for k in range(150)]
    rows += [(300 + k, prose(rng, 5) + " " + (prose(rng, rng.randint(1, 9)) + " ") * rng.randint(3, 7) + prose(rng, 3)) for k in range(60)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_words", "n_runs", "runs_sha256", "collapsed_sha256", "start", "length", "period", "exponent_milli")
    expected = [runs_row(*r) for r in rows]
    assert sum(r[2] > 0 for r in expected) > 40 and any(planted(i, [1, 2, 3]) != [1, 2, 3] for i, _ in rows)
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert queries.op12_periodic_runs(spark, str(tmp_path)).where("collapsed_sha256 is null or runs_sha256 is null").count() == 0
    whole = {r.doc_id: r for r in periodic_runs.find_runs(frame.where("doc_id in (5, 6)")).collect()}
    assert whole[6].collapsed == "tie and" and [tuple(r) for r in whole[6].runs] == [(0, 6, 1), (6, 6, 1)] and whole[5].collapsed == "x y"
    assert periodic_runs.report(periodic_runs.find_runs(frame.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "again and " * 60_000 + prose(rng, 100_000))], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.find_runs(long).first().runs] == [(0, 120_000, 2)]


# --- Vector codes --------------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4, most=None):
    """rows: id, vector, label; what vector_codes.codes says of them."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = next((len(v) for _, v, _ in order if v and len(v) % parts == 0), None)
    fits = lambda v: len(v) == length and (most is None or all(abs(x) < most for x in v))
    width = length // parts
    cut = lambda v, p: v[p * width : p * width + width]
    used = [r for r in order if fits(r[1])]
    books = [[cut(v, p) for _, v, _ in used[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in book] for book in books]
        for _, v, _ in used:
            for p in range(parts):
                members[p][near(p, cut(v, p))[1]].append(cut(v, p))
        books = [[[math.floor(sum(x) / len(m)) for x in zip(*m, strict=True)] if m else c for m, c in zip(members[p], books[p], strict=True)] for p in range(parts)]
    out, totals = [], {}
    for i, v, label in kept:
        best = [near(p, cut(v, p)) for p in range(parts)] if fits(v) else None
        out.append((i, label, best and "".join(f"{e:02x}" for _, e in best), best and sum(d for d, _ in best)))
        if best:
            totals[label] = totals.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, code, error, totals.get(label), digest) for i, label, code, error in out)


def test_codes_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 0.1) + (k % 5) * 0.2 for k in range(64)]
    rows = [(1000 - 3 * k, vector(), rng.choice((None, 0, 1, 2))) for k in range(330)]
    rows += [(5, None, 1), (6, [*vector()[:63], None], 1), (7, [*vector()[:63], math.nan], 1), (8, [math.inf, *vector()[:63]], 1), (9, [-math.inf] * 64, None)]
    rows += [(20, [0.5] * 64, 4)] * 3 + [(None, vector(), 2), (21, [-0.00001] * 64, 4), (22, [0.0] * 64, 4)]
    rows += [(30 + k, list(rows[k][1]), 3) for k in range(40)]  # repeated vectors: ties between equal entries
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op13_vector_codes(spark, str(tmp_path)).collect())) == codes_by_hand(stored)


def test_codes_of_other_shapes(spark):
    rng = random.Random(10)
    rows = [(k, [rng.uniform(-3, 3) for _ in range(6)], k % 3) for k in range(90)]
    rows += [(90, [1.0, 2.0], 0), (-1, [], 1), (-2, [1.0], 5), (91, [1e300] + [0.0] * 5, 1), (92, [1e12, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (93, [90_000.0] * 6, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector_codes.codes(frame, parts=3, entries=7, rounds=2)
    most = math.isqrt((1 << 59) // 6)
    assert Counter(map(tuple, found.collect())) == codes_by_hand(rows, 3, 7, 2, most)
    for none in (frame.limit(0), frame.where("vec_id < 0")):
        out = vector_codes.codes(none)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.where("code is not null").count() == 0
    assert vector_codes.codes(frame.limit(0)).count() == 0


def test_filtering_gives_each_point_its_nearest_entry():
    rng = np.random.default_rng(11)
    for n, spread in ((1, 5), (33, 4), (500, 3), (3000, 2000)):
        points, entries = rng.integers(-spread, spread, (n, 5)), rng.integers(-spread, spread, (40, 5))
        order, nodes = vector_codes.build_tree(points)
        owner, sums, counts = vector_codes.nearest(points[order], nodes, entries)
        expected = ((points[order][:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
        assert (owner == expected).all() and (counts == np.bincount(expected, minlength=40)).all()
        assert all((sums[e] == points[order][expected == e].sum(axis=0)).all() for e in range(40))


def test_whole_subtrees_are_assigned_at_once(monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.integers(-10_000, 10_000, (20, 8))
    points = np.concatenate([c + rng.integers(-3, 3, (200, 8)) for c in centres])
    order, nodes = vector_codes.build_tree(points)
    points, added = points[order], []
    monkeypatch.setattr(vector_codes.np, "add", type("Add", (), {"at": staticmethod(lambda sums, owner, own: added.append(len(own)))}))
    vector_codes.nearest(points, nodes, centres)
    assert sum(added) < 0.35 * len(points)  # the rest came by sums and counts of nodes
