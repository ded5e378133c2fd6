"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

The model is trained in numpy, in one task, from a small labelled URL table and is a vector of at most
2 ** 14 weights, whatever the data; urls are judged map-only, so nothing is shuffled.

How strongly weights decay, and from which probability on a url is blocked, cross-validation chooses by groups: rows of one group,
such as those with one word or host, are never on both sides. So it tells how the model does on words that it has not
learned: the threshold is the least at which at most FALSE_BLOCKS of allowed rows so judged are blocked. Of blocked words that it hasn't
learned, it can know only what they share in characters with others; figures are in README.

Defined results: a null url, or one without "://", has empty host and path and gets the
model's verdict for an empty url, which labelled() allows; with no labelled row, every url has
probability a half. A null page id is carried. Of rules of one length the one that is last in code point order wins. Repeated
rows are judged alike, an empty table gives an
empty table, and only the named columns are read, so further columns never clash. A url is
judged whole, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.words import bound_batches, fitted, group_sum, mix, raw

BUCKETS = 1 << 14
GRAMS = (2, 3, 4, 5)
#: At most so many labelled urls are used for training.
MAX_LABELLED = 20_000
#: Folds of the cross-validation, the weight decays that it tries, and the share of allowed urls that may be blocked in it.
FOLDS, DECAYS, FALSE_BLOCKS = 5, (1e-6, 1e-5), 0.05

#: Words that name what a host or path offers: to be blocked, and to be allowed.
BLOCKED = (
    "ads adserver banner popup popunder casino poker slots jackpot bet bets win bonus viagra pills xxx porn adult sex tracker tracking pixel affiliate backlinks warez crack keygen torrent spam coupon payday loans phish malware cheap free "
    "gambling roulette blackjack betting lottery bingo wager sportsbook cialis pharmacy steroids nude erotic escort hentai camgirls hookup fetish webcam clickbait adclick adtrack doubleclick telemetry beacon retarget popads adware spyware trojan keylogger "
    "serial nulled hacked cheats giveaway prize sweepstakes replica counterfeit getrich forex crypto binary pump airdrop doubler lender credit debt essaymill paperwriter followers likes traffic linkfarm seo doorway parked scam fraud verify-account login-secure suspended"
).split()
ALLOWED = (
    "news blog wiki docs library university recipes forum museum weather journal school science history music books garden travel health sports city guide report story archive research lesson about team article collection atlas "
    "apache spark github python linux kernel stack overflow questions answers manual reference tutorial course lecture paper preprint dataset census parliament council government ministry court hospital clinic doctor nurse nature forest river mountain ocean island "
    "bridge railway station airport harbour market bakery kitchen cooking cheese bread coffee tea wine farm village church temple theatre cinema gallery painting sculpture poetry novel writer editor press daily times post tribune herald gazette "
    "football tennis chess running cycling climbing sailing astronomy physics chemistry biology geology maths statistics engineering architecture design photo camera radio podcast video map calendar events jobs contact support help faq project open source software"
).split()
#: What is said before such words.
URGES = "best free cheap hot live top vip mega super online buy discount fast cash 777 24h".split()
NAMINGS = "the my our old new city local open little national royal green north south first saint".split()
#: What stands around a word, and around none: {w} and {v} are words of one sort, {m} what is said before one, {n} a number.
SHAPES = [
    ("http://{w}.example.com/{n}", "https://www.{w}.example.org/en/{n}.html", "https://{v}-{w}.example.net/fr/{n}/", "http://m.{w}-{v}.example.com/de/{n}", "https://example.net/{w}/{n}", "http://www.example.org/{v}/{w}.html"),
    ("https://www.example.com/en/{n}", "http://m.example.net/es/{n}/", "https://example.org/{n}.html", "http://www.example.net/de/{n}", "https://blog.example.org/fr/{n}", "http://example.com", "https://www.example.org/", ""),
    ("https://{w}.com/{v}/{w}", "http://www.{m}{w}.net/{n}", "https://{m}-{w}.org/{v}", "https://{w}{n}.info/{m}-{v}/"),
]


def labelled(part: int = 0) -> list[tuple[str, str]]:
    """labelled_groups without their groups."""
    return [(url, label) for url, label, _ in labelled_groups(part)]


def labelled_groups(part: int = 0) -> list[tuple[str, str, str]]:
    """The small labelled table, some 2,700 urls with the group of each, made by a rule: each word in each shape; and, allowed, hosts of invented names and urls without any such word, the empty one among them.

    A word's group is its own and that of the word beside it, which always comes from the same eight. Another part has other
    numbers and pairs the words otherwise, so it can test what part 0 has taught.
    """
    rows = []
    for label, words, before in (("block", BLOCKED, URGES), ("allow", ALLOWED, NAMINGS)):
        for i, word in enumerate(words):
            first = i - i % 8
            eight = words[first : first + 8]
            other = eight[(i % 8 + 1 + (3 * part) % 7) % len(eight)]
            for k, shape in enumerate(SHAPES[0] + SHAPES[2]):
                number = 1000 + (i * 613 + k * 2741 + part * 389) % 9000
                rows.append((shape.format(w=word, v=other, m=before[(i + k + 5 * part) % len(before)], n=number), label, f"{label} {first}"))
    syllables = [a + b for a in "bdfghklmnprstvw" for b in ("a", "en", "io", "or", "ut", "th")]
    names = ["".join(syllables[(i * 31 + k * 17 + part * 7 + i * k) % len(syllables)] for k in range(2 + i % 3)) for i in range(300)]
    shapes = SHAPES[0][:3] + SHAPES[2][:1]
    rows += [(shapes[i % 4].format(w=name, v="my", n=1000 + (i * 419 + part * 211) % 9000), "allow", f"name {i}") for i, name in enumerate(names)]
    rows += [(shape.format(n=1000 + (i * 877 + k * 1931 + part * 431) % 9000), "allow", f"none {i}") for i in range(8) for k, shape in enumerate(SHAPES[1])]
    return rows


#: (verdict, rule) as the contract of the query states them.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of url; both empty if url is null or has no "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first, as it comes outermost
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(texts: pa.Array, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: buckets of the n-grams of all texts, and how many come before each text."""
    data, offsets = raw(texts)
    padded = np.zeros(len(data) + 2 * (len(offsets) - 1), dtype=np.uint64)  # a zero byte on each side
    shift = np.repeat(np.arange(len(offsets) - 1) * 2 + 1, np.diff(offsets))
    padded[np.arange(len(data)) + shift] = data
    starts = offsets + 2 * np.arange(len(offsets))
    counts = np.diff(starts)
    out = []
    for n in GRAMS:
        each = np.maximum(counts - n + 1, 0)
        before = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat(starts[:-1] - before[:-1], each) + np.arange(before[-1])
        code = np.full(len(at), np.uint64(salt * 16 + n))
        for i in range(n):
            code = code * np.uint64(257) + padded[at + i]
        out.append(((mix(code) % np.uint64(BUCKETS)).astype(np.int64), before))
    return out


def _features(host: pa.Array, path: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    parts = _grams(host, 1) + _grams(path, 2)
    counts = sum(np.diff(before) for _, before in parts)
    return parts, 1 / np.sqrt(np.maximum(counts, 1))


def logits(host: pa.Array, path: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The model's log odds that each url is to be blocked. The last weight is the bias."""
    parts, scale = _features(host, path)
    return sum(group_sum(weights[ids], before) for ids, before in parts) * scale + weights[-1]


def train(host: Sequence[str], path: Sequence[str], blocked: Sequence[bool], epochs: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Weights by accelerated full-batch gradient descent on the regularised logistic loss.

    Each weight has its own rate, the inverse of a bound of the loss's curvature: a diagonal matrix that is nowhere less than the Hessian.
    """
    y = np.asarray(blocked, dtype=np.float64)
    weights = np.zeros(BUCKETS + 1)
    if not len(y):
        return weights
    host_array, path_array = pa.array(host, pa.string()), pa.array(path, pa.string())
    parts, scale = _features(host_array, path_array)
    row = np.concatenate([np.repeat(np.arange(len(y)), np.diff(before)) for _, before in parts])
    cells, value = np.unique(row * BUCKETS + np.concatenate([ids for ids, _ in parts]), return_counts=True)
    row, column = np.divmod(cells, BUCKETS)
    value = value * scale[row]
    before = np.searchsorted(row, np.arange(len(y) + 1))
    total = group_sum(value, before) + 1
    rate = 1 / np.append(np.bincount(column, value * total[row], BUCKETS) / (4 * len(y)) + decay, total.mean() / 4)
    ahead, pace = weights, 1.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(group_sum(ahead[column] * value, before) + ahead[-1]))) - y
        gradient = decay * ahead
        gradient[:-1] += np.bincount(column, error[row] * value, BUCKETS) / len(y)
        gradient[-1] = error.mean()
        new, faster = ahead - rate * gradient, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - weights)
        weights, pace = new, faster
    return weights


@dataclass
class UrlModel:
    """weights, the threshold from which a url is blocked, and how cross-validation by groups chose: the decay, and, of rows of groups not learned from, the share of blocked rows that are blocked (recall) and of allowed ones that are (false_blocks)."""

    weights: np.ndarray
    threshold: float = 0.5
    decay: float = DECAYS[0]
    recall: float = 0.0
    false_blocks: float = 0.0


def cross_validated(host: Sequence[str], path: Sequence[str], blocked: Sequence[bool], group: Sequence[str]) -> UrlModel:
    """The model of all rows, with the decay that finds the most blocked rows of folds left out, at the threshold that keeps to FALSE_BLOCKS there.

    Without rows of both sorts in the folds and out of them, it is trained with the least decay and blocks from a half on.
    """
    y = np.asarray(blocked, dtype=bool)
    fold = np.array([zlib.crc32(g.encode()) % FOLDS for g in group], dtype=np.int64)
    host, path = np.array(host, dtype=object), np.array(path, dtype=object)
    if not all(0 < y[fold != k].sum() < (fold != k).sum() for k in range(FOLDS)) or not 0 < y.sum() < len(y):
        return UrlModel(train(host.tolist(), path.tolist(), y))
    best = None
    for decay in DECAYS:
        z = np.zeros(len(y))
        for k in range(FOLDS):
            out = fold == k
            weights = train(host[~out].tolist(), path[~out].tolist(), y[~out], decay=decay)
            z[out] = logits(pa.array(host[out], pa.string()), pa.array(path[out], pa.string()), weights)
        allowed = np.sort(z[~y])[::-1]
        cut = float(np.nextafter(allowed[int(FALSE_BLOCKS * len(allowed))], np.inf))  # so many are above it
        recall = float((z[y] >= cut).mean())
        if best is None or recall > best[0]:
            best = recall, decay, cut, float((z[~y] >= cut).mean())
    recall, decay, cut, false_blocks = best
    return UrlModel(train(host.tolist(), path.tolist(), y, decay=decay), 1 / (1 + math.exp(-cut)), decay, recall, false_blocks)


def _bounded(labelled: DataFrame, url: str, label: str, group: str | None) -> DataFrame:
    host, path = host_and_path(F.col(url))
    rows = labelled.select(host.alias("h"), path.alias("p"), (F.col(label) == "block").alias("b"), (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else host).alias("g"))
    return rows.where("b is not null").orderBy("h", "p", "b", "g").limit(MAX_LABELLED)


def _columns(table: pa.Table) -> list[list]:
    return [table.column(c).to_pylist() for c in "hpbg"]


def train_from_table(labelled: DataFrame, url: str = "url", label: str = "label") -> np.ndarray:
    """Weights from a table of urls labelled block or allow; at most MAX_LABELLED of its rows are used."""
    return fitted(_bounded(labelled, url, label, None), lambda table: train(*_columns(table)[:3]) if table is not None else train([], [], []))


def model_from_table(labelled: DataFrame, url: str = "url", label: str = "label", group: str | None = None) -> UrlModel:
    """The cross-validated model from such a table. group: the column that says which rows belong together; their host, if there is none."""
    return fitted(_bounded(labelled, url, label, group), lambda table: cross_validated(*_columns(table)) if table is not None else UrlModel(train([], [], [])))


def filter_urls(pages: DataFrame, model: UrlModel | np.ndarray, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the model's probability that the url is to be blocked. Bare weights block from a half on."""
    if not isinstance(model, UrlModel):
        model = UrlModel(model)
    bound_batches(pages.sparkSession)
    url = F.col(url_col)
    host, path = host_and_path(url)
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    shared = pages.sparkSession.sparkContext.broadcast(np.asarray(model.weights, dtype=np.float64))

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            z = logits(pa.array(hosts, pa.string()), pa.array(paths, pa.string()), shared.value)
            yield pd.Series(1 / (1 + np.exp(-z)))

    scored = parsed.withColumn("block_probability", probability("host", "path"))
    return scored.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("block_probability") >= model.threshold, "block").otherwise("allow")).alias("verdict"),
        "block_probability",
    )
