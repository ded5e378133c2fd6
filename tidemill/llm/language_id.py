"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte n-grams of its words with a boundary byte on each side. Their
hashed embeddings are averaged over the whole text and a linear softmax gives the languages'
probabilities. Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows, by one task. A temperature and two rejection thresholds are then fitted on rows
that training has not seen: of the language's probability, and of the share of a text's subwords that
training has met, as a language that is none of those learned has fewer. As averaging and the linear layer commute, prediction only needs one
table of BUCKETS rows, broadcast at a fixed size; it runs map-only over whole texts.

Defined results: a text that is null or has no letter gets the language und, score 0, and is
rejected; so does every text if there is no labelled row to learn from. Null languages are not
learned; a very long text is judged whole, alone in its slice, but not learned from beyond SAMPLE_CHARS; a text of equal probabilities gets the first of these languages in code point order. Repeated rows are judged alike and learned once; an empty table gives an empty table; only the named
columns are read, so further columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch, sized
from tidemill.llm.words import _LOWER, bound_batches, fitted, group_sum, raw, releasing, slices

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
WIDTH = 16
#: Training takes about so many rows of each language at most, of all languages together so many, and none longer than so many characters.
SAMPLE_ROWS, ALL_ROWS, SAMPLE_CHARS = 800, 6_000, 20_000
LEAST_STEPS = 1000
#: The share of held-back rows, correctly labelled, that calibrated rejection may lose.
REJECTED_SHARE = 0.001

_BOUNDARY = np.ones(256, dtype=bool)  # ASCII bytes that are no letters; other bytes belong to letters
_BOUNDARY[128:] = False
_BOUNDARY[[*range(65, 91), *range(97, 123)]] = False
_SYMBOL = np.where(_BOUNDARY, 32, _LOWER).astype(np.uint64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    known: np.ndarray  # BUCKETS: whether training had a subword of the bucket
    temperature: float = 1.0
    sure: float = 0.0  # a text is rejected whose language has a lower probability,
    familiar: float = 0.0  # or of whose subwords a lower share is known

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The languages' probabilities of each text, and the share of its subwords that are known."""
        ids, before = subwords(texts)
        counts = np.maximum(np.diff(before), 1)
        sums = np.stack([group_sum(self.table[:, k][ids], before) for k in range(len(self.languages))], axis=1)
        return softmax((sums / counts[:, None] + self.bias) / self.temperature), group_sum(self.known[ids].astype(np.int64), before) / counts

    def accepts(self, probabilities: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (probabilities.max(axis=1) >= self.sure) & (share >= self.familiar)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, text by text, and how many come before each text."""
    data, offsets = raw(texts)
    lengths = np.diff(offsets)
    starts = offsets + np.arange(len(offsets))  # one boundary byte before each text, and one at the end of all
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    symbols = np.full(len(data) + len(lengths) + 1, 32, dtype=np.uint64)
    symbols[at] = _SYMBOL[data]
    letters = symbols != 32
    parts, places = [], []
    code = symbols.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(1099511628211) + symbols[n - 1 :]
        if n in GRAMS:
            size = len(code)
            inner = letters[:size] | letters[1 : size + 1] if n == 2 else letters[1 : size + 1].copy()
            for i in range(2, n - 1):
                inner &= letters[i : size + i]
            place = np.flatnonzero(inner)
            h = code[place] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x2545F491)
            parts.append((h >> np.uint64(48)).astype(np.int32))
            places.append(place)
    # An n-gram that begins at a text's boundary byte or later, and before the next one's, is that text's.
    befores = [np.searchsorted(place, starts) for place in places]
    befores = [np.append(b[:-1], len(p)) for b, p in zip(befores, places, strict=True)]
    before = sum(befores)
    out = np.empty(int(before[-1]), dtype=np.int32)
    shift = np.zeros(len(lengths), dtype=np.int64)
    for part, b in zip(parts, befores, strict=True):
        counts = np.diff(b)
        out[np.arange(len(part)) + np.repeat(before[:-1] + shift - b[:-1], counts)] = part
        shift += counts
    return out, before


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 20.0, batch: int = 32, seed: int = 7) -> Model:
    """The model by mini-batch gradient descent on nine tenths of the rows; the rest fit temperature and threshold.

    Few rows are gone through more often, for about LEAST_STEPS steps; of many languages each has fewer rows in a batch, so steps are longer.
    """
    languages = sorted(set(labels))
    epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(labels) * 9 // (10 * batch)))))
    rate *= math.sqrt(max(1.0, len(languages) / 4))
    y = np.searchsorted(languages, labels)
    rows = []
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text"):
        ids, before = subwords(part.column(0))
        for a, b in zip(before, before[1:], strict=False):
            own, times = np.unique(ids[a:b], return_counts=True)
            rows.append((own, times.astype(np.int32)))
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    held, seen = np.split(order, [len(y) // 10])
    embed = np.zeros((BUCKETS, WIDTH), dtype=np.float32)  # so that subwords that training lacks say nothing
    weights = np.zeros((WIDTH, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    weights += random.normal(0, 0.1, weights.shape).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for chosen in np.split(seen, range(batch, len(seen), batch)):
            chosen = [i for i in chosen if len(rows[i][0])]
            if not chosen:
                continue
            cat = np.concatenate([rows[i][0] for i in chosen])
            share = np.concatenate([rows[i][1] / rows[i][1].sum() for i in chosen]).astype(np.float32)[:, None]
            counts = [len(rows[i][0]) for i in chosen]
            hidden = np.add.reduceat(share * embed[cat], np.cumsum([0, *counts[:-1]]), axis=0)
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error /= len(chosen)
            back = error @ weights.T
            weights -= step * 0.05 * hidden.T @ error
            bias -= step * 0.05 * error.sum(axis=0)
            order = np.argsort(cat, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cat[order])))
            embed[cat[order[first]]] -= step * np.add.reduceat((share * np.repeat(back, counts, axis=0))[order], first, axis=0)
    known = np.zeros(BUCKETS, dtype=bool)
    for i in seen:
        known[rows[i][0]] = True
    model = Model(languages, embed @ weights, bias, known)
    if len(held):
        calibrate(model, [texts[i] for i in held], y[held])
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Fits the temperature by the log loss, then thresholds of probability and of known subwords, each of which loses at most REJECTED_SHARE of the right predictions."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [model.judge(part.column(0)) for part in slices(batch, "text")]
    p, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    logits = np.log(np.maximum(p, 1e-30))
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = min(np.exp(np.linspace(-2, 2, 41)), key=loss)
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == y
    if not right.any():
        return

    # Few held-back rows say little about the lowest scores, so the thresholds stay nearer to what chance gives: the probability
    # by two thirds of the way, in log odds (the temperature drives sure texts close to 1), the share half-way.
    lowest = lambda scores: float(np.sort(scores)[int(REJECTED_SHARE * len(scores))])
    others = max(1, len(model.languages) - 1)
    p = min(max(lowest(p.max(axis=1)[right]), 1e-6), 1 - 1e-7)
    odds = max(1.0, p / (1 - p) * others) ** (1 / 3) / others
    model.sure = odds / (1 + odds)
    chance = float(model.known.mean())
    model.familiar = chance + 0.5 * max(0.0, lowest(share[right]) - chance)


def train_from_table(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """The model from a sample of the usable rows with a language, about SAMPLE_ROWS of each and ALL_ROWS in all at most, none longer than SAMPLE_CHARS; one task learns from it."""
    bound_batches(docs.sparkSession)
    rows = docs.where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS))
    with Scratch(docs.sparkSession, "languages") as scratch:
        drawn = scratch.written(rows.groupBy("lang").agg(F.count("*").alias("n")), "drawn")
        each = min(SAMPLE_ROWS, ALL_ROWS / max(1, drawn.count()))
        share = drawn.select(F.col("lang").alias("of"), F.least(F.lit(1.0), each / F.col("n")).alias("share"))
        # Drawn by a hash, so the same rows at each run; of repeated rows one is drawn.
        below = F.col("draw").cast("double") < (F.col("share") * 2.0 - 1.0) * F.lit(2.0**63)
        sample = rows.join(sized(share), F.col("lang") == F.col("of")).where(below).groupBy("lang", "draw").agg(F.min("text").alias("text"))
        return fitted(sample, _fit)


def _fit(found: pa.Table | None) -> Model:
    if found is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, dtype=bool))
    found = found.sort_by([("draw", "ascending"), ("lang", "ascending")])
    return train(found.column("text").to_pylist(), found.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the calibrated probability of lang_pred) and rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, usable = part.num_rows, np.asarray(part.column("letters").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
                if model.languages:
                    p, share = model.judge(part.column("text"))
                    best, accepted = p.argmax(axis=1), model.accepts(p, share)
                    score = np.where(usable, p[np.arange(n), best], 0.0)
                    names = np.where(usable, np.array(model.languages, dtype=object)[best], "und")
                else:
                    score, names, accepted = np.zeros(n), np.full(n, "und", dtype=object), np.zeros(n, dtype=bool)
                rejected = (names == "und") | ~accepted
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(predicted, f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str, of: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text has that remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not rejected, with their columns as they are."""
    if not model.languages:
        return docs.where(F.lit(False))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.accepts(*model.judge(part.column(text_col)))))

    return docs.where(F.col(text_col).rlike(r"\p{L}")).mapInArrow(kept, docs.schema)
