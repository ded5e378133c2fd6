"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades 0 to K are ordered: P(grade > k) = sigmoid(w.x - threshold[k]), with one weight vector
shared by the ordered thresholds. x says which hashed words, and five-byte beginnings of words,
a text has. Weights are learned in numpy, in one task, from a bounded sample of labelled rows, on those
features whose presence depends on the label (chi squared); the model is one vector of BUCKETS
weights, broadcast at that fixed size, and whole texts are graded map-only.

Ordered labels are learned as they are. Where labels say only 0 or 1 (binary), the grades above 1 are
synthetic: severity_grades makes them from how many of the telling features a toxic text has. They then
order toxic texts by the amount of such words and are no independent judgement of severity.

Defined results: a text that is null, or has no letter or digit, has no features and severity 0. If
no labelled row exists, every text has severity 0. A very long text is graded whole, but not learned from beyond SAMPLE_CHARS; a null id is carried. Labels without a document, and null labels, are not used. Repeated
rows are graded alike, and of the rows of one labelled id one is learned from; of equally probable grades the lowest is given; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.words import bound_batches, fitted, releasing, slices, words

BUCKETS = 1 << 20
PREFIX = 5
#: Training takes about so many labelled rows at most, and none longer than so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 50_000
#: Features enter the model from this chi-squared value on.
CHI_SQUARED = 12.0

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[128:] = False
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, text by text, each word giving two in a row; and how many come before each text."""
    found = words(texts, _BETWEEN)
    whole, start = found.hashes(), found.hashes(PREFIX) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack(((whole % np.uint64(BUCKETS)), start >> np.uint64(44)), axis=1).astype(np.int32).ravel(), found.before * 2


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS
    thresholds: np.ndarray  # ascending, one less than there are grades

    def linear(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """w.x for each text, from what features gives; a feature counts once, however often it comes."""
        hit = np.flatnonzero(self.weights[ids])
        owner = np.searchsorted(before, hit, side="right") - 1
        pairs = np.unique(owner * BUCKETS + ids[hit])
        return np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS], len(before) - 1)

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -40, 40)))


def train(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """rows: the different feature buckets of each text. grades: 0, 1, ... of each text.

    Gradient descent (Adam) on the mean of -log P(grade) with L2 decay.
    """
    n, top = len(rows), int(grades.max(initial=0))
    if not n or not top:
        return Model(np.zeros(BUCKETS, np.float32), np.full(1, 40.0))
    ids = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    chosen = select(ids, owner, grades)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[ids] >= 0
    column, owner = place[ids[kept]], owner[kept]
    params = np.concatenate((np.zeros(len(chosen)), [1.0], np.zeros(top - 1)))  # weights, first threshold, log steps between thresholds
    first, second = np.zeros_like(params), np.zeros_like(params)
    w = len(chosen)
    for epoch in range(1, epochs + 1):
        steps = np.exp(params[w + 1 :])
        thresholds = params[w] + np.concatenate(([0.0], np.cumsum(steps)))
        linear = np.bincount(owner, params[column], n)
        upper = np.append(thresholds, np.inf)[grades] - linear  # P(grade <= g) and P(grade <= g - 1)
        lower = np.concatenate(([-np.inf], thresholds))[grades] - linear
        s_up, s_low = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        p = np.maximum(s_up - s_low, 1e-9)
        up, low = s_up * (1 - s_up) / p / n, s_low * (1 - s_low) / p / n
        up[grades == top] = 0.0
        low[grades == 0] = 0.0
        by_threshold = np.zeros(top)
        np.subtract.at(by_threshold, np.minimum(grades, top - 1)[grades < top], up[grades < top])
        np.add.at(by_threshold, grades[grades > 0] - 1, low[grades > 0])
        gradient = np.empty_like(params)
        gradient[:w] = np.bincount(column, (up - low)[owner], w) + decay * params[:w]
        gradient[w] = by_threshold.sum()
        gradient[w + 1 :] = np.cumsum(by_threshold[::-1])[::-1][1:] * steps
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params -= rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[chosen] = params[:w]
    return Model(weights, params[w] + np.concatenate(([0.0], np.cumsum(np.exp(params[w + 1 :])))))


def select(ids: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """The features whose presence depends on whether the grade is above 0."""
    n, bad = len(grades), int((grades > 0).sum())
    df = np.bincount(ids, minlength=BUCKETS).astype(float)
    in_bad = np.bincount(ids[grades[owner] > 0], minlength=BUCKETS).astype(float)
    expected = df * bad / n
    spread = np.maximum(expected * (1 - bad / n) * (1 - df / n), 1e-9)
    return np.flatnonzero(((np.abs(in_bad - expected) - 0.5).clip(0) ** 2 / spread >= CHI_SQUARED) & (df >= 3))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades from binary labels: 0 if not toxic, else 1, 2 or 3 as the text has at most 2, at most 5 or more features that speak for toxicity."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    if not toxic.any():
        return np.zeros(len(rows), dtype=np.int64)
    chosen = select(ids, owner, toxic)
    inside = np.bincount(ids[toxic[owner] > 0], minlength=BUCKETS)[chosen]
    speaks = np.zeros(BUCKETS, dtype=bool)
    speaks[chosen[inside * 2 > np.bincount(ids, minlength=BUCKETS)[chosen]]] = True
    hits = np.bincount(owner, speaks[ids], len(rows))
    return np.where(toxic > 0, 1 + (hits > 2) + (hits > 5), 0).astype(np.int64)


def train_from_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", binary: bool = True) -> Model:
    """The model from a sample of the labelled documents. binary: the labels are 0 or 1, and severity_grades makes grades of them; else they are grades."""
    bound_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("grade")).where("grade >= 0 and id is not null").groupBy("id").agg(F.max("grade").alias("grade"))
    n = marked.count()
    if n > SAMPLE_ROWS:
        share = SAMPLE_ROWS / n
        marked = marked.where(F.xxhash64("id").cast("double") < (2 * share - 1) * 2.0**63)
    # Each id is in the sample once, and an id and a grade are 12 bytes: that bounds the broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(marked), "id")

    @releasing
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, before = features(part.column("text"))
                each = [np.unique(ids[a:b]) for a, b in zip(before, before[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("grade"), pa.array([x.tobytes() for x in each], pa.binary())], ["id", "grade", "ids"])

    found = rows.select("id", "grade", "text").mapInArrow(sparse, "id string, grade int, ids binary").groupBy("id", "grade").agg(F.min("ids").alias("ids"))

    def fit(found: pa.Table | None) -> Model:
        if found is None:
            return train([], np.zeros(0, np.int64))
        found = found.sort_by([("id", "ascending")])
        each = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in found.column("ids").combine_chunks()]
        grades = found.column("grade").to_numpy().astype(np.int64)
        return train(each, severity_grades(each, grades) if binary else grades)

    return fitted(found, fit)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (the expected grade), grade (the most probable) and toxic (grade 0 has a probability below a half)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, before = features(part.column("text"))
                above = model.above(model.linear(ids, before))
                above[np.diff(before) == 0] = 0.0
                each = -np.diff(np.pad(above, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] > 0.5)], ["id", "severity", "grade", "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(graded, f"id {id_type}, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)
