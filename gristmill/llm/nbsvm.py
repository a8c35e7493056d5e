"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratio of the two classes, and a linear hinge-loss
model over them is fitted by dual coordinate descent.  N-grams are of words and of word shapes
(letter case, digits and the punctuation itself), hashed into a table of fixed size, so a model is
one array whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, prepare, texts

#: Buckets of the n-gram table, the most labelled rows that a model is fitted on, and the most
#: distinct n-grams that these may have together (256 MB on the driver).
BUCKETS, SAMPLE_ROWS, SAMPLE_GRAMS = 1 << 18, 6_000, 64 << 20
#: Passes of coordinate descent, cost of a margin error, smoothing of counts, share of the fitted
#: weights (the rest is their mean size, as in naive Bayes), folds for calibration.
PASSES, COST, SMOOTHING, SHARE, FOLDS = 12, 1.0, 1.0, 0.9, 3

_SHAPES = [(re.compile(r"[^\W\d_a-z]*[^\W\d_][^\W\d_]*"), None), (re.compile(r"\d+"), "9")]


def shape(word: str) -> str:
    """Case, digits and punctuation of a word, without its letters."""
    word = _SHAPES[1][0].sub("9", word)
    return _SHAPES[0][0].sub(lambda m: "A" if m[0].isupper() else "Aa" if m[0].istitle() else "a" if m[0].islower() else "aA", word)[:16]


class Features:
    """N-gram buckets of texts; distinct words are hashed once per worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hashes(self, raw: bytes) -> int:
        """Hashes of the word and of its shape, 32 bits each."""
        found = self.known.get(raw)
        if found is None:
            word = raw.decode()
            found = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape(word).encode())
            if len(word) <= 32:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[raw] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        """Distinct buckets of the 1- and 2-grams of words and 1- to 3-grams of shapes."""
        words = text.encode().split()  # bytes split at ASCII white space alone
        if not words:
            return np.zeros(0, np.int32)
        both = np.fromiter([self.known.get(w) or self._hashes(w) for w in words], np.uint64, len(words))
        word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        m = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
        grams = [word * m[0], form * m[1], word[:-1] * m[2] + word[1:] * m[0], form[:-1] * m[3] + form[1:] * m[1], form[:-2] * m[4] + form[1:-1] * m[3] + form[2:] * m[1]]
        mixed = np.concatenate(grams)
        mixed ^= mixed >> np.uint64(29)
        return np.unique((mixed * m[0]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, the class ratio folded in
    scale: np.ndarray  # squared size of each bucket, to bring texts to unit length
    bias: float
    slope: float
    offset: float

    def margin(self, buckets: np.ndarray) -> float:
        length = float(np.sqrt(self.scale[buckets].sum())) or 1.0
        return float(self.weights[buckets].sum()) / length + self.bias

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.offset, -30, 30))))


def _ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket between class 1 and class 0."""
    counts = np.full((2, BUCKETS), SMOOTHING)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, most: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge loss, by dual coordinate descent.

    Row i has ``values[i]`` in the buckets ``rows[i]`` and a constant feature of 1 for the bias;
    its dual variable lies between 0 and ``most[i]``.  The order of visits is shuffled from a fixed
    seed.
    """
    w, bias, alpha, rnd = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(passes):
        for i in rnd.permutation(len(rows)):
            row, x = rows[i], values[i]
            gradient = y[i] * (float(w[row] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / (1.0 + float(x @ x)), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[row] += step * x
                bias += step
                alpha[i] = new
    return w, bias, alpha


def _descend(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights over scaled indicators of unit length; each class bears half of the cost."""
    ratio = _ratio(rows, labels)
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 0).mean() or 1.0, (labels == 1).mean() or 1.0) * 2
    values = [ratio[r] / (np.linalg.norm(ratio[r]) or 1.0) for r in rows]
    w, bias, _ = dual_descent(rows, values, y, COST * share)
    used = w != 0
    mean = float(np.abs(w[used]).mean()) if used.any() else 0.0
    return (SHARE * w + (1 - SHARE) * mean * np.sign(w)) * ratio, ratio**2, bias


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton's method."""
    a, b = 1.0, 0.0
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from the buckets and labels (0 or 1) of some texts.

    With one class only, every text gets the share of that class (0.5 without any labels).
    """
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.zeros(len(rows), int)
    for label in (0, 1):  # every fold has its part of each class
        members = np.flatnonzero(labels == label)
        fold[members] = np.arange(len(members)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        train, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(labels[train].tolist())) == 2:
            part = Model(*_descend([rows[i] for i in train], labels[train]), 1.0, 0.0)
            margins[rest] = [part.margin(rows[i]) for i in rest]
    return Model(*_descend(rows, labels), *_calibrate(margins, labels))


def train(docs: DataFrame, labels: DataFrame, label: str, take: Column | None = None, sample: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their ids.

    ``labels`` has ``doc_id`` and 0 or 1 in ``label``; rows where ``take`` isn't true, and null
    ids, are left out.  The bound is on labelled rows alone: features of that many texts come to the
    driver, of one text for each id, and fewer texts where they are so long that their n-grams
    exceed ``SAMPLE_GRAMS``.
    """
    prepare(docs.sparkSession)
    chosen = labels.where(F.col(label).isin(0, 1) & (take if take is not None else F.lit(True)))
    chosen = chosen.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "label", "buckets"])

    joined = texts(docs).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string"), "label", "text")
    each = joined.mapInArrow(run, "doc_id string, label int, buckets binary")
    # Copies of an id fall away before anything moves; at most ``sample`` rows remain.
    one = materialize(each.groupBy("doc_id").agg(F.min(F.struct("label", "buckets")).alias("one")).select("doc_id", "one.*"), "nbsvm-features")
    before = Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fit_in = one.select("doc_id", F.length("buckets").alias("size")).withColumn("held", F.sum("size").over(before)).where(F.col("held") <= 4 * SAMPLE_GRAMS)
    found = one.join(fit_in.select("doc_id"), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(b, np.int32) for b in found["buckets"].to_pylist()], np.array(found["label"].to_pylist(), int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the likeness to class 1, from 0 to 1, of every whole text.

    Null texts count as empty; an empty text gets the score that the model has without n-grams;
    repeated rows each get a row; other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), shared.value
        for batch in batches:
            scores = [own.score(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(features(t or "")) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold_of(doc_id: str = "doc_id") -> Column:
    """The fold 0 to 3 of an id; fold 2 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for quality, learnt outside the held-out fold."""
    model = train(docs, labels, "quality", fold_of() != 2)
    scored = score(docs, model)
    return scored.select("doc_id", (fold_of() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
