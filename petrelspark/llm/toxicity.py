"""Toxicity severity by cumulative-link (proportional odds) ordinal regression on sparse text features.

Grades 0 < 1 < ... < K share one weight per word; ``P(grade > k) = sigmoid(w.x - threshold_k)`` with ascending thresholds,
and the output is the expected grade.  Features are the words that a text has, in lower case.  The model is fitted by
proximal gradient steps with an L1 penalty, so only few words keep a weight, on a sample of labelled rows of bounded,
documented size; the words with weights, a bounded number, then go to every task, which scores whole texts.  Of the sampled
rows the fit reads whole texts and all words that are in some of them.

Defined results: a null or empty text has no words, and so the score of the thresholds alone.  Labelled rows with a null grade
or without a document are not used; of rows that repeat an id each counts.  Without labelled rows of a toxic grade every
severity is 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.columns import as_bytes, in_place, small_batches, texts
from petrelspark.staging import stage

#: Labelled rows of each grade that the fit uses at most: those with the least hashes of their ids.
ROWS_PER_GRADE = 4000
#: Texts of the sample that a word must be in.
LEAST = 4
_TOKEN = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def tokens(text: bytes) -> set[bytes]:
    """The words of a text: runs of letters, digits and other characters than ASCII marks, with A-Z in lower case."""
    return set(_TOKEN.findall(text.lower()))


@dataclass
class OrdinalModel:
    """``weights`` by word; ``thresholds``, ascending, one fewer than grades."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def expected(self, score: np.ndarray) -> np.ndarray:
        """The expected grade for the sums of weights."""
        return sum((1 / (1 + np.exp(-(score - t))) for t in self.thresholds), np.zeros(len(score)))


def _descend(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, p: int, share: np.ndarray, penalty: float, ridge: float, steps: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal steps with an L1 and an L2 penalty and without negative weights, so that no wealth of harmless words outweighs a
    toxic one; a word's step falls with the share of texts that it is in.

    ``share``: of each text in the loss; they add up to 1."""
    n, top = y.shape
    w, theta, floor = np.zeros(p), theta.copy(), 0.2
    rate = 1.0 / np.maximum(floor, np.bincount(cols, weights=share[rows], minlength=p) * 0.25 * top * 12 + ridge)
    momentum, before = w.copy(), w.copy()
    for step in range(steps):
        z = np.bincount(rows, weights=momentum[cols], minlength=n)
        off = (1 / (1 + np.exp(-(z[:, None] - theta[None, :]))) - y) * share[:, None]  # P(grade > k) less what holds
        slope = np.bincount(cols, weights=off.sum(axis=1)[rows], minlength=p) + ridge * momentum
        moved = momentum - rate * slope
        w = np.maximum(moved - rate * penalty, 0)
        theta = np.maximum.accumulate(theta + 2.0 * off.sum(axis=0))
        momentum, before = w + step / (step + 3) * (w - before), w
    return w, theta


def fit(texts: list[bytes], grades: np.ndarray, least: int = LEAST, **how) -> OrdinalModel:
    """``fit_rows`` for texts that are in one place.  ``least``: texts that a word must be in."""
    sets = [tokens(t) for t in texts]
    counts = Counter(w for s in sets for w in s)
    names = sorted(w for w, c in counts.items() if c >= least)
    number = {w: k for k, w in enumerate(names)}
    found = [(i, number[w]) for i, s in enumerate(sets) for w in s if w in number]
    rows, cols = np.array(found, np.int64).reshape(-1, 2).T
    return fit_rows(rows, cols, names, grades, **how)


def fit_rows(rows: np.ndarray, cols: np.ndarray, names: list[bytes], grades: np.ndarray, penalty: float = 0.004, ridge: float = 0.0001, steps: int = 300) -> OrdinalModel:
    """Fit the model to texts of the given grades 0..K, of which text ``rows[i]`` has the word ``names[cols[i]]``.  Grade 0 and the grades above it
    weigh the same, however many rows they have.

    The first fit, with the L1 penalty, chooses the words; the second, on those alone, gives the weights that the penalty has
    made too small."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return OrdinalModel()
    y = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    above = np.clip((y * share[:, None]).sum(axis=0), 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log((1 - above) / above))
    w, _ = _descend(rows, cols, y, len(names), share, penalty, 0.0, steps, theta)
    chosen = np.flatnonzero(w)
    at = np.full(len(names), -1)
    at[chosen] = np.arange(len(chosen))
    stay = at[cols] >= 0
    w, theta = _descend(rows[stay], at[cols[stay]], y, len(chosen), share, 0.0, ridge, 2 * steps, theta)
    return OrdinalModel({names[k]: x for k, x in zip(chosen.tolist(), w.tolist(), strict=True)}, theta.tolist())


def sample(docs: DataFrame, labels: DataFrame, grade: str, rows_per_grade: int = ROWS_PER_GRADE) -> DataFrame:
    """(grade, words) of the labelled rows that the fit uses."""
    graded = labels.select(F.col("doc_id").cast("long").alias("of"), F.expr(grade).cast("int").alias("grade")).where("of is not null and grade is not null")
    present = [r[0] for r in graded.groupBy("grade").count().select("grade").collect()]
    parts = [graded.where(F.col("grade") == g).orderBy(F.xxhash64("of"), "of").limit(rows_per_grade) for g in sorted(present)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "grade int, words array<binary>")
    ids = parts[0]
    for more in parts[1:]:
        ids = ids.union(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [sorted(tokens(t)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.binary()))], ["grade", "words"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("of"))  # rows_per_grade for each grade at most
    return chosen.select("grade", "text").mapInArrow(run, "grade int, words array<binary>")


def train(docs: DataFrame, labels: DataFrame, grade: str, rows_per_grade: int = ROWS_PER_GRADE, least: int = LEAST, **how) -> OrdinalModel:
    """Fit the model to the documents that ``labels`` (doc_id and what the SQL ``grade`` needs) grades.

    The words of the sample are counted first; those in ``least`` texts or more, all of them, come to the driver once, and the
    texts as numbers of such words."""
    rows = stage(sample(docs, labels, grade, rows_per_grade), "sample")
    often = rows.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= least)
    names = sorted(often.select("w").toArrow().column("w").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(names)}
        for batch in batches:
            found = [[number[w] for w in x if w in number] for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["grade", "words"])

    got = rows.mapInArrow(run, "grade int, words array<int>").toArrow()
    lists = got.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return fit_rows(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(), names, got.column("grade").to_numpy().astype(int), **how)


def severity(column: pa.Array, model: OrdinalModel) -> np.ndarray:
    """The expected grade of each text of a column."""
    weights, known = model.weights, set(model.weights)
    return model.expected(np.array([sum(weights[w] for w in sorted(known & tokens(t))) for t in as_bytes(column)], float))


#: Severity in the labels: not toxic, toxic, toxic in a text of low quality.
SEVERITY = "case when toxic = 0 then 0 when toxic = 1 then case when quality = 0 then 2 else 1 end end"


def severities(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, rows_per_grade: int = ROWS_PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (rounded to 6 places), toxic (severity of ``cutoff`` or more)."""
    t = texts(docs, id_col=id_col, text_col=text_col)
    model = train(t, labels, SEVERITY, rows_per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity(batch.column("text"), model))], ["doc_id", "severity"])

    scored = t.mapInArrow(run, "doc_id long, severity double")
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), (F.col("severity") >= cutoff).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose severity reaches ``cutoff``; all columns stay, and texts do not move between tasks."""
    model = train(docs, labels, SEVERITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(severity(batch.column("text"), model) < cutoff))

    return in_place(docs, run)
