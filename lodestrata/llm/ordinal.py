"""Quality classifier: a cumulative-link regression on graded ratings.

A document's hashed features share one weight vector; the grade k is reached
with probability sigmoid(score - threshold_k), where the thresholds are ordered
by construction. The expected grade is the sum of these tail probabilities.
Features are the stems (first STEM bytes) of its words, each present or not;
its byte trigrams, which see case and punctuation, by frequency; and the share of
words that repeat the word before.

Grades come from the labels: 0 for poor quality, 1 for acceptable but toxic, 2
for good. The fit takes at most *per_grade* labelled documents of each grade,
those whose ids hash lowest, leaves out features of fewer than MIN_DOCS of them,
and is the same on every run.

Defined results: a null text counts as empty; an empty text has no features and
score 0. Labels with a null id or quality are left out, a null toxic counts as
0, and of labels that repeat an id the lowest grade counts. Without labelled
documents every document passes. Ids of the labels are compared under the type of
the documents' ids; those that can't be cast to it are left out. Every input row is
scored by itself, so repeated rows get equal scores, and null ids are scored too.
Other columns pass through; one named like a new column stays under a free name,
such as _tail_probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, id_kind, id_of, text_slices, with_columns
from .vec import U, WORD, bags, doc_of, run_hashes, runs

STEM = 4
STEM_BITS = 18
GRAM_BITS = 14
ECHO = (1 << STEM_BITS) + (1 << GRAM_BITS)
SIZE = ECHO + 1
#: Labelled documents of each grade that the fit takes at most.
PER_GRADE = 2000
MIN_DOCS = 10
#: Features that the fit takes at a time.
BLOCK = 1 << 19
GRADES = 3
#: Least grade and its least probability for a document to be selected.
GRADE, TAIL = 2, 0.4
#: Weight of a present stem, and of a share of trigrams or repeated words.
STEM_SCALE, SHARE_SCALE = 0.5, 20.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(n, grades - 1): probability of reaching each grade from 1."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket at each position, whether the trigram there lies within one text)."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    d = data.astype(np.uint32)
    g = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    g *= np.uint32(2654435761)
    g >>= np.uint32(32 - GRAM_BITS)
    whole = np.ones(n, bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        whole[at[(at >= 0) & (at < n)]] = False
    return g, whole


def _echoes(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each text's words that repeat the word before."""
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def _stems(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each text's distinct stems, and each text's share of repeated words."""
    starts, ends = runs(data, offsets, WORD)
    doc = doc_of(starts, offsets)
    echo = _echoes(run_hashes(data, starts, ends), doc, len(offsets) - 1)
    doc, bucket, _ = bags(run_hashes(data, starts, np.minimum(ends, starts + STEM)), doc, STEM_BITS)
    return doc, bucket.astype(np.int64), echo


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), distinct features of each text."""
    n_docs = len(offsets) - 1
    sd, stem, echo = _stems(data, offsets)
    g, whole = _grams(data, offsets)
    n_grams = np.maximum(np.diff(offsets) - 2, 1)
    gd = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets))[: len(g)][whole]
    gd, gram, count = bags(g[whole].astype(U) << U(64 - GRAM_BITS), gd, GRAM_BITS)
    some = np.flatnonzero(echo)
    doc = np.concatenate([sd, gd, some])
    bucket = np.concatenate([stem, gram.astype(np.int64) + (1 << STEM_BITS), np.full(len(some), ECHO)])
    value = np.concatenate([np.full(len(sd), STEM_SCALE), SHARE_SCALE * count / n_grams[gd], SHARE_SCALE * echo[some]])
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order], value[order].astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The linear score of the same features."""
    n_docs = len(offsets) - 1
    doc, stem, echo = _stems(data, offsets)
    out = STEM_SCALE * np.bincount(doc, weights=weights[stem], minlength=n_docs)
    g, whole = _grams(data, offsets)
    if len(g):
        w = weights[1 << STEM_BITS : ECHO][g]
        w[~whole] = 0
        sums = np.append(0, np.cumsum(w))
        ends = np.minimum(offsets, len(g))
        out += SHARE_SCALE * (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(np.diff(offsets) - 2, 1)
    return out + SHARE_SCALE * weights[ECHO] * echo


def fit(sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, size: int = SIZE, grades: int = GRADES, steps: int = 400, l2: float = 5e-4, rate: float = 0.05, min_docs: int = MIN_DOCS) -> Model:
    """Maximum likelihood with every grade weighing the same, by Adam on all rows: *sizes* features of each document in turn."""
    n = len(grade)
    if not n:
        return Model(np.zeros(size), np.linspace(-40, -39, grades - 1))
    often = np.bincount(cols, minlength=size) >= min_docs
    used = np.flatnonzero(often)
    kept = often[cols]
    ends = np.append(0, np.cumsum(kept, dtype=np.int32))[np.append(0, np.cumsum(sizes))]
    at, values = (np.cumsum(often, dtype=np.int32) - 1)[cols[kept]], values[kept]
    del cols, kept
    # In blocks of rows, so that nothing but the features themselves is held for all of them.
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), [0, n]))
    blocks = [(slice(a, b), slice(ends[a], ends[b]), np.diff(ends[a : b + 1])) for a, b in zip(cuts[:-1], cuts[1:])]
    w, theta = np.zeros(len(used)), np.append(-1.0, np.zeros(grades - 2))
    weight = (1 / np.maximum(np.bincount(grade, minlength=grades), 1))[grade]
    weight /= weight.sum()
    moment, square = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    i = np.arange(n)
    for step in range(1, steps + 1):
        score = np.zeros(n)
        for rows, cells, counts in blocks:
            some = counts > 0
            if some.any():
                score[rows][some] = np.add.reduceat(w[at[cells]] * values[cells], (np.cumsum(counts) - counts)[some])
        cut = np.cumsum(np.append(theta[0], np.exp(theta[1:])))
        tail = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -50, 50))), np.zeros(n)])
        slope = tail * (1 - tail)
        p = np.maximum(tail[i, grade] - tail[i, grade + 1], 1e-9)
        up, down = weight * slope[i, grade] / p, weight * slope[i, grade + 1] / p
        d_cut = np.array([up[grade == k].sum() - down[grade + 1 == k].sum() for k in range(1, grades)])
        d_theta = np.array([d_cut.sum(), *(np.exp(theta[j]) * d_cut[j:].sum() + 1e-3 * theta[j] for j in range(1, grades - 1))])
        grad = l2 * w
        for rows, cells, counts in blocks:
            grad += np.bincount(at[cells], weights=np.repeat((down - up)[rows], counts) * values[cells], minlength=len(w))
        grad = np.append(grad, d_theta)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = rate * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, np.cumsum(np.append(theta[0], np.exp(theta[1:]))))


def graded(labels: DataFrame, kind: str = "bigint") -> DataFrame:
    """(id, grade) of the labels; *kind* is the type of the ids."""
    quality, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    grade = F.when(quality <= 0, 0).when(toxic > 0, 1).otherwise(2)
    return labels.where(F.col("quality").isNotNull()).groupBy(id_of(labels, "doc_id", kind).alias("id")).agg(F.min(grade).alias("grade")).where("id is not null")


def sample(labels: DataFrame, per_group: int, groups: int, by: str) -> DataFrame:
    """At most *per_group* rows of each value of *by* from 0: those whose ids hash lowest."""
    out = None
    for g in range(groups):
        part = labels.where(F.col(by) == g).orderBy(F.xxhash64("id"), "id").limit(per_group)
        out = part if out is None else out.unionByName(part)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, offsets, at in text_slices(batch.column("text")):
            n = len(offsets) - 1
            doc, bucket, value = features(data, offsets)
            ends = np.searchsorted(doc, np.arange(n), side="right")
            starts = np.append(0, ends[:-1])
            cols = pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(starts, ends)], pa.binary())
            vals = pa.array([value[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, n), batch.column("grade").slice(at, n), cols, vals], names=["id", "grade", "cols", "vals"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Model:
    """Fit on at most *per_grade* labelled documents of each grade."""
    bounded(docs)
    kind = id_kind(docs, id_col)
    chosen = F.broadcast(sample(graded(labels, kind), per_grade, GRADES, "grade"))  # 3 * per_grade rows at most
    texts = docs.select(id_of(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id")
    got = texts.mapInArrow(_feature_rows, f"id {kind}, grade int, cols binary, vals binary").toArrow()
    best: dict[int, int] = {}  # of rows that repeat an id, the one whose features sort first
    ids, cols = got.column("id").to_pylist(), got.column("cols").to_pylist()
    for i, x in enumerate(ids):
        if x not in best or cols[i] < cols[best[x]]:
            best[x] = i
    order = [best[x] for x in sorted(best)]
    sizes = np.array([len(cols[i]) // 4 for i in order], np.int64)
    joined = np.frombuffer(b"".join(cols[i] for i in order), np.int32)
    del cols
    vals = got.column("vals")
    values = np.frombuffer(b"".join(vals[i].as_py() for i in order), np.float32)
    grade = got.column("grade").to_numpy()[order].astype(np.int64) if order else np.zeros(0, np.int64)
    return fit(sizes, joined, values, grade)


def scored(docs: DataFrame, model: Model, text_col: str = "text", grade: int = GRADE, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """*docs* with the expected grade and the probability of at least *grade*."""

    @F.arrow_udf("struct<expected: double, tail: double>")
    def score(text: pa.Array) -> pa.Array:
        parts = [model.tails(scores(d, o, model.weights)) for d, o, _ in text_slices(text)]
        tails = np.concatenate(parts) if parts else np.zeros((0, GRADES - 1))
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, grade - 1])], names=["expected", "tail"])

    bounded(docs)
    held = fresh(docs, "__score")
    both = docs.withColumn(held, score.asNondeterministic()(F.col(f"`{text_col}`")))
    return with_columns(both, {names[0]: F.col(held)["expected"], names[1]: F.col(held)["tail"]}, drop=[held])


def selected(docs: DataFrame, model: Model, text_col: str = "text", grade: int = GRADE, tail: float = TAIL, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """The rows of *docs* whose probability of *grade* or better is *tail* or more, with their scores."""
    return scored(docs, model, text_col, grade, names).where(F.col(names[1]) >= tail)


def select_documents(docs: DataFrame, model: Model, text_col: str = "text", grade: int = GRADE, tail: float = TAIL) -> DataFrame:
    """The same rows without their scores."""
    names = (fresh(docs, "__expected"), fresh(docs, "__tail"))
    return selected(docs, model, text_col, grade, tail, names).drop(*names)
