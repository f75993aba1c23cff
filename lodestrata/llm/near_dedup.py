"""Near duplicates by BagMinHash over multisets of word shingles.

A document is the multiset of its lower-cased word pairs. Its signature has a
component for each of *m* registers: the identity of the earliest point that a
set of Poisson processes drops into the register. Every element has a process
for each dyadic interval of weight, (0,1], (1,2], (2,4], (4,8] ..., whose rate
is the interval's length; a point of an interval that the element's weight
fills only in part carries a hashed level and counts if the level is within
the weight. Points so depend on element and level alone, and two signatures
agree in a register with probability sum(min)/sum(max), the weighted Jaccard
similarity, without bias.

Defined results: a null or wordless text has an empty multiset and is no
duplicate of anything. Rows with a null id can't be named and take no part.
Rows that repeat an id are one document: each of its texts finds candidates,
and the largest of its packed multisets is the one compared, so an id is never
a duplicate of itself. Ties go to the smallest id; ids that aren't whole numbers
are compared and returned as strings. Input columns other than the id and the
text are ignored, and pass through drop_near_duplicates(), whatever their names.
Texts of any length and counts of any size are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import linked
from .common import bounded, few, fresh, id_kind, id_of, lower_text, text_slices, written
from .vec import U, _GOLD, bags, mix, shingles, words

SHINGLE = 2
BANDS = 29  # finds a pair at the threshold with 0.904
ROWS = 5
THRESHOLD = 0.6
#: The largest count that one word of a packed multiset holds; a larger one takes several.
MOST = (1 << 24) - 1
_HALF = 0.5 / 2**53


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) / 2**53 + _HALF


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, (n_docs, m) of uint64; rows of empty multisets are 0.

    Elements are in order of document; weights are whole numbers above 0.
    """
    best = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, U)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # The processes are followed up to a time by which all registers are
    # filled with probability 1 - exp(-3); other documents are done again.
    until = m * (math.log(m) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(n_docs, bool)
        wanted[todo] = True
        for r, point, when in _points(doc, element, weight, until, wanted, m):
            np.minimum.at(best, r, when)
            first = best[r] == when
            sig[r[first]] = point[first]
        full = np.isfinite(best.reshape(n_docs, m)[todo]).all(axis=1)
        todo = todo[~full]
        until[todo] *= 2
        best.reshape(n_docs, m)[todo] = np.inf
    return sig.reshape(n_docs, m)


def _points(doc, element, weight, until, wanted, m) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(register of its document, identity, time) of the points of all processes before *until*."""
    low, level = 0, 0
    keep = wanted[doc]
    doc, element, weight = doc[keep], element[keep], weight[keep]
    while len(doc):
        high = 2 * low or 1
        rate = high - low
        seed = mix(element * _GOLD + U(2 * level + 1))
        d, w, t, k, end = doc, weight, np.zeros(len(doc)), 0, until[doc]
        while len(d):
            k += 1
            x = mix(seed + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            t = t - np.log(_uniform(x)) / rate
            alive = t <= end
            if not alive.all():
                d, w, t, seed, end, x = d[alive], w[alive], t[alive], seed[alive], end[alive], x[alive]
            if not len(d):
                break
            y = mix(x ^ U(0x5851F42D4C957F2D))
            r = d * m + ((y >> U(32)) * U(m) >> U(32)).astype(np.int64)
            if rate > 1:
                within = low + 1 + ((y & U(0xFFFFFFFF)) * U(rate) >> U(32)).astype(np.int64) <= w
                yield r[within], y[within], t[within]
            else:
                yield r, y, t
        low, level = high, level + 1
        more = weight > low
        doc, element, weight = doc[more], element[more], weight[more]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) of int64: one key for each band of *rows* registers."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * _GOLD, parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key + parts[:, :, j])
    return key.view(np.int64)


def slice_bags(data: np.ndarray, offsets: np.ndarray, k: int):
    h, d = words(data, offsets)
    s, d = shingles(h, d, len(offsets) - 1, k)
    return bags(s, d)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for data, offsets, at in text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, element, count = slice_bags(data, offsets, k)
                some = np.bincount(doc, minlength=n) > 0
                sig = signatures(doc, element, count, n, bands * rows)
                keys = band_keys(sig, bands, rows)
                whole = np.zeros(n, U)
                np.add.at(whole, doc, mix(mix(element + _GOLD) + count.astype(U)))
                rows_in = np.flatnonzero(some)
                flat = pa.array(keys[rows_in].reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n).take(pa.array(rows_in)), pa.array(mix(whole)[rows_in].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows_in) + 1) * bands, bands, dtype=np.int32)), flat)],
                    names=["id", "same", "keys"],
                )

    return run


def packed_bag(element: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words of 40 bits of the element and 24 of the count, in order; a count above MOST goes over several words."""
    times = (count - 1) // MOST + 1
    if times.max(initial=1) > 1:
        last = np.zeros(int(times.sum()), bool)
        last[np.cumsum(times) - 1] = True
        element, count = np.repeat(element, times), np.where(last, np.repeat(count - (times - 1) * MOST, times), MOST)
    return (element << U(24)) | count.astype(U)


def _bag_bytes(k: int):
    """The multiset as bytes: a word for each distinct element, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for data, offsets, at in text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, element, count = slice_bags(data, offsets, k)
                ends = np.searchsorted(doc, np.arange(n), side="right")
                starts = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([packed_bag(element[a:b], count[a:b]).tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["id", "bag"])

    return run


def unpacked(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    element, count = bag >> U(24), (bag & U(MOST)).astype(np.int64)
    if count.max(initial=0) == MOST:
        first = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
        element, count = element[first], np.add.reduceat(count, first)
    return element, count


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two packed multisets."""
    (ea, ca), (eb, cb) = unpacked(a), unpacked(b)
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    low = int(np.minimum(ca[ia], cb[ib]).sum())
    high = int(ca.sum() + cb.sum()) - low
    return low / high if high else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("bag_a"), batch.column("bag_b")
        score = [weighted_jaccard(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], names=["a", "b", "jaccard"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group but its smallest id, with that id.

    Groups are the connected components of the links that buckets.linked() finds;
    any two documents that share a band and reach the threshold are in one.
    """
    bounded(docs)
    kind = id_kind(docs, id_col)
    texts = docs.select(id_of(docs, id_col).alias("id"), lower_text(text_col).alias("text")).where("id is not null")
    sketch = written(texts.mapInArrow(_sketches(shingle, bands, rows), f"id {kind}, same bigint, keys array<bigint>"), "sketches")

    def bags_of(ids: DataFrame) -> DataFrame:
        some = texts.join(few(ids, ids.count()), "id", "left_semi")
        return some.mapInArrow(_bag_bytes(shingle), f"id {kind}, bag binary").groupBy("id").agg(F.max("bag").alias("bag"))

    label = linked(sketch, bags_of, _verify, threshold, kind).labels
    return label.where("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """*docs* without the duplicates; of rows that repeat an id all stay or go."""
    gone, key = written(near_duplicates(docs, id_col, **kw), "duplicates"), fresh(docs, "__gone")
    gone = few(gone.select(F.col("doc_id").alias(key)), gone.count())
    return docs.join(gone, id_of(docs, id_col) == F.col(key), "left_anti")
