"""Document fingerprints: MinHash over word shingles, banded and verified.

A document is the set of its lower-cased runs of three words. Its fingerprint
holds, for each of *m* universal hash permutations (a*x + b) mod (2**31 - 1),
the smallest value over the set, computed in numpy for many texts at once.
Bands of the fingerprint are joined in Spark, and the Jaccard similarity of the
sets decides.

The result has a row for each document: its class, which is the connected
component of the links (buckets.linked()) and named by its smallest id; the
smallest id with the same set; with how many other sets it is linked; and the
highest similarity to another document. Any two documents that share a band and
reach the threshold are in one class, so both figures are counted inside the classes,
where every two sets are compared, whether they share a band or not (class_links()).
A class of k near copies gives k rows, not k*k/2 pairs, though as many are compared.

Defined results: a null or wordless text has no fingerprint and is a class of
its own. Rows with a null id take no part. Rows that repeat an id are one document,
with the largest of their packed sets. Ids that aren't whole numbers are compared and
returned as strings. An empty table gives none; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import linked
from .common import bounded, few, id_kind, id_of, lower_text, text_slices, written
from .near_dedup import band_keys
from .vec import U, bags, mix, shingles, words

SHINGLE = 3
BANDS = 36  # finds a pair at the threshold with 0.902
ROWS = 4
THRESHOLD = 0.5
PRIME = (1 << 31) - 1
#: Sets and their bytes in a block of a class, on average at most; two blocks are compared at a time.
BLOCK_SETS = 1024
BLOCK_BYTES = 1 << 21
#: Elements in so many of the sets compared are counted by matrix product, SLAB at a time.
OFTEN = 16
SLAB = 1024
#: Rows of results that a worker gathers before it hands them on.
GATHERED = 4096


def permutations(m: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, m, dtype=np.uint64), rng.integers(0, PRIME, m, dtype=np.uint64)


def minhash(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) of uint64: least permuted value of each text's elements, which are in order of text; PRIME where it has none."""
    sig = np.full((n_docs, m), U(PRIME))
    if not len(doc):
        return sig
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    x, mask, down = element % U(PRIME), U(PRIME), U(31)
    y, z = np.empty_like(x), np.empty_like(x)
    for i, (a, b) in enumerate(zip(*permutations(m))):
        np.multiply(x, a, out=y)
        y += b
        np.right_shift(y, down, out=z)
        y &= mask
        y += z  # below 2**32, and equal to the product modulo PRIME
        z[:] = y
        z -= mask
        np.minimum(y, z, out=y)  # z wraps round to a huge value unless y was PRIME or more
        sig[doc[first], i] = np.minimum.reduceat(y, first)
    return sig


def _sets(data: np.ndarray, offsets: np.ndarray, k: int):
    h, d = words(data, offsets)
    s, d = shingles(h, d, len(offsets) - 1, k)
    doc, element, _ = bags(s, d, 32)
    return doc, element


def _fingerprints(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for data, offsets, at in text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, element = _sets(data, offsets, k)
                have = np.flatnonzero(np.bincount(doc, minlength=n) > 0)
                keys = band_keys(minhash(doc, element, n, bands * rows)[have], bands, rows)
                whole = np.zeros(n, U)
                np.add.at(whole, doc, mix(element + U(0x9E3779B97F4A7C15)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n).take(pa.array(have)), pa.array(mix(whole)[have].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(have) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))],
                    names=["id", "same", "keys"],
                )

    return run


def _set_bytes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for data, offsets, at in text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, element = _sets(data, offsets, k)
                packed = element.astype(np.uint32)
                ends = np.searchsorted(doc, np.arange(n), side="right")
                starts = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["id", "bag"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [jaccard(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], names=["a", "b", "jaccard"])


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """(len(xs), len(ys)) of the numbers of elements in common; the sets are arrays without repeats."""
    n, sets = len(xs), [*xs, *ys]
    doc, element = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    doc, element = doc[order], element[order]
    count = np.diff(np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1], [True]])))
    common = np.zeros(n * len(ys), np.int64)
    rare = np.repeat(count < OFTEN, count)
    e, d = element[rare], doc[rare]
    for step in range(1, count[count < OFTEN].max(initial=1)):
        hit = (e[step:] == e[:-step]) & (d[:-step] < n) & (d[step:] >= n)
        common += np.bincount(d[:-step][hit] * len(ys) + d[step:][hit] - n, minlength=len(common))
    common = common.reshape(n, len(ys))
    d, count = doc[~rare], count[count >= OFTEN]
    column, ends = np.repeat(np.arange(len(count)), count), np.append(0, np.cumsum(count))
    for at in range(0, len(count), SLAB):
        some = slice(ends[at], ends[min(at + SLAB, len(count))])
        held = np.zeros((len(sets), SLAB), np.float32)
        held[d[some], column[some] - at] = 1
        common += (held[:n] @ held[n:].T).astype(np.int64)
    return common


def _compared(threshold: float, kind: str):
    """Batches (label, i, j, block, id, bag), in order of the first three, to (id, links, jaccard) within each two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered(rows: list) -> pa.RecordBatch:
            ids, links, best = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64() if kind == "bigint" else pa.string()), pa.array(links, pa.int64()), pa.array(best, pa.float64())], names=["id", "links", "jaccard"])

        rows, out = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5))), []
        for (_, i, j), unit in groupby(rows, lambda r: r[:3]):
            sides = {i: ([], []), j: ([], [])}
            for *_, block, id_, bag in unit:
                sides[block][0].append(id_)
                sides[block][1].append(np.frombuffer(bag.as_buffer(), np.uint32))
            (x_ids, xs), (y_ids, ys) = sides[i], sides[j]
            if not xs or not ys:
                continue
            common = overlaps(xs, ys)
            sizes = [np.array([len(s) for s in side]) for side in (xs, ys)]
            alike = common / (sizes[0][:, None] + sizes[1] - common)
            if i == j:
                np.fill_diagonal(alike, -1)
            for ids, axis in ((x_ids, 1), (y_ids, 0))[: 1 if i == j else 2]:
                links, best = (alike >= threshold).sum(axis=axis), alike.max(axis=axis)
                out += [(ids[k], links[k], best[k]) for k in np.flatnonzero(links)]
            if len(out) >= GATHERED:
                yield gathered(out)
                out = []
        if out:
            yield gathered(out)

    return run


def class_links(labels: DataFrame, bag: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(id, links, jaccard): with how many other sets in *bag* (id, bag) of its class each set is linked, and the highest similarity.

    Every two sets of a class in *labels* (id, label) are compared. A large class
    is cut into blocks by a hash of the id, and each two blocks are a unit of their own,
    so no class is gathered; pairs are counted where they are compared, and never written.
    """
    sized = written(bag.select("id", F.length("bag").alias("bytes")).join(labels, "id"), "sized")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    classes = sized.groupBy("label").agg(F.count("*").alias("sets"), blocks.alias("blocks")).where("sets > 1").drop("sets")
    placed = written(sized.join(classes, "label").select("id", "label", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "placed")
    units = bag.join(few(placed, placed.count()), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "bag")
    units = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    found = units.mapInArrow(_compared(threshold, kind), f"id {kind}, links bigint, jaccard double")
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.max("jaccard").alias("jaccard"))


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_of, links, jaccard) of every document; jaccard is null where it is alone."""
    bounded(docs)
    kind = id_kind(docs, id_col)
    texts = docs.select(id_of(docs, id_col).alias("id"), lower_text(text_col).alias("text")).where("id is not null")
    sketch = written(texts.mapInArrow(_fingerprints(shingle, bands, rows), f"id {kind}, same bigint, keys array<bigint>"), "fingerprints")

    def bags_of(ids: DataFrame) -> DataFrame:
        some = texts.join(few(ids, ids.count()), "id", "left_semi")
        return some.mapInArrow(_set_bytes(shingle), f"id {kind}, bag binary").groupBy("id").agg(F.max("bag").alias("bag"))

    found = linked(sketch, bags_of, _verify, threshold, kind)
    degree = class_links(found.labels, found.bags, threshold, kind)
    # Rows with an equal: each copy with the links of the smallest id, and that id itself.
    copies = found.equal.select("id", "rep").unionByName(found.equal.select(F.col("rep").alias("id"), "rep").distinct()).groupBy("id").agg(F.min("rep").alias("copy_of"))
    of = found.labels.join(copies, "id", "left").withColumn("key", F.coalesce("copy_of", "id"))
    of = of.join(degree.withColumnRenamed("id", "key"), "key", "left")
    of = of.select("id", "label", "copy_of", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("copy_of").isNotNull(), F.lit(1.0)).otherwise(F.col("jaccard")).alias("jaccard"))
    return (
        texts.select("id").distinct().join(of, "id", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("label", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "jaccard")
    )
