"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are first cut into pieces of it, at
offsets in their tokens by a tokenizer's vocabulary (tokens.py). The pieces are dealt
by hash into shards of a bounded number of tokens and pieces, and each
shard is packed by best fit in order of falling length: a piece goes to the
open bin with the least sufficient room. If none has room a bin is opened, of the
permitted length whose filling with the largest pieces left that fit would cost
least per token. Every bin is at last downsized to the least length that holds its
contents. The packing is also made with each length preferred for all bins, and the
one of the least total cost is taken.

The cost of a bin of length c is OVERHEAD + c + c*c / QUADRATIC: a fixed part,
the tokens, and attention.

Defined results: a text that is null or empty has no tokens and no piece.
Repeated rows and null ids are packed row by row. Ids that aren't whole numbers are
returned as strings. Ties go by id (null last) and piece; which shard a row is in follows
from its place in the table. An empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_kind, id_of, written
from .tokens import VOCABULARY, with_counts

LENGTHS: Sequence[int] = (1024, 2048, 4096, 8192)
#: A shard's tokens and pieces, about; it is packed in one task.
SHARD_TOKENS, SHARD_PIECES = 1 << 24, 1 << 18
#: Tasks that the shards are spread over at most.
TASKS = 20_000
OVERHEAD = 256
QUADRATIC = 32768


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def cheapest(size: int, left: Sequence[int], have: int, lengths: Sequence[int], costs: Sequence[float]) -> int:
    """The length to open for a piece of *size*: each that holds it is filled with the largest pieces that fit, of
    which *left* has the number of each size and *have* a bit for each size there is; the least cost per token wins,
    of equals the smallest."""
    best = None
    for c in lengths:
        if c < size:
            continue
        room, most = c - size, size
        while room:
            most = (have & ((2 << min(room, most)) - 1)).bit_length() - 1
            if most < 1:
                break
            room -= most * min(left[most], room // most)
            most -= 1
        used = c - room
        rate = next(p for x, p in zip(lengths, costs) if x >= used) / used
        if best is None or rate < best[0]:
            best = rate, c
    return best[1]


def best_fit(sizes: Sequence[int], lengths: Sequence[int], preferred: int | None = None) -> tuple[list[int], list[int]]:
    """(bin of each size, downsized length of each bin); sizes are falling and none is above the largest length.

    Without a *preferred* length that of each bin is chosen when it is opened.
    """
    lengths = sorted(lengths)
    costs = [cost(c) for c in lengths]
    opens = [max(c, preferred or 0) for c in lengths]
    left, have = [0] * (lengths[-1] + 1), 0
    if preferred is None:
        for size in sizes:
            left[size] += 1
            have |= 1 << size
    rooms: dict[int, list[int]] = {}
    mask, bins, used = 0, [], []
    for size in sizes:
        if preferred is None:
            left[size] -= 1
            if not left[size]:
                have &= ~(1 << size)
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            used[b] += size
            room -= size
        else:
            b = len(used)
            used.append(size)
            room = (cheapest(size, left, have, lengths, costs) if preferred is None else opens[int(np.searchsorted(lengths, size))]) - size
        bins.append(b)
        if room:
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room
    at = np.searchsorted(lengths, used)
    return bins, [lengths[i] for i in at]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int]]:
    """The cheapest of the packings with lengths chosen bin by bin and with each preferred length, the first of equals."""
    best = None
    for p in (None, *sorted(lengths, key=lambda c: (cost(c) / c, c))):
        found = best_fit(sizes, lengths, p)
        total = sum(map(cost, found[1]))
        if best is None or total < best[0]:
            best = (total, found)
    return best[1]


def _pack_shard(lengths: Sequence[int]):
    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        n = part.column("n_tokens").to_numpy()
        bins, sizes = pack(n.tolist(), lengths)
        at = np.asarray(bins, np.int64)
        # The tokens before each piece in its bin: pieces are in order within every bin.
        order = np.argsort(at, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        position = np.empty(len(n), np.int32)
        position[order] = before - np.repeat(before[first], np.diff(np.append(first, len(n))))
        new = {"bin": pa.array(at), "length": pa.array(np.asarray(sizes, np.int32)[at]), "position": pa.array(position)}
        return pa.table({c: new[c] if c in new else part.column(c) for c in ("shard", "bin", "length", "position", "doc_id", "piece", "start", "n_tokens")})

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard_tokens: int = SHARD_TOKENS, shard_pieces: int = SHARD_PIECES, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: its bin (shard, bin), the bin's length, the piece's position there, and what it holds
    (doc_id, piece, and start and n_tokens in the document's tokens)."""
    most, kind = max(lengths), id_kind(docs, id_col)
    texts = docs.select(id_of(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    slim = written(with_counts(texts, "text", "n", vocabulary).select("doc_id", "n").where("n > 0").withColumn("row", F.monotonically_increasing_id()), "lengths")
    total, pieces = slim.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr(f"(n - 1) div {most} + 1")), F.lit(0))).first()
    shards = max(1, -(-total // shard_tokens), -(-pieces // shard_pieces))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}")))
    # By row, not by id, so that an id that many rows repeat, or none have, doesn't fill one shard.
    pieces = slim.withColumn("piece", piece).select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens")
    )
    schema = f"shard long, bin long, length int, position int, doc_id {kind}, piece long, start long, n_tokens int"
    # As many partitions as shards: adaptive execution would join them by their bytes, which are few for the work.
    return pieces.repartition(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(_pack_shard(lengths), schema)
