"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id. Tokens are summed by source and the
hash's upper 12 bits; in this histogram the bucket in which a source's budget
runs out is found by a running sum, and only that bucket is divided again by
the next 12 bits, until the hash is used up. A source's documents below its
threshold are kept: one filter, no sort of documents. Budgets are nested, and so
are the documents of the tiers, since a larger budget has a higher threshold.

A source's budget is its weight's part of the total, which is a share of the
corpus's tokens. A source with fewer tokens gives all it has, and what it leaves
of its budget goes to the others by their weights, so that the total is met. A
source of weight 0 has no budget.
Tokens are those of a tokenizer's vocabulary (tokens.py). Documents with
equal hashes (repeated ids) are taken together or not at all.

Defined results: a null source is a source of its own; a null text has 0
tokens; a null id hashes as an empty string; an empty table gives none. Other
columns pass through; one named like the tier stays under a free name, _tier.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, fresh, with_columns, written
from .tokens import VOCABULARY, with_counts

#: Relative weights of the sources; others weigh DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, int] = {"src0": 4}
DEFAULT_WEIGHT = 1
#: The total as percent of the corpus's tokens, and the nested tiers as percent of it.
TOTAL_PERCENT = 50
TIERS: Sequence[int] = (25, 50, 100)
SEED = 17
STEP, LEVELS = 12, 4


def hash48(id_col: str = "doc_id", seed: int = SEED) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _source(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))


def budgets(per: DataFrame, total_percent: int) -> DataFrame:
    """(source, budget) of *per* (source, tokens, weight): the common rate is raised until no further source runs short."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    found = per.agg(F.sum("tokens"), F.sum("weight")).first()
    total, short, weights = (found[0] or 0) * total_percent // 100, 0, found[1] or 0
    while True:
        rest = total - short
        is_short = (F.col("weight") > 0) & (exact("tokens") * F.lit(weights) <= exact("weight") * F.lit(rest))
        found = per.agg(F.sum(F.when(is_short, F.col("tokens"))), F.sum(F.when(~is_short, F.col("weight")))).first()
        new = found[0] or 0, found[1] or 0
        if not new[1] or new == (short, weights):
            break
        short, weights = new
    part = F.lit(0) if not weights else F.floor(exact("weight") * F.lit(rest) / F.lit(weights))
    return per.select("source", F.when(is_short, F.col("tokens")).otherwise(part).cast("long").alias("budget"))


def thresholds(slim: DataFrame, weights: Mapping[str, int], default: int, total_percent: int, tiers: Sequence[int]) -> DataFrame:
    """(source, tier, threshold) of *slim* (source, h, tokens): hashes below the threshold are in the tier."""
    first = written(slim.groupBy("source", F.shiftright("h", STEP * (LEVELS - 1)).alias("bucket")).agg(F.sum("tokens").alias("tokens")), "histogram")
    weight = F.lit(default)
    for name, w in weights.items():
        weight = F.when(F.col("source") == "=" + name, F.lit(int(w))).otherwise(weight)
    per = written(first.groupBy("source").agg(F.sum("tokens").alias("tokens")).withColumn("weight", weight.cast("long")), "sources")
    budget = budgets(per, total_percent)
    bound = budget.select("source", F.posexplode(F.array(*[F.expr(f"budget * {int(t)} div 100") for t in tiers])).alias("tier", "rest")).select("source", F.lit(0).cast("long").alias("prefix"), (F.col("tier") + 1).alias("tier"), "rest")
    done = []
    for level in range(LEVELS):
        shift = STEP * (LEVELS - 1 - level)
        if level:
            where = bound.select("source", "prefix").distinct()  # at most sources x tiers rows
            part = slim.withColumn("prefix", F.shiftright("h", shift + STEP)).join(few(where, where.count()), ["source", "prefix"])
            hist = part.groupBy("source", "prefix", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        else:
            hist = first.withColumn("prefix", F.lit(0).cast("long"))
        run = Window.partitionBy("source", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("sum", F.sum("tokens").over(run))
        over = F.when(F.col("sum") > F.col("rest"), F.struct("bucket", (F.col("sum") - F.col("tokens")).alias("before")))
        found = bound.join(hist, ["source", "prefix"]).groupBy("source", "tier", "rest").agg(F.min(over).alias("at"))
        found = written(found.select("source", "tier", F.col("at.bucket").alias("prefix"), (F.col("rest") - F.col("at.before")).alias("rest")), "bounds")
        done.append(found.where("prefix is null").select("source", "tier", F.lit(1 << STEP * LEVELS).cast("long").alias("threshold")))
        bound = found.where("prefix is not null").select("source", "prefix", "tier", "rest")
    out = bound.select("source", "tier", F.col("prefix").alias("threshold"))
    for part in done:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, total_percent: int = TOTAL_PERCENT, tiers: Sequence[int] = TIERS, tier_name: str | None = "tier", tokens_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of *docs* within the largest budget, with the least tier that holds each as *tier_name* (none if None).

    Tokens are read from *tokens_col*, or counted in the texts where it is None.
    """
    if tokens_col is None:
        tokens_col = fresh(docs, "__tokens")
        counted = with_counts(docs.select(*{f"`{c}`": 0 for c in (id_col, source_col, text_col)}), text_col, tokens_col, vocabulary)
    else:
        counted = docs
    slim = written(counted.select(_source(source_col).alias("source"), hash48(id_col).alias("h"), F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)).alias("tokens")), "slim")
    cut = thresholds(slim, weights, default, total_percent, tiers).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("tier", "threshold"))).alias("cuts"))
    cut = written(cut, "thresholds")
    key, cuts, tier = fresh(docs, "__key"), fresh(docs, "__cuts"), fresh(docs, "__tier")
    cut = few(cut.select(F.col("source").alias(key), F.col("cuts").alias(cuts)), cut.count())
    joined = docs.join(cut, _source(source_col) == F.col(key)).withColumn(tier, F.expr(f"get(filter({cuts}, c -> c.threshold > {hash48_sql(id_col)}), 0).tier")).where(F.col(tier).isNotNull())
    return with_columns(joined, {tier_name: F.col(tier)} if tier_name else {}, drop=[key, cuts, tier])


def hash48_sql(id_col: str, seed: int = SEED) -> str:
    return f"cast(conv(substring(md5(concat('{seed}:', coalesce(cast(`{id_col}` as string), ''))), 1, 12), 16, 10) as bigint)"

