"""Links between documents whose signatures share a band, without a pair for every two members of a bucket.

A bucket is the documents with one band key. Every member is verified against
the smallest id of its bucket, its head; the links so found, and those of equal
documents, give components. Members that are then outside their head's component
are held against those inside it, unless their distances to the head, which are
known, differ by more than a link allows: one minus the (weighted) Jaccard
similarity is a metric, so no link is lost by that. What is still outside is a
smaller bucket, with a head of its own, of the next round. What is outside in the last of ROUNDS,
which only buckets of many unlike documents reach, is held against each
other. Any two documents that share a band and reach the threshold so end in one
component. Two members of one component needn't have been held against each other:
whoever wants every link has to look inside the components (fingerprints.class_links()).

No bucket is gathered into a row or a task: heads are aggregated before the
shuffle, and members are joined to them, which adaptive execution splits where
a bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Similarities are sums of whole numbers, divided once; what differs by less is equal.
EPSILON = 1e-9
ROUNDS = 3
#: Parts of the largest distance of a link by which distances to a head are matched.
STEPS = 4


class Links(NamedTuple):
    equal: DataFrame  # (rep, id): id has the same content as rep, the smallest id that has it
    pairs: DataFrame  # (a, b, jaccard), a < b: links between such smallest ids that were verified on the way, not all there are
    labels: DataFrame  # (id, label) of every document with a link or an equal
    bags: DataFrame  # (id, bag) of the smallest ids that share a band with another


def similar(pairs: DataFrame, bag: DataFrame, verify, kind: str) -> DataFrame:
    """(a, b, jaccard) of *pairs* (a, b) by their contents in *bag* (id, bag)."""
    left = bag.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(verify, f"a {kind}, b {kind}, jaccard double")


def linked(sketch: DataFrame, bags_of: Callable[[DataFrame], DataFrame], verify, threshold: float, kind: str) -> Links:
    """The links in *sketch* (id, same, keys): *same* is a hash of the whole content, *keys* are those of its bands.

    *bags_of* gives (id, bag) of the ids in a table (id); *verify* maps Arrow
    batches (a, b, bag_a, bag_b) to (a, b, jaccard); *kind* is the type of the ids.
    """
    named = sketch.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last")
    equal = written(sketch.select("id", "same").join(named.select("same", "rep"), "same").where("id <> rep").select("rep", "id").distinct(), "equal")
    # Rows that repeat an id may have several contents, each of which is in the buckets.
    single = written(sketch.groupBy("same").agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("id")).select("id", "keys"), "single")
    member = single.select("id", F.explode("keys").alias("key"))
    head = member.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").select("key", "a")
    held = written(member.join(head, "key").where("id <> a").select("key", "a", F.col("id").alias("b")), "members")
    star = held.select("a", "b").distinct()
    ids = star.select("a").unionByName(star.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("id"))
    bag = written(bags_of(ids), "bags")
    label = equal.select("id", F.col("rep").alias("label")).unionByName(equal.select(F.col("rep").alias("id"), F.col("rep").alias("label")).distinct())
    label = label.groupBy("id").agg(F.min("label").alias("label"))
    scored = None

    def score(pairs: DataFrame) -> bool:
        """Verify those of *pairs* that aren't yet, and let the labels follow; whether any of them is a link."""
        nonlocal scored, label
        fresh = pairs if scored is None else pairs.join(scored, ["a", "b"], "left_anti")
        fresh = written(similar(fresh, bag, verify, kind), "scored")
        scored = fresh if scored is None else scored.unionByName(fresh)
        links = fresh.where(F.col("jaccard") >= threshold).select("a", "b")
        if links.isEmpty():
            return False
        old = label.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
        label = components(links.unionByName(old))
        return True

    def outsiders(active: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, id, label, distance) of the members outside and inside their head's component."""
        named = active.join(scored, ["a", "b"])
        for c in "ab":
            named = named.join(label.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
        of = {c: F.coalesce(f"label_{c}", c) for c in "ab"}
        named = named.select("key", F.col("b").alias("id"), of["b"].alias("label"), (1 - F.col("jaccard")).alias("distance"), (of["a"] == of["b"]).alias("inside"))
        return named.where("not inside").drop("inside"), named.where("inside").drop("inside")

    def near(xs: DataFrame, ys: DataFrame) -> DataFrame:
        """(a, b): those of a bucket in *xs* with those in *ys* of another component that may be linked, by their distances to its head."""
        most, step = 1 - threshold + EPSILON, (1 - threshold + EPSILON) / STEPS
        level = lambda c: F.floor(c / F.lit(step))
        xs = xs.select("key", F.col("id").alias("x"), F.col("label").alias("label_x"), F.col("distance").alias("distance_x"))
        xs = xs.withColumn("level", F.explode(F.sequence(level(F.col("distance_x") - most), level(F.col("distance_x") + most))))
        got = xs.join(ys.withColumn("level", level(F.col("distance"))), ["key", "level"])
        got = got.where((F.col("label") != F.col("label_x")) & (F.abs(F.col("distance") - F.col("distance_x")) <= most))
        return got.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()

    score(star)
    for left in reversed(range(ROUNDS)):
        outside, inside = outsiders(held)
        outside = written(outside, "outside")
        if outside.isEmpty():
            break
        pairs = near(outside, inside.join(outside.select("key").distinct(), "key", "left_semi"))
        if left:
            head = outside.groupBy("key").agg(F.min("id").alias("a"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key", "a")
            held = written(outside.join(head, "key").where("id <> a").select("key", "a", F.col("id").alias("b")), "members")
            pairs = pairs.unionByName(held.select("a", "b"))
        else:
            pairs = pairs.unionByName(near(outside, outside))
        score(pairs.distinct())
    return Links(equal, scored.where(F.col("jaccard") >= threshold), label, bag)
