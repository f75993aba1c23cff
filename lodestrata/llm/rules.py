"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on a document's statistics, and rules
are tried in order; the first that holds rejects the document, and if none does
it is kept. A rule grows on two thirds of the labelled statistics not yet
covered, by the threshold with the most FOIL gain, until it covers no good
document; it is then pruned on the other third by dropping last conditions
while (rejected bad - rejected good) / all rejected doesn't fall. A rule that is there
less precise than *precision*, with one more error than was seen, isn't taken, and the
bad documents that it covers are set aside. Learning ends when no bad documents are
left; there is no fixed number of rules. The list is emitted as one Spark
conditional expression.

Defined results: a null or empty text has statistics of 0. Labels with a null
id or quality are left out; of labels that repeat an id the lowest quality
counts. Without labelled documents the list is empty and keeps all. Ties
between thresholds go to the first statistic by name and the lower threshold.
Ids of the labels are compared under the type of the documents' ids. Repeated rows
are judged alike. Other columns pass through; one named like a new column stays under a
free name, _rule or _stats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, id_kind, id_of, text_slices, with_columns
from .ordinal import sample
from .vec import VISIBLE, bags, run_hashes, runs, doc_of

STATISTICS = ("chars", "digit_share", "distinct_words", "echo_share", "letter_share", "mean_word", "repeated_lines", "symbol_share", "upper_share", "words")
#: Labelled documents of each quality that learning takes at most.
PER_CLASS = 3000
PRECISION = 0.9
#: Conditions of a rule at most, so that people can read it.
MAX_CONDITIONS = 4

_LINE = np.ones(256, bool)
_LINE[10] = False
_UPPER, _DIGIT, _LETTER, _SYMBOL, _LEAD = (np.zeros(256, np.int32) for _ in range(5))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = 1
for _c in b"#$%&*+/<=>@[\\]^_`{|}~!":
    _SYMBOL[_c] = 1
_LEAD[:128] = _LEAD[192:] = 1
#: Two counts in the halves of each word.
_PACKED = [a.astype(np.uint64) | b.astype(np.uint64) << np.uint64(32) for a, b in ((_LEAD, _LETTER), (_SYMBOL, _UPPER), (_DIGIT, _DIGIT))]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text; shares are of its characters, words or lines."""
    n = len(offsets) - 1
    sums = [np.append(np.uint64(0), np.cumsum(kind[data], dtype=np.uint64)) for kind in _PACKED]
    low = lambda x: (x & np.uint64((1 << 32) - 1)).astype(np.int64)
    high = lambda x: (x >> np.uint64(32)).astype(np.int64)
    total = lambda half, i: np.diff(half(sums[i][offsets])).astype(float)
    lead = lambda at: low(sums[0][at])
    chars, letters, symbols, uppers, digits = total(low, 0), total(high, 0), total(low, 1), total(high, 1), total(low, 2)
    size = np.maximum(chars, 1)
    starts, ends = runs(data, offsets, VISIBLE)
    doc = doc_of(starts, offsets)
    h = run_hashes(data, starts, ends)
    n_words = np.bincount(doc, minlength=n).astype(float)
    per_word = np.maximum(n_words, 1)
    distinct = np.bincount(bags(h, doc)[0], minlength=n) / per_word
    echo = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / per_word
    ls, le = runs(data, offsets, _LINE)
    ld = doc_of(ls, offsets)
    n_lines = np.bincount(ld, minlength=n)
    lines = np.bincount(bags(run_hashes(data, ls, le), ld)[0], minlength=n)
    return {
        "chars": chars,
        "digit_share": digits / size,
        "distinct_words": distinct,
        "echo_share": echo,
        "letter_share": letters / size,
        "mean_word": np.bincount(doc, weights=lead(ends) - lead(starts), minlength=n) / per_word,
        "repeated_lines": (n_lines - lines) / np.maximum(n_lines, 1),
        "symbol_share": symbols / size,
        "upper_share": uppers / size,
        "words": n_words,
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.threshold if self.above else x[self.statistic] <= self.threshold

    def column(self, stats: str) -> Column:
        c = F.col(stats)[self.statistic]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The condition with the most FOIL gain on the rows of *x*, of which *bad* are to be covered."""
    p0, n0 = bad.sum(), (~bad).sum()
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for name in STATISTICS:
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, m = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, pp, nn in ((False, p, m), (True, p0 - p, n0 - m)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
            i = int(np.argmax(g))
            if g[i] > gain:
                lo, hi = v[cut[i]], v[cut[i] + 1]
                mid = float(f"{(lo + hi) / 2:.4g}")
                best, gain = Condition(name, above, mid if lo <= mid < hi else float(lo)), g[i]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """The ordered rules that reject, from statistics and whether each row is bad; rows i with i % 3 == 2 prune."""
    rules: list[Rule] = []
    rest = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    take = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
    while (rest & bad & ~third).any():
        g, gb = take(rest & ~third)
        rule: Rule = ()
        now = np.ones(len(gb), bool)
        while len(rule) < MAX_CONDITIONS and gb[now].any() and (~gb[now]).any():
            c = _best({k: v[now] for k, v in g.items()}, gb[now])
            if c is None:
                break
            rule += (c,)
            now = now & c.holds(g)
        if not rule:  # what is left can't be told from good documents, or there are none of them
            break
        q, qb = take(rest & third)

        def value(r: Rule) -> float:
            hit = covers(r, q)
            return (qb[hit].sum() - (~qb[hit]).sum()) / hit.sum() if hit.any() else -1

        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (value(r), -len(r)))
        hit = covers(rule, q)
        covered = covers(rule, x)
        if qb[hit].sum() < precision * (hit.sum() + 1):
            rest &= ~(covered & bad)
            continue
        rules.append(rule)
        rest &= ~covered
    return rules


def expression(rules: list[Rule], stats: str) -> Column:
    """The number, from 1, of the first rule that holds on the struct column *stats*; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for i, rule in enumerate(rules, 1):
        all_of = rule[0].column(stats)
        for c in rule[1:]:
            all_of = all_of & c.column(stats)
        out = F.when(all_of, i) if out is None else out.when(all_of, i)
    return out.otherwise(0)


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics(text: pa.Array) -> pa.Array:
    parts = [statistics(d, o) for d, o, _ in text_slices(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[s] for p in parts]) if parts else np.zeros(0)) for s in STATISTICS], names=list(STATISTICS))


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """*docs* with the statistics of each text as a struct."""
    bounded(docs)
    return with_columns(docs, {name: _statistics.asNondeterministic()(F.col(f"`{text_col}`"))})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, precision: float = PRECISION) -> list[Rule]:
    """Learn from at most *per_class* labelled documents of each quality, those whose ids hash lowest."""
    kind = id_kind(docs, id_col)
    good = labels.where(F.col("quality").isNotNull()).groupBy(id_of(labels, "doc_id", kind).alias("id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("good")).where("id is not null")
    chosen = F.broadcast(sample(good, per_class, 2, "good"))  # 2 * per_class rows at most
    rows = docs.select(id_of(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id")
    got = with_statistics(rows, "stats").select("id", "good", F.xxhash64("id").alias("h"), "stats.*").toPandas().sort_values(["h", "id", *STATISTICS]).drop_duplicates("id")
    return learn({s: got[s].to_numpy(float) for s in STATISTICS}, got["good"].to_numpy(int) == 0, precision)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text", rule_name: str = "rule", stats_name: str = "stats") -> DataFrame:
    """*docs* with their statistics and the number of the rule that rejects them, 0 for none."""
    out = with_statistics(docs, stats_name, text_col)
    return with_columns(out, {rule_name: expression(rules, f"`{stats_name}`")})


def select_documents(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of *docs* that no rule rejects."""
    stats, rule = fresh(docs, "__stats"), fresh(docs, "__rule")
    return judged(docs, rules, text_col, rule, stats).where(F.col(rule) == 0).drop(stats, rule)
