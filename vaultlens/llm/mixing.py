"""Mixing sources to target weights by subset-sum budget fitting.

    sizes(docs)            -> doc_id, source, size (words)
    targets(sizes)         -> each source's size and target words
    fitted(cells, targets) -> how many copies of documents of each exact length a source takes
    mixed(docs)            -> doc_id, source, size, source_size, target, taken

Documents are counted by exact length. A source's target is first given to every length in proportion;
what that leaves (less than one document of each length) is filled greedily from
long to short until at most WINDOW words are open, and a bounded-knapsack
dynamic programme over the lengths' remaining counts then finds the nearest sum, below or above;
where one more copy of each document gives no exact sum, further ones (up to the cap) join in. If the sum found isn't as near as the
lengths' common divisor allows, the programme gets a window eight times as wide, up to the whole target: the
result is always the nearest sum that there is.
A length's copies are dealt evenly over its documents; which of them get one more is decided by seeded hash.

What meets in one task is the histogram of one source (one row for each distinct
length: bounded by the longest text, not by the number of documents). Rows of one
source and length are dealt over hash buckets, so copies don't meet in one task.

Edge cases: null text has size 0; null source is a source, last in order; a
source without words gets target 0 and takes nothing; documents of size 0 are
taken 0 words; a document's repeats never exceed the cap; equal rows (same id,
source and size) are interchangeable; an empty table gives no rows; extra columns
are ignored. Where rows become repeated rows, those alike in id and text are taken in the order of the hash of all their columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 11
#: Words that the dynamic programme fits at first, and hash buckets for the documents of one length.
WINDOW, BUCKETS = 1 << 16, 256


def sizes(docs: DataFrame, seed: int = SEED, whole: bool = False) -> DataFrame:
    """Each document's source, words, seeded hash and bucket; whole: and the document as struct row."""
    n = F.size(common.words(F.col("text"))).cast("long")
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        n.alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
        *([F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("alike")] if whole else []),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """no_source, source, source_size, target: one row for each source, from counts by length.

    A level L gives every source min(cap * size, L * weight) words and all of them
    together the corpus's words; sources that reach their cap first come first in
    the order of cap * size / weight, so running sums along it give L.
    """
    order = "no_source, source"
    pick = "case pmod(row_number() over (order by no_source, source) - 1, {}) {} end".format(len(weights), " ".join(f"when {i} then {w}" for i, w in enumerate(weights)))
    per = cells.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    per = per.selectExpr("*", f"{pick} as weight", "sum(source_size) over () as total")
    run = f"over (order by source_size / weight, {order} rows between unbounded preceding and 1 preceding)"
    per = per.selectExpr("*", f"total - {cap} * coalesce(sum(source_size) {run}, 0) as open", f"sum(weight) over () - coalesce(sum(weight) {run}, 0) as rest")
    # the level is the first at which the next source isn't held by its cap
    held = f"{cap} * source_size * rest < open * weight"
    level = f"min(case when not {held} then struct(source_size / weight, {order}, open / rest as level) end) over ()"
    target = f"if(source_size = 0, 0, least({cap} * source_size, level * weight))"
    return per.selectExpr("*", f"{level}.level as level").selectExpr("no_source", "source", "source_size", f"cast({target} as double) as target")


def _walk(lengths: np.ndarray, start: np.ndarray, limits: list[np.ndarray], open_: int) -> tuple[np.ndarray, int]:
    """start with what the bounded knapsack adds, and how far the sum stays from open_ words (either side).

    Sums that can be reached are bits of one number; each bundle of a power of two
    copies of a length shifts them. Bundles that reach nothing new are left out.
    limits: copies of each length, the later ones only if the earlier give no exact sum.
    """
    quota, mask, reach, steps = start.copy(), (1 << (2 * open_ + 1)) - 1, 1, []
    had = start
    for limit in limits:
        for i in np.argsort(lengths, kind="stable"):
            n, left, k = int(lengths[i]), int(limit[i] - had[i]), 1
            while 0 < n * k <= 2 * open_ and left > 0 and not reach >> open_ & 1:
                k = min(k, left)
                if (now := reach | reach << n * k & mask) != reach:
                    steps.append((i, k, n * k, reach))
                    reach = now
                left -= k
                k *= 2
        had = limit
    below = (reach & ((1 << (open_ + 1)) - 1)).bit_length() - 1
    above = reach >> open_
    above = open_ + (above & -above).bit_length() - 1 if above else 3 * open_ + 1
    at = below if open_ - below <= above - open_ else above
    gap = abs(at - open_)
    for i, k, words, before in reversed(steps):
        if not before >> at & 1:
            quota[i] += k
            at -= words
    return quota, gap


def fit(lengths: np.ndarray, counts: np.ndarray, target: int, cap: int = CAP, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take (a document at most cap times) so that their words come nearest to target."""
    lengths, counts = np.asarray(lengths, np.int64), np.where(np.asarray(lengths) > 0, counts, 0).astype(np.int64)
    whole, none = int((lengths * counts).sum()), np.zeros(len(lengths), np.int64)
    if target <= 0 or not whole:
        return none
    if target >= cap * whole:
        return counts * cap
    # one time more than the whole source fits, and all repeats
    limits = [counts * min(cap, target // whole + 1), counts * cap]
    # all sums are multiples of the lengths' common divisor
    over = target % (step := int(np.gcd.reduce(lengths[counts > 0])))
    possible, base, best = min(over, step - over), target, (none, target)
    while True:
        quota = np.array([int(c) * base // whole for c in counts], np.int64)
        open_ = target - int((quota * lengths).sum())
        for i in np.argsort(-lengths, kind="stable"):
            n = int(lengths[i])
            if open_ <= window:
                break
            if n > 0 and (k := min(int(limits[0][i] - quota[i]), (open_ - window + n - 1) // n, open_ // n)) > 0:
                quota[i] += k
                open_ -= k * n
        quota, gap = _walk(lengths, quota, limits, open_)
        best = (quota, gap) if gap < best[1] else best
        if best[1] <= possible or not base:
            return best[0]
        # a wider window, and less of the target given in proportion
        window = window * 8 if base < target else window
        base = max(0, target - window)


def fitted(cells: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """no_source, source, size, n, quota: the copies that a source takes of its n documents of a length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["quota"] = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(float(pdf["target"].iloc[0])), cap)
        return pdf[["no_source", "source", "size", "n", "quota"]]

    joined = cells.join(wanted, ["no_source", "source"]).filter("size > 0")
    return joined.groupBy("no_source", "source").applyInPandas(one, "no_source boolean, source string, size long, n long, quota long")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, whole: bool = False) -> DataFrame:
    """sizes(docs) with source_size, target and times: how often the mix takes the document.

    Documents without words are taken as often as their source is taken whole.
    """
    rows = common.stored(sizes(docs, seed), "mixing")
    by_bucket = rows.groupBy("no_source", "source", "size", "bucket").agg(F.count("*").alias("n"))
    cells = common.stored(by_bucket.groupBy("no_source", "source", "size").agg(F.sum("n").alias("n")), "mixing")
    wanted = common.stored(targets(cells, weights, cap), "mixing")
    quotas = fitted(cells, wanted, cap).selectExpr("no_source", "source", "size", "quota div n as each", "quota % n as rest")
    # the buckets of a length are emptied in turn; at most BUCKETS rows stand in one window
    before = "coalesce(sum(n) over (partition by no_source, source, size order by bucket rows between unbounded preceding and 1 preceding), 0)"
    buckets = by_bucket.selectExpr("*", f"{before} as before").join(quotas, ["no_source", "source", "size"])
    buckets = buckets.selectExpr("no_source", "source", "size", "bucket", "each", "greatest(0, least(n, rest - before)) as more")
    place = f"row_number() over (partition by no_source, source, size, bucket order by h, doc_id{', alike' if whole else ''})"
    passes = "if(source_size = 0, 0, cast(floor(target / source_size) as int))"
    dealt = sizes(docs, seed, whole=True) if whole else rows
    return (
        dealt.join(buckets, ["no_source", "source", "size", "bucket"], "left")
        .withColumn("more", F.expr(f"if({place} <= more, 1, 0)"))
        .join(wanted, ["no_source", "source"])
        .withColumn("times", F.expr(f"cast(if(size = 0, {passes}, coalesce(each + more, 0)) as int)"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes of it."""
    return taken(docs, weights, cap, seed).selectExpr("doc_id", "if(no_source, null, source) as source", "size", "source_size", "target", "size * times as taken")


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they came with."""
    rows = taken(docs, weights, cap, seed, whole=True).filter("times > 0")
    return rows.select(F.explode(F.expr("array_repeat(row, times)")).alias("row")).select("row.*")
