"""Quality rules whose cutoffs are read from quantile sketches of each language and source.

A sketch is a histogram with buckets of a fixed relative width (32 to an octave,
so a quantile is at most 1/32 off). Sketches merge by adding counts, in any order
and with the same result, so a language's sketch is the sum of its sources'.

    features(docs)            -> one row for each document with its counts
    sketches(features)        -> lang, source, metric, bucket, n
    thresholds(sketches)      -> lang, source and the cutoff of each metric
    judged(features, cutoffs) -> features with base_failed, kept

No cutoff is fixed. A group's own cutoff of a metric is a high quantile of its documents and some times that quantile's
distance from the median (LEVELS); where few documents have any of what the metric counts, so that this is next to
nothing, it is where the group's documents that have some begin (the FLOOR percent least of them may
be kept). A group's cutoff is drawn towards its language's, and a language's towards that of the whole corpus, as
if PRIOR more documents had said so: groups of any size follow one rule.

Everything is DataFrame and SQL expressions; no Python runs on executors.

Edge cases: a null or empty text has no words and fails the base rule; null lang
or source form groups of their own; an empty table gives an empty result; equal rows get equal verdicts; very
long texts are counted whole (n log n in their words); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

#: metric -> percent of a group's documents that a cutoff starts from, and times the distance from the median that it lies beyond.
LEVELS = {"symbols": (90, 1), "dup_lines": (99, 1), "repeats": (99, 1), "word_length": (90, 2)}
FLOOR, PRIOR = 5, 100

METRICS = {
    "symbols": "1000000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts of its text column; helper columns start with an underscore and go again."""
    n = "size(_w)"
    return (
        df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_w", common.words(F.col("_t")))
        .withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
        # a window's hash at each position; the last two positions begin none
        .withColumn("_h", F.expr(f"case when {n} < 3 then array() else slice(transform(_w, (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))), 1, {n} - 2) end"))
        .withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h as h, i as i))) end"))
        .withColumn("_p", F.expr("sort_array(transform(filter(_s, (e, k) -> get(_s, k - 1).h = e.h or get(_s, k + 1).h = e.h), e -> e.i))"))
        .withColumn("n_words", F.expr(f"cast({n} as bigint)"))
        .withColumn("word_chars", F.expr("cast(length(array_join(_w, '')) as bigint)"))
        .withColumn("n_symbols", F.expr("cast(length(regexp_replace(_t, '[^#*$%&|<>]+', '')) as bigint)"))
        .withColumn("n_lines", F.expr("cast(size(_l) as bigint)"))
        .withColumn("n_dup_lines", F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"))
        # each repeated window covers its words up to the next one's start
        .withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0L, (a, b) -> a + b), 0L)"))
        .drop("_t", "_w", "_l", "_h", "_s", "_p")
        .withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    )


def features(docs: DataFrame) -> DataFrame:
    """The counts of every document, stored: what reads them must not count again for each of its own filters."""
    return common.stored(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")


def sketches(counted: DataFrame) -> DataFrame:
    """Counts for each lang, source, metric and bucket, over the documents that pass the base rule."""
    each = ", ".join(f"'{m}', {e}" for m, e in METRICS.items())
    octave = "length(bin(v)) - 1"
    return (
        counted.filter("not base_failed")
        .selectExpr("lang", "source", f"stack({len(METRICS)}, {each}) as (metric, v)")
        .withColumn("bucket", F.expr(f"cast(case when v < 32 then v else ({octave} - 4) * 32 + shiftright(v, {octave} - 5) - 32 end as int)"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sum of sketches that agree on keys."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str, levels: dict[str, tuple[int, int]] = LEVELS, floor: int = FLOOR) -> DataFrame:
    """Each group's own cutoff of each metric, and n: its documents."""
    by = ", ".join([*keys, "metric"])
    edge = lambda b: f"case when {b} < 32 then cast({b} as bigint) else shiftleft(cast({b} % 32 + 32 as bigint), cast({b} div 32 - 1 as int)) end"
    level = "case metric " + " ".join(f"when '{m}' then {q}" for m, (q, _) in levels.items()) + " end"
    reach = "case metric " + " ".join(f"when '{m}' then {r}" for m, (_, r) in levels.items()) + " end"
    at = lambda q: f"min(case when 100 * upto >= {q} * total then top end)"
    some = f"min(case when bucket > 0 and 100 * (upto - zeros) >= {floor} * (total - zeros) then edge - 1 end)"
    return (
        sketch.selectExpr("*", f"{edge('bucket')} as edge", f"{edge('(bucket + 1)')} - 1 as top", f"sum(n) over (partition by {by} order by bucket) as upto")
        .selectExpr("*", f"sum(n) over (partition by {by}) as total", f"sum(if(bucket = 0, n, 0)) over (partition by {by}) as zeros")
        .groupBy(*keys, "metric")
        .agg(F.expr(f"{at(level)} + {reach} * ({at(level)} - {at(50)})").alias("fence"), F.expr(some).alias("some"), F.max("total").alias("n"))
        .selectExpr(*keys, "metric", "greatest(fence, coalesce(some, 0)) as fence", "n")
    )


def thresholds(sketch: DataFrame, levels: dict[str, tuple[int, int]] = LEVELS, floor: int = FLOOR, prior: int = PRIOR) -> DataFrame:
    """One row for each lang and source with cut_<metric>."""
    drawn = lambda own, towards: F.expr(f"(n * {own} + {prior} * {towards}) div (n + {prior})")
    whole = fences(merged(sketch), levels=levels, floor=floor).selectExpr("metric as _metric", "fence as _fence")
    lang = fences(merged(sketch, "lang"), "lang", levels=levels, floor=floor)
    # one row for each metric, and for each language and metric
    lang = lang.join(whole, lang.metric == whole._metric).select(F.col("lang").alias("_lang"), "_metric", drawn("fence", "_fence").alias("_fence"))
    own = fences(sketch, "lang", "source", levels=levels, floor=floor)
    joined = own.join(lang, own.lang.eqNullSafe(lang._lang) & (own.metric == lang._metric)).withColumn("cut", drawn("fence", "_fence"))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("cut"))).alias(f"cut_{m}") for m in levels])


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """counted with kept: the base rule held and no metric lies above its group's cutoff."""
    right = cuts.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    kept = " and ".join(f"{e} <= coalesce(cut_{m}, 0)" for m, e in METRICS.items())
    return (
        counted.join(right, counted.lang.eqNullSafe(right._lang) & counted.source.eqNullSafe(right._source), "left")
        .withColumn("kept", F.expr(f"not base_failed and {kept}"))
        .drop("_lang", "_source", *[f"cut_{m}" for m in METRICS])
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every document."""
    counted = features(docs)
    return judged(counted, thresholds(sketches(counted)))


def kept(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with the columns they came with."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = common.stored(with_counts(packed.selectExpr("row", "row.lang as lang", "row.source as source", "row.text as text")).drop("text"), "quality")
    return judged(counted, thresholds(sketches(counted))).filter("kept").select("row.*")
