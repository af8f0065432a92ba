import re
from collections import Counter

from vaultlens.llm import quality

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(crowded):
    rows = quality.verdicts(crowded).collect()
    want = [(r.doc_id, *(c := brute(r.text)), c[0] < 50 or 2 * c[4] > c[0]) for r in crowded.collect()]
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert not any(r.kept and r.base_failed for r in rows)


def test_adapts_to_the_source(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    piped = " | ".join(clean.split(" "))
    rows = [(k, clean, "en", "plain") for k in range(300)] + [(1000 + k, piped, "en", "plain") for k in range(5)]
    rows += [(2000 + k, clean.replace("worda", f"w{k}a"), "en", "small") for k in range(10)] + [(3000, piped, "en", "small")]
    found = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[k] for k in range(300)) and all(found[2000 + k] for k in range(10))
    assert not any(found[1000 + k] for k in range(5)) and not found[3000]


def test_sketches_merge_to_the_whole(crowded):
    sketch = quality.sketches(quality.features(crowded))
    whole = {(r.metric, r.bucket): r.n for r in quality.merged(sketch).collect()}
    one = {(r.metric, r.bucket): r.n for r in quality.merged(quality.sketches(quality.features(crowded.drop("source").selectExpr("*", "'x' as source")))).collect()}
    assert whole == one


def test_kept_rows_are_whole(crowded, nothing):
    kept = quality.kept(crowded)
    assert kept.columns == crowded.columns
    want = sorted(r.doc_id for r in quality.verdicts(crowded).collect() if r.kept)
    assert sorted(r.doc_id for r in kept.collect()) == want and want
    assert quality.kept(nothing).count() == 0 and quality.verdicts(nothing).count() == 0


def percentile(values, q):
    values = sorted(values)
    return values[max(0, -(-q * len(values) // 100) - 1)]


def test_cutoffs_come_from_each_groups_documents(spark):
    """Against quantiles of the values themselves, which a sketch holds within 1/32."""
    import random

    rng, rows = random.Random(3), []
    for k in range(3000):
        words = ["x" * max(2, round(rng.gauss(5 + (k % 4), 0.4))) + rng.choice("abcdef") for _ in range(80)]
        words = [w + "%" * (rng.random() < 0.03 * (1 + k % 3)) for w in words]
        rows.append((k, " ".join(words), "abcd"[k % 4], f"s{k % 3}"))
    features = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    cuts = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(features), prior=0).collect()}
    groups = {}
    for r in features.collect():
        groups.setdefault((r.lang, r.source), []).append((1000000 * r.n_symbols // r.word_chars, 1000 * r.word_chars // r.n_words))
    for key, values in groups.items():
        for at, metric in enumerate(("symbols", "word_length")):
            level, reach = quality.LEVELS[metric]
            high, middle = (percentile([v[at] for v in values], q) for q in (level, 50))
            want = high + reach * (high - middle)
            assert abs(cuts[key][f"cut_{metric}"] - want) <= want * (1 + 2 * reach) / 32
    for metric in ("symbols", "word_length"):
        assert len({c[f"cut_{metric}"] for c in cuts.values()}) > 3


def test_small_groups_follow_their_language_by_weight(spark):
    sketch = spark.createDataFrame([("en", "big", "word_length", 150, 900), ("en", "small", "word_length", 190, 1)], "lang string, source string, metric string, bucket int, n long")
    cuts = {r.source: r.cut_word_length for r in quality.thresholds(sketch).collect()}
    alone = {r.source: r.cut_word_length for r in quality.thresholds(sketch, prior=0).collect()}
    assert alone["big"] < cuts["small"] < alone["small"] and cuts["small"] - alone["big"] < (alone["small"] - alone["big"]) / 20
