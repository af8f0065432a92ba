import zlib
from collections import Counter

from vaultlens.llm import sharding


def test_law_of_rows_and_mixture(crowded):
    rows = sharding.assigned(crowded).collect()
    have = crowded.collect()
    text = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len(text(r)) + 1, zlib.crc32(text(r))) for r in have)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    total, sources = len(rows), Counter(r.source for r in rows)
    for s in range(16):
        mine = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(mine[x] - n * counts[s] / total) < 3 for x, n in sources.items())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.assigned(crowded.repartition(5)).collect()))


def test_few_rows_and_none(spark, nothing):
    few = spark.createDataFrame([(k, "x", "s") for k in range(3)], "doc_id long, text string, source string")
    assert Counter(r.slot for r in sharding.assigned(few).collect()) == {0: 3}
    assert sharding.assigned(nothing).count() == 0


def test_against_brute_force(crowded):
    """Ranks recomputed row by row: shuffled places within each source, then the order of fractional ranks, cut evenly."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    rows = crowded.select("doc_id", "text", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("h")).collect()
    low = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  nulls first
    raw = [(r.text or "").encode() for r in rows]
    order = [(r.h, low(r.doc_id), zlib.crc32(t), len(t)) for r, t in zip(rows, raw)]
    fraction = {}
    for source in {r.source for r in rows}:
        mine = sorted((k for k, r in enumerate(rows) if r.source == source), key=order.__getitem__)
        fraction.update({k: Fraction(2 * place + 1, 2 * len(mine)) for place, k in enumerate(mine)})
    placed = sorted(range(len(rows)), key=lambda k: (fraction[k], rows[k].source is None, rows[k].source or "", order[k]))
    n, want = len(rows), Counter()
    for place, k in enumerate(placed):
        shard = place * 16 // n
        want[rows[k].doc_id, zlib.crc32(raw[k]), shard, place - -(-shard * n // 16)] += 1
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assigned(crowded).collect()) == want


def test_very_long_texts(spark):
    rows = [(1, "x" * 3_000_000, "s"), (2, "é" * 1_000_000, "s"), (3, "", None)]
    have = {r.doc_id: (r.size, r.text_crc32) for r in sharding.assigned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert have == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t, _ in rows}
