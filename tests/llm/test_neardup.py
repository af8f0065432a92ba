import random

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F
from vaultlens.llm import neardup

from .conftest import SCHEMA, prose


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute_kept(rows):
    """The smallest doc_id of each class of documents joined by similarity of at least 0.8."""
    held, root = [(k, brute_set(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if jaccard(x, y) >= 0.8:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {find(k) for k in root}


def edited(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts(seed=1):
    rng, rows = random.Random(seed), []
    for k in range(24):
        base = prose(rng, rng.randrange(120, 400))
        # from similar enough to hardly so, and a chain whose ends are less similar than its steps
        rows += [base, *[edited(rng, base, n) for n in (1, 3, 4, 8)], edited(rng, edited(rng, base, 2), 2)]
    return list(enumerate(rows))


def test_stage_drops_what_brute_force_links(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == brute_kept(rows)
    assert len(kept) < len(rows) / 2


def test_pairs_behind_the_stars_are_compared(spark):
    rows = texts(2)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    found = neardup.sets(docs)
    for stars in (0, 1):
        links = {(r.a, r.b) for r in neardup.linked(docs, found, stars=stars).collect()}
        of = {r.node: brute_set(rows[r.doc_id][1]) for r in found.collect()}
        assert links and all(jaccard(of[a], of[b]) >= 0.8 for a, b in links)


def test_none_and_wordless(spark, nothing):
    assert neardup.first_of_each(nothing).count() == 0
    docs = spark.createDataFrame([(2, None, "", "", 0), (1, " ", "", "", 0), (3, "one two", "", "", 0), (4, "ONE  two", "", "", 0)], SCHEMA)
    assert sorted(r.doc_id for r in neardup.first_of_each(docs).collect()) == [1, 3]


def brute_bits(words):
    """SimHash of a set of shingles."""
    hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42) for w in words]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_the_inverted_index_proposes_first(spark):
    rng = random.Random(3)
    bases = [prose(rng, 400) for _ in range(12)]
    rows = list(enumerate(t for b in bases for t in (b, edited(rng, b, 1), edited(rng, b, 1), edited(rng, b, 30))))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    found = neardup.sets(docs)
    of = {r.node: r.doc_id for r in found.collect()}
    held = {k: brute_set(t) for k, t in rows}
    bits = {k: brute_bits(x) for k, x in held.items()}
    assert {r.doc_id: r.fp % 2**64 for r in found.collect()} == bits
    near = {(a, b) for a in held for b in held if a < b and (bits[a] ^ bits[b]).bit_count() <= 4 and jaccard(held[a], held[b]) >= 0.8}
    # without bands nothing but the index can propose
    bare = found.withColumn("keys", F.array().cast("array<bigint>"))
    links = {tuple(sorted((of[r.a], of[r.b]))) for r in neardup.linked(docs, bare).collect()}
    assert links and links <= near and classes(held, links) == classes(held, near)


def classes(held, links):
    root = {k: k for k in held}
    for _ in held:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def crowd(n, seed=4):
    """Copies of one text, some near it, more of them similar to it but not near, and two near pairs apart from the rest."""
    rng = random.Random(seed)
    base = prose(rng, 200)
    rows = [edited(rng, base, 1 + k % 9) for k in range(n - 4)]
    for far in (edited(rng, base, 12), edited(rng, base, 12)):
        rows += [far, far + " end"]
    return list(enumerate(rows))


def test_a_large_group_makes_no_row_for_each_pair(spark, monkeypatch):
    rows, made, verified = crowd(300), [], neardup.verified
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    found = neardup.sets(docs)
    held, of = {k: brute_set(t) for k, t in rows}, {r.node: r.doc_id for r in found.collect()}
    links = {tuple(sorted((of[r.a], of[r.b]))) for r in neardup.linked(docs, found, stars=0).collect()}
    want = {(a, b) for a in held for b in held if a < b and jaccard(held[a], held[b]) >= 0.8}
    assert links <= want and classes(held, links) == classes(held, want)
    assert sum(made) < 300 * 299 / 8, made
    assert {r.doc_id for r in neardup.first_of_each(docs).collect()} == brute_kept(rows)


def test_blocks_compare_all_pairs(spark):
    rows = crowd(90)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    found = neardup.sets(docs)
    held, of = {k: brute_set(t) for k, t in rows}, {r.node: r.doc_id for r in found.collect()}
    members = found.select(F.lit(1).alias("key"), "node", "size", F.col("node").alias("root"))
    for room in (1024, 1 << 18):
        links = {tuple(sorted((of[r.a], of[r.b]))) for r in neardup.in_blocks(members, docs, found, room=room).collect()}
        want = {(a, b) for a in held for b in held if a < b and jaccard(held[a], held[b]) >= 0.8}
        assert links <= want and classes(held, links) == classes(held, want)
