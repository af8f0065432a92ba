import random

import numpy as np
import pytest
import xxhash

from vaultlens.llm import simhash


def brute_fingerprint(text, shingle=4):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_classes(crowded):
    rows = simhash.near_duplicates(crowded).collect()
    have = crowded.collect()
    assert len(rows) == len(have)
    fps = {r.text: brute_fingerprint(r.text) for r in have}
    classes = brute_classes(set(fps.values()))
    least = {}
    for r in have:
        c = classes[fps[r.text]]
        least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in rows) == sorted((str(r.doc_id), fps[r.text], least[classes[fps[r.text]]]) for r in have)


@pytest.mark.parametrize("block", [4096, 7, 2])
def test_links_hold_dense_classes_together(spark, block):
    rng, fps = random.Random(4), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre)
            near = centre
            for _ in range(rng.randrange(7)):
                near ^= 1 << rng.randrange(64)
            fps.add(near)
            centre = near if rng.random() < 0.2 else centre
    # pairs that differ in one bit of each of four bytes, and by all of one byte
    for base in (rng.getrandbits(64) for _ in range(20)):
        fps |= {base, base ^ 0x0101010100000000, base ^ 0xF}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, block=block)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in edges.collect())
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = brute_classes(fps)
    groups = lambda m: sorted(sorted(x for x in fps if m.get(x, x) == g) for g in {m.get(x, x) for x in fps})
    assert groups(found) == groups(want)


@pytest.mark.parametrize("room", [10, simhash.ROOM])
def test_long_chains_and_stars(spark, room):
    chain = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long"), room).collect()}
    assert all(found[k] == 0 for k in range(61)) and all(found[k] == 1000 for k in range(1000, 1100))


def test_one_of_each_class_stays(crowded, nothing):
    have = simhash.first_of_each(crowded)
    assert have.columns == crowded.columns
    rows, all_ = have.collect(), simhash.near_duplicates(crowded)
    assert len(rows) == all_.select("root").distinct().count()
    ids = {r.component_id for r in all_.select("component_id").distinct().collect()}
    assert {r.doc_id for r in rows} == ids
    assert simhash.first_of_each(nothing).count() == 0


def test_tally_counts_matching_bytes():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, 5000), np.uint64)
    b.view(np.uint8)[:] = np.where(rng.random(40_000) < 0.5, a.view(np.uint8), b.view(np.uint8))
    want = (a[:, None].view(np.uint8) == b[:, None].view(np.uint8)).sum(1)
    assert (simhash.tally(a ^ b) == want).all() and set(want) >= set(range(8))


def test_tally_rejects_before_bits_are_verified(monkeypatch):
    """Members of a posting share three bytes; those that share no fourth go by the tally, and only the rest have their bits counted."""
    rng = np.random.default_rng(6)
    members = np.unique(rng.integers(0, 1 << 64, 300, np.uint64) & ~np.uint64(0xFFFFFF) | np.uint64(0x123456))
    members = np.unique(np.concatenate([members, members[:50] ^ np.uint64(1 << 40)]))
    left, right = np.meshgrid(members, members)
    enough = simhash.tally(left ^ right) >= 4
    close = np.bitwise_count(left ^ right) <= 4
    assert (simhash.near(left, right, 4) == close).all()  # nothing within the distance is lost
    assert enough.sum() < 0.1 * enough.size and close.sum() < enough.sum()


def test_choices_meet_every_pair():
    """Any pair that matches in the guaranteed minimum of positions shares a posting."""
    from itertools import combinations

    for distance in range(8):
        for match in combinations(range(8), 8 - distance):
            assert any(set(c) <= set(match) for c in simhash.choices(distance))


def test_one_of_alike_rows_is_the_same_on_each_run(spark):
    rows = [(1, "same text of some words", "en", f"s{k}", k) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = {tuple(simhash.first_of_each(spark.createDataFrame(some, schema)).collect()) for some in (rows, rows[::-1])}
    assert len(kept) == 1
