import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from vaultlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water level by bisection. sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, float(3 * sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * sizes[s], mid * weight[s]) for s in order) < total else (low, mid)
    return {s: min(cap * sizes[s], high * weight[s]) for s in order}


@given(st.dictionaries(st.integers(0, 300), st.integers(1, 30), max_size=12), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_fit_stays_in_bounds_and_comes_near(cells, share):
    lengths, counts = np.array(list(cells), np.int64), np.array(list(cells.values()), np.int64)
    whole = int((lengths * counts).sum()) if len(cells) else 0
    budget = int(share * whole)
    quota = mixing.fit(lengths, counts, budget)
    assert ((quota >= 0) & (quota <= 3 * counts)).all()
    used = int((quota * lengths).sum()) if len(cells) else 0
    # one document more or less doesn't come nearer
    left, had = lengths[(quota < 3 * counts) & (lengths > 0)], lengths[(quota > 0) & (lengths > 0)]
    assert all(abs(used + n - budget) >= abs(used - budget) for n in left) and all(abs(used - n - budget) >= abs(used - budget) for n in had)


def nearest(lengths, target, cap=3):
    """Distance from target of the nearest sum of the lengths, each up to cap times."""
    reach = 1
    for n in lengths:
        for _ in range(cap):
            reach |= reach << n
    return min(abs(k - target) for k, bit in enumerate(bin(reach)[:1:-1]) if bit == "1")


def test_fit_is_nearest_within_capacity():
    lengths, counts = np.array([6, 10, 15]), np.array([4, 3, 2])
    each = [n for n, c in zip(lengths.tolist(), counts) for _ in range(c)]
    for target in range(255):
        quota = mixing.fit(lengths, counts, target)
        assert (quota <= 3 * counts).all() and abs(int((quota * lengths).sum()) - target) == nearest(each, target)
    assert mixing.fit([6000, 6001, 25], [1, 1, 4], 5069).tolist() == [1, 0, 0]  # 931 above is nearer than any sum below


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=5), st.floats(0, 3), st.sampled_from([1, 8, 50]))
@settings(max_examples=300, deadline=None)
def test_fit_is_nearest_whatever_the_window(cells, share, window):
    """Targets far beyond what the programme looks at first: against brute force over all sums."""
    lengths, counts = np.array(list(cells), np.int64), np.array(list(cells.values()), np.int64)
    target = round(share * int((lengths * counts).sum()))
    quota = mixing.fit(lengths, counts, target, window=window)
    assert (quota <= 3 * counts).all()
    assert abs(int((quota * lengths).sum()) - target) == nearest([n for n, c in cells.items() for _ in range(c)], target)


def test_long_documents_beyond_the_first_window():
    lengths, counts = np.array([70_001, 90_011, 130_003]), np.array([3, 2, 2])
    for target in (200_000, 411_111, 1_000_003):
        quota = mixing.fit(lengths, counts, target)
        sums = [a * 70_001 + b * 90_011 + c * 130_003 for a in range(10) for b in range(7) for c in range(7)]
        assert abs(int((quota * lengths).sum()) - target) == min(abs(x - target) for x in sums)


def test_large_budgets_are_filled_greedily_first():
    lengths, counts = np.arange(1, 4000), np.full(3999, 7)
    quota = mixing.fit(lengths, counts, 31_000_001)
    assert int((quota * lengths).sum()) == 31_000_001


def test_mix_meets_targets(crowded):
    rows = mixing.mixed(crowded).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(crowded).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in crowded.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    wanted = targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in crowded.collect())
    for s in sizes:
        best = nearest([r.size for r in rows if r.source == s and r.size], round(wanted[s]))
        assert abs(taken[s] - round(wanted[s])) == best


def test_repeats_are_rows(crowded, nothing):
    want = Counter()
    for r in mixing.mixed(crowded).collect():
        if r.size:
            want[r.doc_id, r.source] += r.taken // r.size
    have = mixing.repeated(crowded)
    assert have.columns == crowded.columns
    got = Counter((r.doc_id, r.source) for r in have.collect() if WORD.search(r.text or ""))
    assert got == +want
    assert mixing.repeated(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
