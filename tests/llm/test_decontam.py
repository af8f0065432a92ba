import random

import numpy as np
import pytest

from vaultlens.llm import decontam

from .conftest import EXTRA


def edit_distance_inside(item, text):
    """Fewest edits between item and any stretch of text."""
    above = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(above[j] + 1, now[j - 1] + 1, above[j - 1] + (a != b)))
        above = now
    return min(above)


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def planted(seed=5, items=30, docs=150):
    rng = random.Random(seed)
    common, rare = vocabulary(rng, 25), vocabulary(rng, 800)
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    bench = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(items)]
    rows = []
    for k in range(docs):
        text = [word() for _ in range(rng.randrange(0, 300))]
        if k % 2:
            piece = bench[rng.randrange(items)][1].split()
            for _ in range(rng.randrange(0, len(piece) // 4 + 1)):
                at = rng.randrange(len(piece))
                piece[at : at + rng.randrange(2)] = [] if rng.random() < 0.4 else [word()]
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = piece
        rows.append((k, " ".join(text).capitalize()))
    return bench, rows


def test_recall_and_precision(spark):
    bench, rows = planted()
    rows += [(900, None), (901, ""), (902, "..."), (1, rows[1][1]), (None, bench[0][1])]
    want = {}
    for i, t in bench:
        w = decontam.words(t)
        for k, text in enumerate(rows):
            if len(x := decontam.words(text[1])) and (d := edit_distance_inside(w, x)) <= int(0.2 * len(w) + 1e-9):
                want[k, i] = d
    found = decontam.Index(bench).find([t for _, t in rows])
    have = {(k, i): d for k, i, _, d in found}
    assert len(have) == len(found) and have.items() <= want.items() and len(have) >= 0.95 * len(want) > 50
    # exact copies are always found
    assert all(key in have for key, d in want.items() if d == 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([*bench, (77, None), (78, "")], "item_id long, text string")
    result = decontam.contaminated(df, b).collect()
    assert sorted(map(str, ((r.doc_id, r.item_id, r.edits) for r in result))) == sorted(map(str, ((rows[k][0], i, d) for (k, i), d in have.items())))
    # a benchmark that comes in blocks gives the same
    again = decontam.contaminated(df, b, block_words=200).collect()
    exact = lambda rs: {(r.doc_id, r.item_id) for r in rs if r.edits == 0}
    assert exact(again) == exact(result)


def test_clean_keeps_the_rest_whole(spark, crowded, nothing):
    first = crowded.filter("doc_id = 7").first().text.split("\n")[0]
    bench = spark.createDataFrame([(1, first), (2, None)], "item_id long, text string")
    have = decontam.clean(crowded, bench)
    assert have.columns == crowded.columns and set(EXTRA) <= set(have.columns)
    gone = {r.doc_id for r in crowded.collect()} - {r.doc_id for r in have.collect()}
    assert gone == {7} and have.count() == crowded.count() - 1
    assert decontam.clean(nothing, bench).count() == 0
    assert decontam.clean(crowded, bench.filter("false")).count() == crowded.count()
    assert decontam.contaminated(crowded, bench.filter("false")).count() == 0


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    index = decontam.Index([(0, "a b c d e f g h i j")])
    for _ in range(50):
        pad = np.zeros(12, np.int64)
        ids = np.concatenate([pad, rng.integers(0, 11, 14), pad])
        got = index.distances(ids, 10, np.array([14]), np.array([0]))[0]
        assert got == edit_distance_inside(index.items[0][1].tolist(), ids[12:26].tolist())


@pytest.mark.parametrize("target", [0.8, 0.97])
def test_tables_are_added_up_to_the_target_of_each_length(target):
    rng = random.Random(3)
    bench, _ = planted()
    vocabulary_ = vocabulary(rng, 900)
    bench += [(100 + k, " ".join(rng.choice(vocabulary_) for _ in range(n))) for k, n in enumerate([1, 2, 4, 120, 300, 300, 700])]
    index = decontam.Index(bench, recall=target)
    assert set(index.recalls) == set(index.lengths) and index.recall >= target


def test_long_edited_passages_are_found():
    """Held-out copies of long items, with as many edits as are allowed, within other text."""
    rng = random.Random(9)
    pool, wanted, texts = vocabulary(rng, 900), [], []
    bench = [(k, " ".join(rng.choice(pool) for _ in range(n))) for k, n in enumerate([120] * 5 + [300] * 5)]
    for k in range(60):
        item, text = rng.choice(bench)
        piece = text.split()
        for _ in range(int(0.2 * len(piece))):
            at = rng.randrange(len(piece))
            piece[at : at + rng.randrange(2)] = [] if rng.random() < 0.3 else [rng.choice(pool)]
        around = [rng.choice(pool) for _ in range(200)]
        around[100:100] = piece
        texts.append(" ".join(around))
        if edit_distance_inside(decontam.words(text), decontam.words(texts[-1])) <= int(0.2 * len(decontam.words(text)) + 1e-9):
            wanted.append((k, item))
    found = {(k, i) for k, i, _, _ in decontam.Index(bench).find(texts)}
    assert len(wanted) > 30 and len(found & set(wanted)) >= 0.95 * len(wanted)
