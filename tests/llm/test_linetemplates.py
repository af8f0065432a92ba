import re
from collections import Counter, defaultdict

from vaultlens.llm import linetemplates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, leading=3, min_docs=3, share=0.6):
    """{(doc_id, text): kept text} of rows (doc_id, text)."""
    lines = defaultdict(set)
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    for key in set(rows):
        for line in (key[1] or "").split("\n"):
            if words := masked(line):
                lines[words].add(key)
    leaves = defaultdict(list)
    for words in lines:
        leaves[len(words), words[:leading]].append(words)
    drop = {w for w, d in lines.items() if len(d) >= min_docs}
    for members in leaves.values():
        support = Counter()
        for w in members:
            support.update({(k, x): len(lines[w]) for k, x in enumerate(w)})
        docs = defaultdict(set)
        template = {}
        for w in members:
            if len(lines[w]) < min_docs:
                t = tuple(x if support[k, x] >= min_docs else None for k, x in enumerate(w))
                if sum(x is not None for x in t) >= share * len(t):
                    template[w] = t
                    docs[t] |= lines[w]
        drop |= {w for w, t in template.items() if len(docs[t]) >= min_docs}
    return {key: None if key[1] is None else "\n".join(x for x in key[1].split("\n") if masked(x) not in drop) for key in set(rows)}


def test_templates_with_variable_fields(spark):
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(k, f"{n} stands alone here\nPosted by user {n} at 12:0{k} on this very site\nShared line for all of them") for k, n in enumerate(names)]
    rows += [(10, "Posted by user alpha only"), (11, None), (12, ""), (13, "Shared line for all of them\n\nmine"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n_lines", "8 as leaf", "9 as words")
    have = linetemplates.cleaned(df)
    assert have.columns == ["doc_id", "text", "leaf", "words", "n_lines", "n_dropped"]
    found = {(r.doc_id): r for r in have.collect()}
    assert found[1].text == "beta stands alone here" and (found[1].n_lines, found[1].n_dropped) == (3, 2)
    assert found[10].text == rows[5][1] and found[11].text is None and found[12].text == "" and found[13].text == "\nmine"
    assert have.count() == len(rows)


def test_against_brute_force(docs, crowded, nothing):
    for df in (docs, crowded):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = brute(rows)
        have = [(r.doc_id, r.text) for r in linetemplates.cleaned(df).collect()]
        assert sorted(map(str, have)) == sorted(str((k[0], want[k])) for k in rows)
        assert any(want[k] != k[1] for k in want)
    assert linetemplates.cleaned(nothing).count() == 0
